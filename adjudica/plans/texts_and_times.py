"""Queries on names, references, times, sizes and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import boards
from ..sources import scans
from ..streaming import events as ev
from .registry import query


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z0-9]+://([^/?#]*)', 1) AS host, array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z0-9]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '|') AS parts,
coalesce(list_extract(list_filter(string_split(regexp_extract(url, '^[a-z0-9]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), -2), '') AS folder FROM pages""")
def url_parts(spark, table):
    u = F.col("url")
    return table("pages").select("page_id", text.url_host(u).alias("host"), F.array_join(text.path_parts(u), "|").alias("parts"), text.manifest_source(u).alias("folder"))


SLUG = r"coalesce(nullif(trim(regexp_replace({}, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), '{}')"


@query(f"SELECT c_custkey AS id, {SLUG.format('c_name', 'unknown')} AS slug, {SLUG.format('c_name', 'unknown')} || '--' || {SLUG.format('c_mktsegment', 'unknown')} AS king FROM customer UNION ALL SELECT page_id, {SLUG.format('url', 'unknown')}, 'p' FROM pages")
def slug(spark, table):
    c = table("customer").select(F.col("c_custkey").alias("id"), text.slug(F.col("c_name")).alias("slug"), text.champion_id(F.col("c_name"), F.col("c_mktsegment")).alias("king"))
    return c.unionByName(table("pages").select(F.col("page_id").alias("id"), text.slug(F.col("url")).alias("slug"), F.lit("p").alias("king")))


@query(f"SELECT c_custkey, {SLUG.format('c_mktsegment', 'run')} AS s, left(replace('sha256:' || sha256(c_name), ':', '-'), 80) AS d, trim(regexp_replace('  a   ' || c_name, '\\s+', ' ', 'g')) AS c, c_name || '@' || c_mktsegment AS marker, 'parts/' || c_custkey || '/manifest.json' AS part FROM customer")
def slug_variants(spark, table):
    c = table("customer")
    return c.select(
        "c_custkey", text.slug(F.col("c_mktsegment"), "run").alias("s"), text.short_digest(F.concat(F.lit("sha256:"), F.sha2("c_name", 256))).alias("d"),
        text.collapse_space(F.concat(F.lit("  a   "), "c_name")).alias("c"), text.model_key(F.col("c_name"), F.col("c_mktsegment")).alias("marker"),
        F.concat_ws("/", F.lit("parts"), F.col("c_custkey").cast("string"), F.lit("manifest.json")).alias("part"),
    )


ADDRESS = "'5' || translate(substr(sha256(c_name), 1, 47), '0', '9')"


def address():
    return F.concat(F.lit("5"), F.translate(F.substring(F.sha2("c_name", 256), 1, 47), "0", "9"))


@query(f"SELECT c_custkey, 'own/m' || c_custkey AS repo, CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE 'sha256:' || sha256(c_name) END AS digest, {ADDRESS} AS address, c_custkey % 7 <> 0 AS valid FROM customer")
def reveal_parse(spark, table):
    digest = F.when(F.col("c_custkey") % 7 == 0, "bad").otherwise(F.concat(F.lit("sha256:"), F.sha2("c_name", 256)))
    built = text.build_reveal(F.concat(F.lit("own/m"), "c_custkey"), digest, address())
    return table("customer").select("c_custkey", text.parse_reveal(built).alias("p")).select("c_custkey", "p.repo", "p.digest", "p.address", "p.valid")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'v3|' ELSE 'v4|' END || c_name AS payload, c_custkey % 3 = 2 AS legacy FROM customer")
def commitment_decode(spark, table):
    """Plain text, or hex with a one-byte length prefix."""
    plain = F.concat(F.when(F.col("c_custkey") % 3 == 2, "v3|").otherwise("v4|"), "c_name")
    prefixed = F.concat(F.lit("0x"), F.lpad(F.hex(F.length(plain) * 4), 2, "0"), F.hex(plain))
    sent = F.when(F.col("c_custkey") % 2 == 0, plain).otherwise(prefixed)
    decoded = scans.decode_commitment(sent)
    return table("customer").select("c_custkey", decoded.alias("payload")).withColumn("legacy", F.startswith("payload", F.lit("v3|")))


@query("SELECT c_custkey, 'k' || (c_custkey % 5) AS digest FROM customer")
def digest_from_key(spark, table):
    key = F.concat("c_name", F.lit("@k"), F.col("c_custkey") % 5)
    return table("customer").select("c_custkey", F.substring_index(key, "@", -1).alias("digest"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'org/set' || page_id ELSE 'plain/name' END AS repo, CASE WHEN page_id % 3 = 0 THEN 'pre/' ELSE '/' END || page_id || '.npy' AS ref, left(sha256(url), 24) || '-' || list_extract(string_split(string_split(url, '?')[1], '/'), -1) AS cache FROM pages""")
def hub_url(spark, table):
    hub = F.concat(F.lit("https://hub.example.com/datasets/org/set"), "page_id", F.lit("/tree/main/data/"))
    raw = F.when(F.col("page_id") % 2 == 0, hub).otherwise(F.lit("plain/name"))
    name = F.concat(F.when(F.col("page_id") % 3 == 0, "pre/").otherwise("/"), "page_id", F.lit(".npy"))
    return table("pages").select("page_id", text.hub_repo_id(raw, ["hub.example.com"]).alias("repo"), text.manifest_ref(name, F.lit("pre/")).alias("ref"), text.cache_name(F.col("url")).alias("cache"))


@query(f"SELECT c_custkey, left({ADDRESS}, 5) || right({ADDRESS}, 5) AS token, true AS held, 'lab' AS label, 'own/m' AS repo, 'd' || c_custkey AS digest, 2 AS n_specs FROM customer")
def ref_validate(spark, table):
    ref = text.labelled_ref(F.concat(F.lit("lab=own/m@d"), "c_custkey"))
    token = text.owner_token(address())
    held = text.holds_token(F.concat(F.lit("own/"), F.upper(token)), address())
    return table("customer").select("c_custkey", token.alias("token"), held.alias("held"), ref.alias("r"), F.size(text.gpu_specs(F.lit("a:4, b"))).alias("n_specs")).select("c_custkey", "token", "held", "r.*", "n_specs")


@query("SELECT event_id, ts AS parsed, greatest(0, floor(epoch(TIMESTAMP '2024-01-20 00:00:00')) - floor(epoch(date_trunc('second', ts))))::bigint AS age FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def timestamp_parse(spark, table):
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    written = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss 'UTC'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    parsed = text.parse_time(written)
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return table("events").select("event_id", parsed.cast("timestamp_ntz").alias("parsed"), text.age_seconds(parsed, now).cast("long").alias("age"))


@query(r"""WITH d AS (SELECT doc_id, n_chars * n_chars * 64 AS n, n_chars * 60.0::double AS s FROM documents)
SELECT doc_id, CASE WHEN n >= 1099511627776 THEN printf('%.1f TiB', n / 1099511627776.0::double) WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0::double) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0::double) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0::double) ELSE n || ' B' END AS bytes,
CASE WHEN s < 3600 THEN printf('%.0fm', s / 60) WHEN s < 86400 THEN 'h' ELSE 'd' END AS age FROM d""")
def human_units(spark, table):
    n, s = F.col("n_chars") * F.col("n_chars") * 64, F.col("n_chars") * 60
    age = text.human_age(s)
    return table("documents").select("doc_id", text.human_bytes(n).alias("bytes"), F.when(s < 3600, age).otherwise(F.right(age, F.lit(1))).alias("age"))


@query("SELECT page_id, page_id % 3 = 0 AS missing FROM pages")
def missing_model(spark, table):
    log = F.concat("html", F.when(F.col("page_id") % 3 == 0, "... Repository Not Found ...").otherwise("fine"))
    return table("pages").select("page_id", text.missing_model(log).alias("missing"))


@query("""SELECT p_partkey, '{"arch":' || to_json(p_brand) || coalesce(',"layers":' || p_size, '') || ',"type":' || to_json(p_type) || '}' AS key, 'model ' || p_name || ' resembles ' || p_brand AS message FROM part""")
def json_key(spark, table):
    key = F.to_json(F.struct(F.col("p_brand").alias("arch"), F.col("p_size").alias("layers"), F.col("p_type").alias("type")))
    said = F.format_string("model %s resembles %s", F.col("p_name"), F.col("p_brand"))
    return table("part").select("p_partkey", key.alias("key"), said.alias("message"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN 'acc_x' WHEN event_id % 4 = 1 THEN 'acc' ELSE 'acc,none' END AS key, CASE WHEN event_id % 4 = 3 THEN NULL ELSE value END AS value FROM events")
def metric_extract(spark, table):
    """Results as JSON maps: preferred keys first, then a fitting beginning; text is not a number."""
    k = F.col("event_id") % 4
    name = F.when(k == 0, "acc,none").when(k == 1, "acc").when(k == 2, "acc_x").otherwise("other")
    node = F.to_json(F.create_map(name, F.col("value").cast("string"), F.lit("alias"), F.lit("text"), F.lit("acc_norm"), F.lit("n/a")))
    parsed = F.from_json(node, T.MapType(T.StringType(), T.StringType()))
    both = F.create_map(F.lit("mmlu"), parsed)
    own = boards.task_node(F.when(k == 0, both), both, F.lit("mmlu"))
    rows = table("events").select("event_id", own.alias("node"))
    return rows.select("event_id", boards.metric(F.col("node"), F.array(F.lit("acc,none"), F.lit("acc"))).alias("m")).select("event_id", "m.key", "m.value")


@query("SELECT event_id, (value > 50 AND value * 2 > 50) AS busy, true AS parsed FROM events")
def gpu_csv(spark, table):
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string"), (F.col("value") * 2).cast("string"))
    parsed = F.from_csv(line, "id long, a double, b double")
    idle = F.forall(F.array("g.a", "g.b"), lambda u: u <= 50)
    rows = table("events").select("event_id", parsed.alias("g"))
    return rows.select("event_id", (~F.exists(F.array("g.a", "g.b"), lambda u: u <= 50)).alias("busy"), (F.col("g.id") == F.col("event_id")).alias("parsed"), idle.alias("idle")).drop("idle")


GAP = "(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts))"


@query(f"SELECT event_id, round(gap, 3) AS gap, CASE WHEN gap >= 420 THEN 'fail' ELSE 'warn' END AS state FROM (SELECT event_id, {GAP} AS gap FROM events) WHERE gap >= 180")
def idle_gaps(spark, table):
    return ev.idle_gaps(table("events"), "user_id", "ts", ["ts", "event_id"]).select("event_id", F.round("gap", 3).alias("gap"), "state")


@query("SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_purchase, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def event_fold(spark, table):
    fields = {"last_purchase": F.when(F.col("event_type") == "purchase", F.col("value")), "last_type": F.col("event_type")}
    return ev.fold_state(table("events"), "user_id", ["ts", "event_id"], fields)


RUNS = """r AS (SELECT user_id, event_type = 'error' AS e, sum((event_type <> 'error')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, event_id, ts FROM events)"""


@query(f"WITH {RUNS}, n AS (SELECT user_id, run, count(*) FILTER (e) AS n FROM r GROUP BY 1, 2) SELECT user_id, max(n) AS longest, arg_max(n, run) AS at_end FROM n GROUP BY 1")
def consecutive_errors(spark, table):
    return ev.longest_runs(table("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(f"WITH {RUNS}, f AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempt FROM r WHERE e) SELECT event_id, attempt, CASE WHEN attempt <= 1 THEN 'retry' ELSE 'fail' END AS action FROM f")
def timeout_state(spark, table):
    found = ev.attempts(table("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 1)
    return found.select("event_id", F.col("attempt").cast("long").alias("attempt"), "action")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY floor(epoch(ts) / 5) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def debounce(spark, table):
    return ev.debounce(table("events"), "ts", 5, ["ts", "event_id"]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def marker_dedup(spark, table):
    return ev.changed(table("events"), "user_id", ["ts", "event_id"], "event_type").select("event_id")


@query("WITH p AS (SELECT floor(epoch(ts) / 3600)::bigint AS slot, count(*) AS n FROM events GROUP BY 1), b AS (SELECT unnest(range(min(slot), max(slot) + 1)) AS slot FROM p) SELECT slot, coalesce(n, 0) AS n FROM b LEFT JOIN p USING (slot)")
def heartbeat(spark, table):
    return ev.filled(table("events"), "ts", 3600)


@query("""WITH RECURSIVE f AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
s AS (SELECT user_id, event_id, t, k, t AS last, true AS keep FROM f WHERE k = 1 UNION ALL
SELECT f.user_id, f.event_id, f.t, f.k, CASE WHEN f.t - s.last >= 86400 THEN f.t ELSE s.last END, f.t - s.last >= 86400 FROM s JOIN f ON f.user_id = s.user_id AND f.k = s.k + 1)
SELECT user_id, event_id FROM s WHERE keep""")
def cooldown(spark, table):
    return ev.cool_downs(table("events").where("event_type = 'error'"), "user_id", "ts", ["ts", "event_id"], 86_400.0)


def streamed(spark, table, late: str = "1 hour"):
    """The events table as a stream of its files, in the folder or the single file that it is read from."""
    files = table("events").inputFiles()
    folders, names = {f.rsplit("/", 1)[0] for f in files}, [f.rsplit("/", 1)[1] for f in files]
    if len(folders) != 1:
        raise ValueError("the events table must lie in one folder")
    pattern = names[0] if len(names) == 1 else "*.parquet"
    rows = spark.readStream.schema(table("events").schema).option("pathGlobFilter", pattern).parquet(folders.pop())
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark, table):
    counts = ev.window_counts(streamed(spark, table), "ts", "1 day", "event_type")
    return ev.drain(counts, f"counts_{uuid.uuid4().hex[:8]}").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, nth""")
def stream_sessions(spark, table):
    found = ev.drain(ev.sessions(streamed(spark, table), "ts", "30 minutes", "user_id"), f"sessions_{uuid.uuid4().hex[:8]}")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def event_sink(spark, table):
    ends = streamed(spark, table).where("event_type in ('error', 'purchase')").select("event_id", "event_type")
    return ev.drain(ends, f"sink_{uuid.uuid4().hex[:8]}", "append")
