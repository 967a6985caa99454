"""Queries on shards, tensor containers, stored state and the streams that keep it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import balanced, bank, manifests, ownership, packing, registry
from ..sources import npytok, ranges, scans, tensors
from ..sources.shared import shared_folder
from ..streaming import dashboard, watchdog
from ..streaming import events as ev
from .manifest_queries import written
from .registry import query
from .texts_and_times import streamed

DATA = "repeat(md5(text), (1 + doc_id % 5)::int)"


@query(f"SELECT source || '-' || (doc_id % 16) || '.safetensors' AS file, 'doc.' || doc_id AS tensor, 'U8' AS dtype, (32 * (1 + doc_id % 5))::bigint AS n_bytes, sha256(left({DATA}, 40)) AS sha256 FROM documents")
def tensor_ranges(spark, table):
    """Containers written by tasks, then read by ranges: headers, and 40 bytes of each tensor."""
    folder = shared_folder(spark, "tensors")
    data = F.encode(F.repeat(F.md5("text"), (F.col("doc_id") % 5 + 1).cast("int")), "utf-8")
    rows = table("documents").select(
        F.concat("source", F.lit("-"), F.col("doc_id") % 16, F.lit(tensors.SUFFIX)).alias("file"), F.concat(F.lit("doc."), "doc_id").alias("tensor"),
        F.lit("U8").alias("dtype"), F.array(F.octet_length(data).cast("long")).alias("shape"), data.alias("data"),
    )
    tensors.write_files(rows, folder).count()
    return tensors.digests(tensors.scan(spark, folder, 40)).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))


@query("""WITH n AS (SELECT least(12, count(*))::bigint AS k FROM (SELECT DISTINCT lang, source FROM documents))
SELECT 'copy' AS model, k AS n_sampled, k AS n_common, 0::bigint AS n_different, true AS copied FROM n UNION ALL SELECT 'other', k, k, k, false FROM n""")
def tensor_copy_check(spark, table):
    """Twelve tensors, drawn by both digests, of a model in one file against the same model in two files, and against another."""
    base = shared_folder(spark, "models")
    stats = table("documents").groupBy("lang", "source").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum("n_chars").cast("string")).alias("v"))

    def model(name: str, salt: str, shard) -> str:
        data = F.encode(F.repeat(F.concat(F.lit(salt), "lang", "source", "v"), 500), "utf-8")
        rows = stats.select(shard.alias("file"), F.concat_ws(".", "lang", "source").alias("tensor"), F.lit("U8").alias("dtype"), F.array(F.octet_length(data).cast("long")).alias("shape"), data.alias("data"))
        tensors.write_files(rows, f"{base}/{name}").count()
        if name != "king":
            named = rows.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tensor", "file")))).alias("weight_map"))).alias("j"))
            ranges.put(f"{base}/{name}/{tensors.INDEX}", named.first()["j"].encode())
        return f"{base}/{name}"

    half = F.concat(F.lit("model-0000"), (F.crc32(F.encode("lang", "utf-8")) % 2 + 1).cast("string"), F.lit("-of-00002.safetensors"))
    king, out = model("king", "a", F.lit(tensors.SINGLE)), None
    for name, salt in (("copy", "a"), ("other", "b")):
        found = tensors.sampled_copy(spark, model(name, salt, half), king, f"sha256:{name}", "sha256:king").withColumn("model", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


TOKENS = r"""w AS (SELECT source, doc_id, generate_subscripts(a, 1) AS k, unnest(a) AS word FROM (SELECT source, doc_id, regexp_split_to_array(text, '\s+') AS a FROM documents)),
t AS (SELECT source, doc_id, k, ('0x' || md5(word)[1:4])::bigint AS token FROM w UNION ALL SELECT source, doc_id, 2147483647, 0 FROM documents),
p AS (SELECT source, token, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM t)"""


@query(f"WITH {TOKENS} SELECT (SELECT sum(n // 128) FROM (SELECT DISTINCT source, n FROM p))::bigint AS n_records, sum(token)::bigint AS checksum FROM p WHERE pos < n // 128 * 128")
def npy_roundtrip(spark, table):
    """Shards of all documents written and read again as records."""
    folder, rows = written(spark, table, "roundtrip")
    npytok.write_shards(rows, folder)
    back = npytok.scan(spark, folder, 128)
    return back.agg(F.count("*").alias("n_records"), F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("checksum"))


@query(f"""WITH {TOKENS}, s AS (SELECT source, (sum(k) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) - k)::bigint AS base FROM (SELECT DISTINCT source, n // 64 AS k FROM p)),
r AS (SELECT base + pos // 64 AS record_idx, count(*) AS n, max(token) AS largest FROM p JOIN s USING (source) WHERE pos < p.n // 64 * 64 GROUP BY 1)
SELECT record_idx, n, largest FROM r WHERE record_idx IN (SELECT 7 * doc_id FROM documents)""")
def npy_index_lookup(spark, table):
    """Records by a table of indices, a seventh of all that there are: read by ranges."""
    folder, rows = written(spark, table, "lookup")
    npytok.write_shards(rows, folder)
    found = npytok.records(spark, folder, table("documents").select((F.col("doc_id") * 7).alias("record_idx")), 64)
    return found.select("record_idx", F.size("tokens").cast("long").alias("n"), F.array_max("tokens").alias("largest"))


@query(r"""WITH n AS (SELECT source, lang, sum(len(regexp_split_to_array(text, '\s+')) + 1)::bigint AS n FROM documents GROUP BY 1, 2)
SELECT lang || '/' || source || '.npy' AS key, CASE WHEN lang = 'en' THEN 4 * n + 129 ELSE 4 * n + 128 END AS size, CASE WHEN lang = 'en' THEN 'wrong_size' ELSE 'ok' END AS state, 'new/' || lang || '/' || source || '.npy' AS dest FROM n
UNION ALL SELECT lang || '/gone.npy', 1, 'missing', 'new/' || lang || '/gone.npy' FROM (SELECT DISTINCT lang FROM n)""")
def mirror_verified(spark, table):
    """Shards of every language and source, listed in their store and held against the objects that a mirror should have."""
    folder = shared_folder(spark, "mirror")
    ids = F.transform(F.split("text", r"\s+"), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("long"))
    d = table("documents").select(F.concat_ws("/", "lang", "source").alias("name"), "lang", F.col("doc_id").alias("ord"), F.concat(ids, F.array(F.lit(0).cast("long"))).alias("tokens"))
    npytok.write_shards(d, folder, source="name")
    there = scans.objects(spark, folder, ".npy").select("key", "size")
    langs = d.select("lang").distinct()
    size = F.sum(F.size("tokens")).cast("long") * 4 + 128 + F.when(F.first("lang") == "en", 1).otherwise(0)
    want = d.groupBy(F.concat("name", F.lit(".npy")).alias("key")).agg(size.alias("size")).unionByName(langs.select(F.concat("lang", F.lit("/gone.npy")).alias("key"), F.lit(1).cast("long").alias("size")))
    return manifests.existing(want, there, "key", "size").withColumn("dest", manifests.destination(F.col("key"), "old/", "new/"))


@query("""WITH g AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, max(ts) OVER () AS last FROM events),
d AS (SELECT user_id, ts, epoch(coalesce(nxt, last)) - epoch(ts) AS gap, nxt IS NULL AS open FROM g)
SELECT user_id, ts + INTERVAL 180 SECOND AS at, 'idle_warned' AS phase FROM d WHERE gap >= 180 UNION ALL SELECT user_id, ts + INTERVAL 420 SECOND, 'idle_failed' FROM d WHERE gap >= 420""")
def idle_watchdog(spark, table):
    """Silence on the stream of all events, by timers: one warning, then a failure."""
    rules = watchdog.Rules(limit=None, retries=0, errors=(), results=())
    return watched(spark, table, rules, "idle").drop("attempt")


@query("""WITH r AS (SELECT user_id, ts, event_id, event_type, sum((event_type = 'purchase')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM events),
k AS (SELECT *, sum((event_type = 'error')::int) OVER (PARTITION BY user_id, coalesce(run, 0) ORDER BY ts, event_id) AS n FROM r)
SELECT user_id, ts AS at, CASE WHEN event_type = 'purchase' THEN 'done' WHEN n % 2 = 1 THEN 'error_retry' ELSE 'error' END AS phase,
(CASE WHEN event_type = 'purchase' THEN 1 + n % 2 ELSE 2 - n % 2 END)::int AS attempt FROM k WHERE event_type IN ('error', 'purchase')""")
def retry_machine(spark, table):
    """Errors that are retried once and then final, forgiven by a result, on the stream of all events."""
    far = 1e9
    return watched(spark, table, watchdog.Rules(far, far, None, 1, far, ("error",), ("purchase",)), "retry")


def watched(spark, table, rules: watchdog.Rules, name: str):
    with watchdog.stateful(spark):
        events = streamed(spark, table, "0 seconds")
        found = ev.drain(watchdog.watch(events, "user_id", "ts", "event_type", "event_id", rules), name, "append")
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY 1)
SELECT * FROM f ORDER BY last_event DESC LIMIT 20""")
def dashboard_stream(spark, table):
    """The stream of all events folded into a table, and a document of its twenty latest rows."""
    folder = shared_folder(spark, "dashboard")
    fields = {"last_event": F.col("event_id"), "last_type": F.col("event_type"), "last_purchase": F.when(F.col("event_type") == "purchase", F.col("value"))}
    board = dashboard.Dashboard(spark, folder, "user_id", "event_id", fields, lambda t: t.orderBy(F.desc("last_event")).limit(20))
    dashboard.keep(streamed(spark, table), board, f"{folder}/stream")
    return dashboard.document(spark, folder, board.table().schema)


# Sequences of the demonstration: documents by source and language, of which long ones are refused.
BALANCE = balanced.Balance(90, "s", vocabulary=6000, shards_per_source=2)
BALANCED = """src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents)),
quota AS (SELECT source, 90 // k + (i < 90 % k)::int AS quota FROM src),
sh AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || source || '|' || lang), lang) - 1 AS nth, count(*) OVER (PARTITION BY source) AS shards FROM (SELECT DISTINCT source, lang FROM documents)),
r AS (SELECT source, lang, doc_id, n_chars < 6000 AS good, row_number() OVER (PARTITION BY source, lang ORDER BY md5('s|' || source || '|' || lang || '|' || doc_id), doc_id) AS n FROM documents),
c AS (SELECT source, lang, count(*) AS n_rows, coalesce(list(n) FILTER (NOT good), []) AS bad FROM r GROUP BY 1, 2),
l AS (SELECT *, least(2, shards) AS sharing FROM sh JOIN c USING (source, lang) JOIN quota USING (source)),
f AS (SELECT source, -1::bigint AS nth, 0::bigint AS have, 0::bigint AS reads, 0::bigint AS takes, quota, ''::varchar AS lang FROM quota
UNION ALL SELECT source, nth, have + good, reads, least(good, quota - have), quota, lang FROM
(SELECT *, reads - len(list_filter(bad, lambda x: x <= reads)) AS good FROM
(SELECT f.source, l.nth, f.have, f.quota, l.lang, l.bad,
least(l.n_rows, floor((CASE WHEN l.nth < sharing THEN f.quota // sharing + (l.nth < f.quota % sharing)::int ELSE f.quota - have END) * 1.5)::bigint + 8) AS reads
FROM f JOIN l ON l.source = f.source AND l.nth = f.nth + 1 WHERE have < f.quota))),
t AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n) AS k, takes FROM r JOIN f USING (source, lang) WHERE good AND n <= reads)"""


@query(f"""WITH RECURSIVE {BALANCED} SELECT source, lang, doc_id, row_number() OVER (ORDER BY md5('s|joint|' || source || '|' || lang || '|' || doc_id)) - 1 AS place FROM t WHERE k <= takes""")
def two_level_sample(spark, table):
    """Quotas by source, then by shard, over-reading where long sequences are refused, refill, joint shuffle."""
    rows = table("documents").select("source", F.col("lang").alias("shard"), F.col("doc_id").alias("idx"), F.col("n_chars").alias("largest"))
    found = balanced.balanced_sample(rows, BALANCE)
    return found.select("source", F.col("shard").alias("lang"), F.col("idx").alias("doc_id"), F.col("place").cast("long").alias("place"))


@query(r"""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents)),
u AS (SELECT source, (idx - 2 + k) % k AS turn FROM s),
w AS (SELECT turn, doc_id, generate_subscripts(a, 1) AS k, unnest(a) AS word FROM (SELECT turn, doc_id, regexp_split_to_array(text, '\s+') AS a FROM documents JOIN u USING (source) WHERE turn < 8)),
t AS (SELECT turn, doc_id, k, ('0x' || md5(word)[1:4])::bigint AS token FROM w UNION ALL SELECT turn, doc_id, 2147483647, 0 FROM documents JOIN u USING (source) WHERE turn < 8),
p AS (SELECT token, row_number() OVER (ORDER BY turn, doc_id, k) - 1 AS pos, count(*) OVER () AS n FROM t)
SELECT pos // 256 AS seq_idx, count(*) AS n, sum(token)::bigint AS checksum FROM p WHERE pos < least(40, n // 256) * 256 GROUP BY 1""")
def pack_until_windows(spark, table):
    """Forty windows from a seeded place in the list of files on; no more files are tokenised than it takes."""
    files = table("documents").select(F.col("source").alias("key")).distinct().withColumn("idx", F.row_number().over(W.orderBy("key")) - 1)  # a row for each file
    ids = F.transform(F.split("text", r"\s+"), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("long"))
    read = lambda group: group.join(table("documents").select(F.col("source").alias("key"), F.col("doc_id").alias("ord"), "text"), "key")
    windows, _ = packing.pack_until(files, read, lambda d: d.select("turn", "ord", ids.alias("tokens")), 40, 256, 2)
    return windows.select("seq_idx", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


OWNERS = "e AS (SELECT user_id AS hotkey, event_id AS block, CASE WHEN event_type <> 'error' THEN event_type END AS coldkey FROM events)"


@query(f"""WITH {OWNERS}, h AS (SELECT hotkey, arg_max(struct_pack(o := coldkey), block).o AS head FROM e GROUP BY 1),
r AS (SELECT o_orderkey, o_custkey AS hotkey, o_orderkey AS block FROM orders),
a AS (SELECT r.*, e.coldkey AS past FROM r ASOF LEFT JOIN e ON r.hotkey = e.hotkey AND r.block >= e.block)
SELECT o_orderkey, coalesce(head, past) AS coldkey, CASE WHEN head IS NOT NULL THEN 'head' WHEN past IS NOT NULL THEN 'reveal_block' END AS owner_source FROM a LEFT JOIN h USING (hotkey)""")
def owner_as_of(spark, table):
    """Owners at the head of the chain, else as of the block of the reveal."""
    reveals = table("orders").select("o_orderkey", F.col("o_custkey").alias("hotkey"), F.col("o_orderkey").alias("block"))
    entries = table("events").select(F.col("user_id").alias("hotkey"), F.col("event_id").alias("block"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("coldkey"))
    return ownership.owners(reveals, entries).select("o_orderkey", "coldkey", "owner_source")


@query("""WITH old AS (SELECT vec_id AS id, 'm' || label AS model_digest, 'v1' AS version FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
a AS (SELECT doc_id, md5(text) AS model_digest, lang AS version FROM documents UNION ALL SELECT 10000000 + vec_id, 'm' || label, 'v1' FROM embeddings),
n AS (SELECT doc_id, model_digest, version FROM a QUALIFY row_number() OVER (PARTITION BY version, model_digest ORDER BY doc_id) = 1),
w AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY doc_id) AS id, model_digest, version FROM n WHERE (version, model_digest) NOT IN (SELECT (version, model_digest) FROM old)),
b AS (SELECT id, model_digest, version FROM old UNION ALL SELECT * FROM w)
SELECT id, version, 'k' AS key_id, model_digest, model_digest AS similarity_group FROM b ORDER BY id DESC LIMIT 100""")
def bank_insert(spark, table):
    """A bank of an older form, without families, that takes in all documents: each model once, the newest hundred stay."""
    e = table("embeddings").select("vec_id", F.concat(F.lit("m"), "label").alias("model_digest"))
    old = e.groupBy("model_digest").agg(F.min("vec_id").alias("id")).select("id", "model_digest", F.lit("v1").alias("version"), F.lit("k").alias("key_id"))
    store = bank.BankStore(spark, shared_folder(spark, "bank"))
    store.save(old)
    d = table("documents").select(F.col("doc_id").alias("o"), F.md5("text").alias("model_digest"), F.col("lang").alias("version"))
    arrivals = d.unionByName(e.select((F.col("vec_id") + 10_000_000).alias("o"), "model_digest", F.lit("v1").alias("version"))).withColumn("key_id", F.lit("k"))
    store.save(bank.insert(store.rows(), arrivals, "o"))
    return store.rows().select("id", "version", "key_id", "model_digest", "similarity_group")


@query("SELECT o_orderkey, 'w' || o_custkey AS repo FROM orders WHERE o_custkey <> 10 UNION ALL SELECT -1, 'w10'")
def requeued(spark, table):
    """A queue whose first place goes to a repository that is tried again; its other rows leave."""
    queue = table("orders").select("o_orderkey", F.concat(F.lit("w"), "o_custkey").alias("repo"), F.col("o_orderkey").alias("place"))
    entry = spark.createDataFrame([(-1, "w10")], "o_orderkey long, repo string")
    return registry.requeue_front(queue, entry).select("o_orderkey", "repo")

