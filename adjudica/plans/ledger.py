"""Queries on submissions, champions, boards and retention."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..operators import boards, listings, registry, retention, sampling
from ..sources.shared import shared_folder
from ..sources.versions import Versions
from .registry import query


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_per_submitter(spark, table):
    e = table("events").withColumn("id", F.col("event_id"))
    return registry.latest(e, "user_id", "ts").select("user_id", "event_id", "event_type", "value")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey <= 100 THEN 'block_floor' WHEN o_custkey = 7 THEN 'current_king' WHEN nth > 1 THEN 'seen_hotkey' WHEN o_orderstatus = 'P' THEN 'digest_already_completed' WHEN c.c_custkey IS NULL THEN 'unknown_owner' ELSE 'queued' END AS reason
FROM o LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def submission_gate(spark, table):
    c = table("customer").select("c_custkey")
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table("orders").withColumn("nth", nth).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = [
        ("block_floor", F.col("o_orderkey") <= 100), ("current_king", F.col("o_custkey") == 7), ("seen_hotkey", F.col("nth") > 1),
        ("digest_already_completed", F.col("o_orderstatus") == "P"), ("unknown_owner", F.col("c_custkey").isNull()),
    ]
    return registry.gate(o, rules).select("o_orderkey", "reason")


@query("""WITH f AS (SELECT o_orderkey AS ord, o_custkey::varchar AS hotkey, o_orderpriority AS digest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY nth = 1, digest ORDER BY ord) AS again FROM f)
SELECT ord, hotkey, digest, CASE WHEN nth > 1 THEN 'seen_hotkey' WHEN again > 1 THEN 'digest_already_completed' ELSE 'queued' END AS reason FROM g""")
def queue_fold(spark, table):
    o = table("orders")
    return registry.fold_queue(o.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("hotkey"), F.col("o_orderpriority").alias("digest")))


WINS = "wins AS (SELECT o_orderkey AS id, 'r' || o_custkey AS model_repo FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)"


@query(f"WITH {WINS}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS reign_number, lag(model_repo) OVER (ORDER BY id) AS previous_repo FROM wins) SELECT * FROM n ORDER BY reign_number DESC LIMIT 5")
def succession(spark, table):
    wins = table("orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), "o_custkey").alias("model_repo"))
    return registry.succession(wins, "id").withColumn("reign_number", F.col("reign_number").cast("long"))


@query("""WITH ch AS (SELECT DISTINCT c_custkey AS uid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) SELECT uid, 1.0::double / count(*) OVER () AS weight FROM ch""")
def equal_weights(spark, table):
    c = table("customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("hotkey"), "c_nationkey")
    chain = c.select("hotkey", F.col("uid").alias("place"))
    chain = chain.unionByName(chain)  # every entry twice, once of which counts
    here = c.join(table("nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey")).select("hotkey", "uid")
    return registry.equal_weights(chain, here, 0)


@query("SELECT c_custkey, round(c_acctbal * 300, 6) AS per_hour, round(c_acctbal * 300 * 0.25::double, 4) AS usd_per_hour, round(c_acctbal * 300 / count(*) OVER (), 6) AS equal_per_hour, round(1.0::double / count(*) OVER (), 9) AS weight_share FROM customer")
def payout_view(spark, table):
    return registry.payout(table("customer"), "c_acctbal", 300, 0.25).select("c_custkey", "per_hour", "usd_per_hour", "equal_per_hour", "weight_share")


@query("SELECT o_orderkey, c_custkey AS uid, coalesce(c_mktsegment, 'stored') AS coldkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey")
def history_refresh(spark, table):
    history = table("orders").select("o_orderkey", F.col("o_custkey").alias("hotkey"), F.lit("stored").alias("coldkey"), F.lit(-1).alias("uid"))
    now = table("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("hotkey"), F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("coldkey"))
    return registry.refresh(history, now).select("o_orderkey", "uid", "coldkey")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r = 1 ORDER BY event_id DESC LIMIT 20")
def rearm_newest(spark, table):
    failed = registry.is_failed(F.lit(False), F.col("event_type"), F.lit(None).cast("string"))
    return registry.newest(table("events"), failed, "event_id", 20, "user_id").select("event_id", "user_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 10 = 3 ORDER BY o_orderkey DESC LIMIT 15")
def rearm_by_repo(spark, table):
    return registry.newest(table("orders"), (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 10 == 3), "o_orderkey", 15).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def burn_subtract(spark, table):
    return table("customer").select("c_custkey").join(table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS transient,
CASE event_id % 6 WHEN 0 THEN 'timed out' WHEN 1 THEN 'prefetch_exhausted' WHEN 2 THEN 'dataset_shard_download' WHEN 3 THEN 'eval_server_reported' WHEN 4 THEN '503' ELSE '' END AS label FROM events""")
def error_class(spark, table):
    said = ["Request Timed Out", "prefetch deadline exceeded", "Failed to download shard 3", "Eval server error: x", "HTTP 503", "all is well"]
    message = F.get(F.array(*map(F.lit, said)), (F.col("event_id") % 6).cast("int"))
    return table("events").select("event_id", text.error_class(message).alias("c")).select("event_id", "c.transient", "c.label")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'missing' END END"


def results(table):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "running").otherwise("missing"))
    return table("orders").select("o_orderkey", "o_custkey", status.alias("status"), "o_orderpriority", "o_totalprice")


COUNTS = ", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in boards.STATUSES)


@query(f"SELECT o_orderpriority, count(*) AS requested, {COUNTS} FROM (SELECT *, {STATUS} AS s FROM orders) GROUP BY 1")
def status_totals(spark, table):
    return boards.result_totals(results(table), ["o_orderpriority"])


@query(f"SELECT o_orderpriority, count(*) AS requested, count(*) FILTER (s = 'completed') AS completed, 0::bigint AS completed_no_metric, count(*) FILTER (s <> 'completed') AS failed FROM (SELECT *, {STATUS} AS s FROM orders) GROUP BY 1")
def status_totals_strict(spark, table):
    return boards.strict_totals(results(table), ["o_orderpriority"])


@query(f"""SELECT o_custkey, CASE WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_and(s IN ('completed', 'missing')) THEN CASE WHEN bool_or(s = 'missing') THEN 'missing' ELSE 'completed' END ELSE 'running' END AS overall
FROM (SELECT *, {STATUS} AS s FROM orders) GROUP BY 1""")
def overall_status(spark, table):
    return boards.overall_status(results(table), ["o_custkey"], "running")


@query("""WITH q AS (SELECT o_custkey, o_orderkey, count(*) FILTER (l_returnflag = 'N') AS a, count(*) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_custkey, a, b, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a DESC, b DESC, o_orderkey) AS r FROM q) WHERE r = 1""")
def best_result(spark, table):
    joined = table("orders").join(table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    q = joined.groupBy("o_custkey", "o_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("a"), F.count("*").alias("b"))
    return boards.best_result(q, "o_custkey", ["a", "b"], "o_orderkey")


UPSERT = """WITH a AS (SELECT o_orderkey AS name, o_orderstatus AS status, o_totalprice AS v FROM orders), b AS (SELECT event_id AS name, max(event_type) AS status, sum(value) AS v FROM events GROUP BY 1)
SELECT name, coalesce(b.status, a.status) AS status, round(coalesce({v}), 4) AS v FROM a {how} JOIN b USING (name)"""


def sides(table):
    """Orders by key, whose numbers have gaps, and events by theirs, which have none: names on either side and on both."""
    old = table("orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("v"))
    new = table("events").groupBy(F.col("event_id").alias("name")).agg(F.max("event_type").alias("status"), F.sum("value").alias("v"))
    return old, new


@query(UPSERT.format(v="b.v, a.v", how="FULL"))
def result_upsert(spark, table):
    return boards.upsert(*sides(table), "name", ["status", "v"]).withColumn("v", F.round("v", 4))


@query(UPSERT.format(v="b.v, a.v", how="LEFT"))
def live_overlay(spark, table):
    """Live values over stored ones, for stored rows only."""
    old, new = sides(table)
    return boards.upsert(old, new.join(old.select("name"), "name", "left_semi"), "name", ["status", "v"]).withColumn("v", F.round("v", 4))


def open_work(spark, table):
    names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(boards.BENCHMARKS)], "ord int, name string")
    champions = table("supplier").select(F.col("s_suppkey").alias("champion"))
    label = F.get(F.array(*[F.lit(b[0]) for b in boards.BENCHMARKS]), (F.col("p_size") % 11).cast("int"))
    done = table("part").select((F.col("p_partkey") % 100 + 1).alias("champion"), label.alias("name"), F.when(F.col("p_partkey") % 3 == 0, "failed").otherwise("completed").alias("status"))
    return boards.open_benchmarks(champions, done, names)


OPEN = "nm(ord, name) AS (VALUES " + ", ".join(f"({i}, '{b[0]}')" for i, b in enumerate(boards.BENCHMARKS)) + """),
done AS (SELECT DISTINCT p_partkey % 100 + 1 AS champion, p_size % 11 AS ord FROM part WHERE p_partkey % 3 <> 0),
open AS (SELECT s_suppkey AS champion, string_agg(name, ',' ORDER BY ord) AS missing FROM supplier, nm WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.champion = s_suppkey AND done.ord = nm.ord) GROUP BY 1)"""


@query(f"WITH {OPEN} SELECT champion, missing FROM open")
def benchmark_queue(spark, table):
    return open_work(spark, table).select("champion", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {OPEN} SELECT champion, 'MMLU-Pro' AS benchmarks, 'periodic' AS mode FROM open WHERE contains(missing, 'MMLU-Pro') ORDER BY champion LIMIT 1")
def dispatch_choice(spark, table):
    found = boards.dispatch(open_work(spark, table), "MMLU-Pro", 10, 5)
    return found.select("champion", F.array_join("benchmarks", ",").alias("benchmarks"), "mode")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) > 5 AS evict FROM events")
def retention_keep_recent(spark, table):
    e = table("events").withColumn("id", F.col("event_id"))
    return retention.keep_recent(e, "user_id", "ts", 5).select("event_id", "evict")


@query("""WITH t AS (SELECT sum(n_chars) AS total FROM documents), b AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id FROM b, t WHERE total > 2000000 AND total - before > 0.7 * 2000000""")
def retention_watermark(spark, table):
    return retention.watermark(table("documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 2_000_000).select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 50 AS keep FROM documents")
def lru_keep_n(spark, table):
    return retention.newest_n(table("documents").withColumn("id", F.col("doc_id")), "n_chars", 50).select("doc_id", "keep")


@query("SELECT l_suppkey, arg_max(l_orderkey * 10 + l_linenumber, l_shipdate::varchar || lpad((l_orderkey * 10 + l_linenumber)::varchar, 12, '0')) AS newest FROM lineitem GROUP BY 1")
def newest_result(spark, table):
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table("lineitem").groupBy("l_suppkey").agg(F.max_by(item, F.struct("l_shipdate", item)).alias("newest"))


@query(f"WITH {WINS}, n AS (SELECT *, row_number() OVER (PARTITION BY model_repo ORDER BY id DESC) AS r FROM wins) SELECT id, model_repo, max(id) OVER () = id AS current FROM n WHERE r = 1")
def champion_from_records(spark, table):
    wins = table("orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), "o_custkey").alias("model_repo"))
    last = wins.groupBy("model_repo").agg(F.max("id").alias("id"))
    newest = last.agg(F.max("id").alias("_newest"))
    return last.crossJoin(F.broadcast(newest)).withColumn("current", F.col("_newest") == F.col("id")).drop("_newest")


@query("""WITH h AS (SELECT o_custkey AS k, min(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS tier, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT c_name AS hotkey, tier, row_number() OVER (ORDER BY tier, first) AS place FROM h JOIN customer ON c_custkey = k""")
def dashboard_view(spark, table):
    h = table("orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)).alias("tier"), F.min("o_orderkey").alias("first"))
    named = h.join(table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    placed = sampling.placed(named.withColumn("_rank", F.col("tier") * F.lit(2**60) + F.col("first")), "_rank", "_i")
    return placed.select(F.col("c_name").alias("hotkey"), "tier", (F.col("_i") + 1).cast("long").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_custkey = 10 AND o_orderstatus = 'F')")
def history_rewrite(spark, table):
    h = table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("king_id"), (F.col("o_orderstatus") == "F").alias("failed"))
    return listings.without_failed(h, "10").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_custkey = 10 AND o_orderstatus = 'F') UNION ALL SELECT event_id FROM events WHERE event_type = 'error'")
def history_store(spark, table):
    """A history appended to, then rewritten without one champion's failed rows, each time as one."""
    store = Versions(spark, shared_folder(spark, "history"))
    o = table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("king_id"), (F.col("o_orderstatus") == "F").alias("failed"))
    new = table("events").where("event_type = 'error'").select(F.col("event_id").alias("o_orderkey"), F.concat(F.lit("u"), "user_id").alias("king_id"), F.lit(True).alias("failed"))
    store.flush({"history": o})
    store.flush({"history": store.read("history").unionByName(new)})
    store.flush({"history": listings.without_failed(store.read("history"), "10")})
    return store.read("history").select("o_orderkey")


@query("SELECT '| ' || p_brand || ' | ' || count(*) || ' | ' || max(p_size) || ' |' AS line FROM part GROUP BY p_brand")
def report_rows(spark, table):
    g = table("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("m"))
    return g.select(F.concat(F.lit("| "), F.concat_ws(" | ", "p_brand", F.col("n").cast("string"), F.col("m").cast("string")), F.lit(" |")).alias("line"))


@query("""WITH f AS (SELECT page_id // 4 AS folder, page_id % 4 AS k FROM pages), g AS (SELECT folder, count(*) FILTER (k = 0) AS cfg, count(*) FILTER (k = 1) AS idx, count(*) FILTER (k >= 2) AS sh FROM f GROUP BY 1)
SELECT folder, CASE WHEN cfg = 1 AND idx = 1 AND sh = 2 THEN 'sharded' ELSE 'incomplete' END AS layout, (cfg + idx + sh) * 10 AS bytes FROM g""")
def layout_rule(spark, table):
    names = ["config.json", "model.safetensors.index.json", "model-00001-of-00002.safetensors", "model-00002-of-00002.safetensors"]
    files = table("pages").select(F.floor(F.col("page_id") / 4).alias("folder"), F.get(F.array(*map(F.lit, names)), (F.col("page_id") % 4).cast("int")).alias("name"), F.lit(10).alias("length"))
    return registry.layout(files, "folder")


@query("""WITH a AS (SELECT p_partkey // 2 AS k, max(p_brand) FILTER (p_partkey % 2 = 0) AS b0, max(p_brand) FILTER (p_partkey % 2 = 1) AS b1, max(p_size) FILTER (p_partkey % 2 = 0) AS s0, max(p_size) FILTER (p_partkey % 2 = 1) AS s1 FROM part GROUP BY 1)
SELECT k, CASE WHEN b0 IS DISTINCT FROM b1 THEN 'brand' ELSE 'size' END AS "first", ((b0 <> b1)::int + coalesce((s0 <> s1)::int, 0))::bigint AS n_loose FROM a WHERE b0 IS DISTINCT FROM b1 OR s0 IS DISTINCT FROM s1""".replace("((b0 <> b1)::int", "(coalesce((b0 <> b1)::int, 0)"))
def config_mismatch(spark, table):
    p = table("part").withColumn("k", F.floor(F.col("p_partkey") / 2))
    fields = F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value")))
    side = lambda odd: p.where(F.col("p_partkey") % 2 == odd).select("k", F.explode(fields).alias("f")).select("k", "f.field", "f.value")
    strict = registry.config_mismatches(side(0), side(1), "k", True)
    loose = registry.config_mismatches(side(0), side(1), "k", False).groupBy("k").agg(F.count("*").alias("n_loose"))
    first = registry.first_mismatch(strict, "k", ["brand", "size"]).withColumnRenamed("field", "first")
    return first.join(loose, "k", "left").withColumn("n_loose", F.coalesce("n_loose", F.lit(0).cast("long")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'unexpected file: evil.py' WHEN p_partkey % 4 = 1 THEN 'auto_map keys differ' WHEN p_partkey % 4 = 2 THEN 'auto_map values differ' END AS reason FROM part""")
def config_policy(spark, table):
    k = F.col("p_partkey") % 4
    files = F.when(k == 0, F.array(F.lit("model.py"), F.lit("evil.py"))).otherwise(F.array(F.lit("model.py"), F.lit("a.txt")))
    auto = F.when(k == 1, F.create_map(F.lit("Other"), F.lit("x"))).otherwise(F.create_map(F.lit("AutoModel"), F.when(k == 2, "bad").otherwise("model.M")))
    return table("part").select("p_partkey", registry.code_policy(files, ["model.py"], auto, {"AutoModel": "model.M"}).alias("reason"))


@query("SELECT c_custkey, c_name AS hotkey, n_name AS coldkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def uid_map(spark, table):
    """Positional lists, one for each 256 places, zipped to rows, then the owner's name looked up."""
    c = table("customer").groupBy(F.floor(F.col("c_custkey") / 256)).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey"))).alias("s"))
    field = lambda n: F.transform("s", lambda x: x[n]).alias(n)
    lists = c.select(*map(field, ("c_custkey", "c_name", "c_nationkey")))
    rows = lists.select(F.posexplode(F.arrays_zip("c_custkey", "c_name", "c_nationkey")).alias("place", "z")).select("z.*")
    return rows.join(F.broadcast(table("nation")), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("c_name").alias("hotkey"), F.col("n_name").alias("coldkey"))


@query("SELECT label, task, CASE label WHEN 'ARC-C' THEN 10 ELSE fewshot END AS fewshot FROM (VALUES ('MMLU', 'mmlu', 5), ('ARC-C', 'arc_challenge', 25), ('GSM8K', 'gsm8k', 4)) t(label, task, fewshot)")
def benchmark_select(spark, table):
    chosen = boards.select_benchmarks(boards.registry(spark), ["mmlu", "arc-c", "GSM8K"])
    return boards.override_shots(chosen, {"ARC-C": 10}).select("label", "task", "fewshot")


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN [' mmlu ', 'GSM8K', 'MMLU'] WHEN 1 THEN ['arc_challenge', 'none'] ELSE [] END AS names, o_custkey % 9 AS k FROM orders),
b(name, label, task, fewshot) AS (VALUES ('mmlu', 'MMLU', 'mmlu', 5), ('gsm8k', 'GSM8K', 'gsm8k', 4), ('arc_challenge', 'ARC-C', 'arc_challenge', 25)),
n AS (SELECT DISTINCT o_orderkey, k, lower(trim(unnest(names))) AS name FROM r)
SELECT o_orderkey, label, task, CASE WHEN label = 'GSM8K' THEN k WHEN label IS NOT NULL THEN fewshot END::int AS fewshot, label IS NOT NULL AS known FROM n LEFT JOIN b USING (name)""")
def benchmark_requests(spark, table):
    """Benchmarks that each request names, by label or task in any case, with the shots it sets."""
    k = F.col("o_orderkey") % 3
    lists = F.when(k == 0, F.array(F.lit(" mmlu "), F.lit("GSM8K"), F.lit("MMLU"))).when(k == 1, F.array(F.lit("arc_challenge"), F.lit("none"))).otherwise(F.array().cast("array<string>"))
    shots = F.concat(F.lit("ARC-C=x, gsm8k="), F.col("o_custkey") % 9, F.lit(",MMLU=-3"))
    requests = table("orders").select("o_orderkey", lists.alias("names"), shots.alias("shots"))
    return boards.requested(requests, boards.registry(spark), "o_orderkey", "names", "shots")


@query("SELECT o_orderkey, least(o_custkey, 1000) AS n, o_custkey > 1000 AS capped, greatest(1, o_custkey // 4) AS batch FROM orders")
def limit_clamp(spark, table):
    n = F.col("o_custkey")
    return table("orders").select("o_orderkey", F.least(n, F.lit(1000)).alias("n"), (n > 1000).alias("capped"), F.greatest(F.lit(1), F.floor(n / 4)).alias("batch"))


@query("""SELECT o_orderkey, '{"status":"' || o_orderstatus || '"}' AS meta, 's3://b/' || o_orderkey AS shards FROM orders""")
def meta_without_nulls(spark, table):
    meta = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("gone"), F.lit(None).cast("string"))
    shards = F.filter(F.array(F.concat(F.lit("s3://b/"), F.col("o_orderkey")), F.lit(None)), lambda x: x.isNotNull())
    kept = F.to_json(F.map_filter(meta, lambda k, v: v.isNotNull()))
    return table("orders").select("o_orderkey", kept.alias("meta"), F.array_join(shards, ",").alias("shards"))
