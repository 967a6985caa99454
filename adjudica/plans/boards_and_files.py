"""Queries on listings, registry answers, champion candidates, reports and state documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listings
from ..sources import tensors
from ..sources.shared import shared_folder
from ..sources.views import register_views
from .registry import query

NAMES = ["config.json", "model.safetensors.index.json", "model-00001-of-00002.safetensors", "model-00002-of-00002.safetensors"]


@query("""WITH f AS (SELECT page_id // 4 AS k, page_id % 4 AS n, length(html) AS length FROM pages)
SELECT 'org/m' || k || '--x' AS repo, 'r' || k AS revision, sum(length)::bigint AS bytes, count(*) AS n_files, count(*) = 4 AS complete FROM f GROUP BY k""")
def snapshot_sizes(spark, table):
    """Directory sizes, completeness and the way back from a cache path to its repository."""
    k = F.floor(F.col("page_id") / 4)
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("page_id") % 4).cast("int"))
    path = F.concat(F.lit("/cache/models--org--m"), k, F.lit("--x/snapshots/r"), k, F.lit("/"), name)
    files = table("pages").select(path.alias("path"), F.length("html").alias("length"))
    return listings.snapshot_sizes(files.unionByName(files.limit(1).withColumn("path", F.lit("/cache/other.txt"))))


@query("""WITH a AS (SELECT page_id, 'model.safetensors:' || CASE WHEN page_id % 2 = 0 THEN sha256(url) ELSE md5(url) END AS layers FROM pages)
SELECT 'org/' || page_id AS repo, layers, sha256(layers) AS digest, make_timestamp(2024, 1, (1 + page_id % 28)::int, 0, 0, 0) AS dated, page_id % 3 = 0 AS trusted FROM a""")
def registry_answers(spark, table):
    """Answers of a model registry: nested and other files are no layers, the first readable date counts."""
    p = F.col("page_id")
    lfs = F.when(p % 2 == 0, F.struct(F.concat(F.lit("SHA256:"), F.sha2("url", 256)).alias("sha256")))
    file = lambda name: F.struct(F.lit(name).alias("rfilename"), F.md5("url").alias("blobId"), lfs.alias("lfs"))
    day = F.concat(F.lit("2024-01-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00"))
    body = F.to_json(F.struct(
        F.concat(F.lit("org/"), p).alias("repo"), F.when(p % 3 == 0, F.lit("unknown")).otherwise(day).alias("lastModified"), day.alias("createdAt"),
        F.array(file("model.safetensors"), file("sub/model.safetensors"), file("README.md")).alias("siblings"),
    ))
    found = listings.registry_answers(table("pages").select(body.alias("body")))
    return found.withColumn("dated", F.col("dated").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT 'r' || o_custkey AS repo, o_orderpriority AS digest, 0 AS rank, 'current' AS source, o_orderkey AS reign FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)
UNION ALL SELECT 'r' || o_custkey, o_orderpriority, 1, 'chain', o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'r' || o_custkey, o_orderpriority, 2, 'accepted', 0 FROM orders WHERE o_orderstatus <> 'P')
SELECT repo, digest, arg_min(source, rank) AS source, min(rank)::int AS rank, arg_max(reign, (3 - rank) * 1000000000000 + reign) AS reign FROM e GROUP BY 1, 2""")
def champion_candidates(spark, table):
    """Rows of three sources with names of their own for the same fields."""
    o = table("orders").withColumn("r", F.concat(F.lit("r"), "o_custkey"))
    newest = o.agg(F.max("o_orderkey").alias("o_orderkey"))
    current = o.join(F.broadcast(newest), "o_orderkey").select(F.col("r").alias("model_repo"), F.col("o_orderpriority").alias("king_digest"), F.col("o_orderkey").alias("reign_number"))
    chain = o.where("o_orderstatus = 'P'").select(F.col("r").alias("repo"), F.col("o_orderpriority").alias("digest"), F.col("o_orderkey").alias("reign"))
    accepted = o.where("o_orderstatus <> 'P'").select(F.lit(" ").alias("model_repo"), F.col("r").alias("challenger_repo"), F.col("o_orderpriority").alias("challenger_digest"))
    return listings.champion_candidates(current, chain, accepted).select("repo", "digest", "source", "rank", "reign")


@query("SELECT o_custkey AS repo, o_orderpriority AS digest, max(lpad(o_orderkey::varchar, 12, '0')) AS file FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def accepted_records(spark, table):
    o = table("orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("digest"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return listings.last_records(o).select("repo", "digest", "file")


@query("SELECT lpad(o_orderkey::varchar, 12, '0') AS file, 'path/' || o_custkey AS artifact FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 1")
def newest_artifact(spark, table):
    o = table("orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("path/"), "o_custkey")).otherwise(" ").alias("artifact"))
    return listings.newest_usable(o)


@query("""WITH g AS (SELECT p_brand AS brand, count(*) AS n, max(p_size) AS largest FROM part GROUP BY 1)
SELECT 0 AS line_no, '| brand | n | largest |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL
SELECT (1 + row_number() OVER (ORDER BY brand NULLS FIRST))::int, '| ' || coalesce(brand, '-') || ' | ' || n || ' | ' || coalesce(largest::varchar, '-') || ' |' FROM g""")
def markdown_report(spark, table):
    g = table("part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))
    return listings.markdown(g, ["brand", "n", "largest"], ["brand"])


@query("""WITH r AS (SELECT o_custkey AS model, '{"benchmark":"' || o_orderpriority || '","status":"' || CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END || '","score":' || o_orderkey || '}' AS e, o_orderstatus = 'F' AS done, o_orderpriority AS b, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END AS s, o_orderkey AS k FROM orders)
SELECT model, '{"model":"' || model || '","requested":' || count(*) || ',"completed":' || count(*) FILTER (done) || ',"results":[' || string_agg(e, ',' ORDER BY b, s, k) || ']}' AS document FROM r GROUP BY model""")
def result_documents(spark, table):
    o = table("orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running"))
    return listings.result_document(o.withColumnRenamed("o_custkey", "model"), "model", "o_orderpriority", "o_orderkey", "status")


@query("""SELECT name, n FROM (VALUES ('queue', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')), ('history', (SELECT count(*) FROM orders)), ('king', 0), ('king-backup', 1),
('chain', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')), ('seen_hotkeys', (SELECT count(DISTINCT o_custkey) FROM orders)), ('completed_digests', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')), ('stats', 1)) t(name, n)""")
def state_documents(spark, table):
    """All documents of the state flushed, the champion's then backed up and cleared, and all read again."""
    o, folder = table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), shared_folder(spark, "state")
    king = o.orderBy(F.desc("o_orderkey")).limit(1)
    where = lambda s: o.where(F.col("o_orderstatus") == s)
    documents = {
        "queue": where("O"), "history": o, "king": king, "chain": where("P"), "seen_hotkeys": o.select("o_custkey").distinct(),
        "completed_digests": where("F"), "stats": o.agg(F.count("*").alias("o_orderkey")),
    }
    listings.flush_state(documents, folder)
    listings.reset_champion(spark, folder, o.schema, dry_run=False)
    back = listings.load_state(spark, folder, dict.fromkeys([*documents, "king-backup"], o.schema))
    out = None
    for name, rows in back.items():
        n = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT p_partkey::varchar AS path, 'weight' AS tensor, 'U8' AS dtype, strlen(p_name)::bigint AS n_bytes, sha256(p_name[1:16]) AS sha256 FROM part")
def tensor_headers(spark, table):
    """Containers made from rows, their headers scanned and the first bytes of each tensor digested."""
    header = F.concat(F.lit('{"__metadata__":{},"weight":{"dtype":"U8","shape":['), F.octet_length("p_name"), F.lit('],"data_offsets":[0,'), F.octet_length("p_name"), F.lit("]}}"))
    low = F.unhex(F.concat(F.lpad(F.hex(F.octet_length("h") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.octet_length("h") / 256)), 2, "0"), F.lit("000000000000")))
    files = table("part").select(F.col("p_partkey").cast("string").alias("path"), header.alias("h"), "p_name")
    return tensors.tensor_digests(files.select("path", F.concat(low, F.encode("h", "utf-8"), F.encode("p_name", "utf-8")).alias("content")), 16)


SUMMARY = """SELECT {d}.source, count(*) AS n, sum(CASE WHEN {l}.toxic = 1 THEN 1 ELSE 0 END) AS n_toxic
FROM {d} LEFT JOIN {l} ON {l}.doc_id = {d}.doc_id GROUP BY {d}.source"""


@query(SUMMARY.format(d="documents", l="labels"))
def sql_surface(spark, table):
    """The tables as temporary views, asked in SQL."""
    register_views(spark, [(n, table(n)) for n in ("documents", "labels")], "adjudica_")
    return spark.sql(SUMMARY.format(d="adjudica_documents", l="adjudica_labels"))
