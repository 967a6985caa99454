"""Queries on manifests, listings and file scans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text
from ..operators import manifests, sampling
from ..sources import scans
from ..sources.shared import shared_folder
from .registry import query

SHARDS = r"""sh AS (SELECT source, 'part/' || doc_id || '.npy' AS key, len(regexp_split_to_array(text, '\s+')) AS n_tokens, doc_id FROM documents)"""


def shards(table):
    n = F.size(F.split("text", r"\s+")).cast("long")
    return table("documents").select("source", F.concat(F.lit("part/"), "doc_id", F.lit(".npy")).alias("key"), n.alias("n_tokens"), "doc_id")


@query(f"WITH {SHARDS} SELECT source, count(*) AS total_shards, sum(n_tokens)::bigint AS total_tokens FROM sh GROUP BY 1")
def shard_manifest(spark, table):
    return manifests.totals(shards(table), ["source"])


@query(f"WITH {SHARDS}, p AS (SELECT source, sum(n_tokens + 1)::bigint AS n FROM sh GROUP BY 1) SELECT source, (n // 2048)::bigint AS total_shards, (n // 2048 * 2048)::bigint AS total_tokens FROM p")
def fixed_shards(spark, table):
    total = shards(table).groupBy("source").agg(F.sum(F.col("n_tokens") + 1).alias("n"))
    full = F.floor(F.col("n") / 2048)
    return total.select("source", full.alias("total_shards"), (full * 2048).alias("total_tokens"))


COVER = """SELECT doc_id, CASE WHEN n_chars < 200 THEN 'failed' ELSE 'missing' END AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


@query(COVER)
def manifest_coverage(spark, table):
    docs, seen = table("documents"), table("labels")
    return manifests.coverage(docs.where("n_chars >= 200"), seen, docs.where("n_chars < 200"), "doc_id")


@query(f"WITH {SHARDS}, u AS (SELECT * FROM sh UNION ALL SELECT * FROM sh WHERE doc_id % 100 = 0) SELECT key, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1")
def manifest_merge_check(spark, table):
    s = shards(table)
    return manifests.duplicates(s.unionByName(s.where("doc_id % 100 = 0")), "key")


@query(f"WITH {SHARDS}, o AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS ord FROM (SELECT DISTINCT source FROM sh)) SELECT key, row_number() OVER (ORDER BY ord, key) AS place FROM sh JOIN o USING (source)")
def manifest_order(spark, table):
    s = shards(table)
    order = s.select("source").distinct().withColumn("ord", F.row_number().over(W.orderBy(F.desc("source"))))
    return manifests.in_order(s, order, "key").select("key", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, table):
    return manifests.pending(table("documents").select("doc_id"), table("labels"), "doc_id")


@query("SELECT 'k' || doc_id AS key FROM documents EXCEPT SELECT 'k' || doc_id FROM labels")
def missing_objects(spark, table):
    key = F.concat(F.lit("k"), "doc_id").alias("key")
    return table("documents").select(key).exceptAll(table("labels").select(key))


@query("""WITH w AS (SELECT doc_id, n_chars AS size FROM documents), t AS (SELECT doc_id, n_chars + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS size FROM labels JOIN documents USING (doc_id))
SELECT CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN t.size <> w.size THEN 'wrong_size' ELSE 'ok' END AS state, count(*) AS n FROM w LEFT JOIN t USING (doc_id) GROUP BY 1""")
def listing_sizes(spark, table):
    want = table("documents").select("doc_id", F.col("n_chars").alias("size"))
    there = table("labels").join(want, "doc_id").select("doc_id", (F.col("size") + F.when(F.col("quality") == 0, 1).otherwise(0)).alias("size"))
    return manifests.existing(want, there, "doc_id", "size").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, sum(n_chars)::bigint AS bytes, min(CASE WHEN source LIKE 'src1%' THEN 'mirror/new/' || substr(source, 5) ELSE 'mirror/new/' || source END) AS dest FROM documents GROUP BY 1")
def mirror_manifest(spark, table):
    dest = manifests.destination(F.col("source"), "src1", "mirror/new/")
    return table("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"), F.min(dest).alias("dest"))


@query("SELECT lang, count(*) AS requested, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source = 'src2') AS src2 FROM documents GROUP BY 1")
def run_totals(spark, table):
    return manifests.class_counts(table("documents"), F.col("source"), ["src1", "src2"], ["lang"])


@query("""SELECT CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'b' END AS source, CASE WHEN page_id % 2 = 0 THEN url || '.npy' WHEN page_id % 3 = 0 THEN 'pre/' || page_id || '.npy' ELSE page_id || '.npy' END AS ref,
CASE WHEN page_id % 2 = 0 THEN 64 ELSE 128 END AS seq_len FROM pages WHERE page_id % 5 <> 0""")
def manifest_refs(spark, table):
    """JSON manifests made from rows, parsed and resolved."""
    p = table("pages")
    own = F.when(F.col("page_id") % 2 == 0, F.struct(F.concat("url", F.lit(".npy")).alias("url"), F.lit(None).cast("string").alias("key"), F.lit(64).alias("seq_len")))
    own = own.otherwise(F.struct(F.lit(None).cast("string").alias("url"), F.concat("page_id", F.when(F.col("page_id") % 5 == 0, ".txt").otherwise(".npy")).alias("key"), F.lit(None).cast("int").alias("seq_len")))
    own = F.when(F.col("page_id") % 5 == 0, F.struct(F.lit(None).cast("string").alias("url"), F.lit("x.txt").alias("key"), F.lit(1).alias("seq_len"))).otherwise(own)
    source = F.when(F.col("page_id") % 3 == 0, "a").otherwise("b")
    doc = F.to_json(F.struct(F.when(source == "a", F.lit("pre/")).alias("shard_prefix"), F.lit(128).alias("seq_len"), F.array(own).alias("shards")))
    parsed = p.select(source.alias("source"), F.from_json(doc, scans.manifest_schema()).alias("manifest"))
    return scans.manifest_refs(parsed).select("source", "ref", "seq_len")


@query("SELECT url AS ref FROM pages WHERE page_id % 4 <> 0")
def links_refs(spark, table):
    line = F.when(F.col("page_id") % 8 == 0, "# a comment").when(F.col("page_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit("  extra words")))
    return scans.links(table("pages").select(line.alias("value")))


@query("SELECT source AS name, 'https://host.example.com/b/' || source || '/manifest.json' AS url, (CASE WHEN lang = 'en' THEN 0.5 ELSE 1.0 END)::double AS weight, source AS alias FROM (SELECT DISTINCT source, lang FROM documents) WHERE lang <> 'de'")
def bundle_sources(spark, table):
    s = table("documents").select("source", "lang").distinct()
    entry = F.struct(
        F.col("source").alias("name"), F.concat(F.lit("https://host.example.com/b/"), "source", F.lit("/manifest.json")).alias("manifest_url"),
        F.when(F.col("lang") == "en", 0.5).alias("weight"), F.when(F.col("lang") == "de", False).alias("enabled"),
    )
    return scans.bundle_sources(s.select(F.array(entry).alias("sources")))


@query("WITH f AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT source AS key, (idx - 13 + n) % n AS turn FROM f WHERE (idx - 13 + n) % n < 8")
def raw_file_list(spark, table):
    keys = scans.file_list(None, None, table("documents").select(F.col("source").alias("key")).distinct())
    files = keys.withColumn("idx", F.row_number().over(W.orderBy("key")).cast("long") - 1)
    return sampling.rotate(files, 13, 8).select("key", "turn")


KEYS = "k AS (SELECT url AS key FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 10 = 0)"


@query(f"""WITH {KEYS}, c AS (SELECT key, contains(key, '/en/') AS here, suffix(key, '/') AS fits, key IN ('x') AS ex FROM k)
SELECT count(*) AS seen, count(*) FILTER (NOT here) AS elsewhere, count(*) FILTER (here AND NOT fits) AS other_suffix, count(*) FILTER (here AND fits AND ex) AS excluded, count(*) FILTER (here AND fits AND NOT ex) AS kept, count(DISTINCT key) FILTER (here AND fits AND NOT ex) AS n_distinct FROM c""")
def listing_classes(spark, table):
    p = table("pages").select(F.col("url").alias("key"), "page_id")
    return scans.listing_counters(p.select("key").unionAll(p.where("page_id % 10 = 0").select("key")), "/en/", "/", ["x"])


@query("""WITH f AS (SELECT 'data/' || lang || '/' || doc_id || '.parquet' AS path, lang AS config FROM documents WHERE lang <> 'es'), r AS (SELECT *, CASE config WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 1000000 END AS rk FROM f)
SELECT path, config, row_number() OVER (ORDER BY rk, config, path) AS place FROM r""")
def discover_ordered(spark, table):
    files = table("documents").select(F.concat(F.lit("data/"), "lang", F.lit("/"), "doc_id", F.lit(".parquet")).alias("path"))
    found = scans.discover(files, ["data/en/", "data/fr/", "data/de/"], ["fr", "de"])
    return found.select("path", "config", F.row_number().over(W.orderBy("rank", "config", "path")).cast("long").alias("place"))


@query("SELECT page_id AS id, 'p' AS kind, md5(html) AS digest FROM pages WHERE length(html) >= 50 UNION ALL SELECT doc_id, 'd', md5(text) FROM documents WHERE length(text) >= 50")
def scan_strict_text(spark, table):
    p, d = table("pages"), table("documents")
    a = p.select(F.col("page_id").alias("id"), F.lit("p").alias("kind"), scans.either_text(p.drop("url"), "text", "html").alias("t"))
    b = d.select(F.col("doc_id").alias("id"), F.lit("d").alias("kind"), F.col(scans.text_column(d, "text", strict=True)).alias("t"))
    return a.unionByName(b).where(F.length("t") >= 50).select("id", "kind", F.md5("t").alias("digest"))


@query("SELECT 'pages' AS name, count(*) AS n, sum(length(url))::bigint AS chars FROM pages WHERE url <> '' UNION ALL SELECT 'documents', count(*), sum(length(text))::bigint FROM documents WHERE text <> ''")
def text_fallback_column(spark, table):
    """pages has none of the preferred columns, so its first string column is read."""
    count = lambda name: scans.texts(table(name), "body", scans.TEXT_COLUMNS).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return count("pages").unionByName(count("documents"))


def written(spark, table, tail: str):
    """A shard of token ids per source, written below the shared folder."""
    folder = shared_folder(spark, tail)
    ids = F.transform(F.split("text", r"\s+"), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("long"))
    rows = table("documents").select("source", F.col("doc_id").alias("ord"), F.concat(ids, F.array(F.lit(0).cast("long"))).alias("tokens"))
    return folder, rows


@query(r"SELECT source AS source_file, source || '.npy' AS key, sum(len(regexp_split_to_array(text, '\s+')) + 1)::bigint AS n_tokens FROM documents GROUP BY 1")
def npy_per_source(spark, table):
    from ..sources import npytok

    folder, rows = written(spark, table, "streams")
    return npytok.write_shards(rows, folder).select("source_file", "key", "n_tokens")


@query("SELECT o_orderstatus, count(*) * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS n FROM orders GROUP BY 1")
def state_tables(spark, table):
    """State written as JSON and read again, appended to and counted."""
    path = shared_folder(spark, "state")
    o = table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    o.write.mode("overwrite").json(path)
    o.where("o_orderstatus = 'F'").write.mode("append").json(path)
    back = spark.read.schema(T.StructType(o.schema.fields)).json(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT max(o_orderkey)::varchar AS king FROM orders WHERE o_orderstatus = 'F')
SELECT 'backup' AS kind, king, 1 AS reign FROM k UNION ALL SELECT 'cleared', NULL, 0 FROM k""")
def state_reset(spark, table):
    """Backup of the champion's state, and the cleared state beside it."""
    o = table("orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderkey")).limit(1)
    backup = o.select(F.lit("backup").alias("kind"), F.col("o_orderkey").cast("string").alias("king"), F.lit(1).alias("reign"))
    return backup.unionByName(o.select(F.lit("cleared").alias("kind"), F.lit(None).cast("string").alias("king"), F.lit(0).alias("reign")))


@query("SELECT '/' || lang || '/' || source AS folder, sum(n_chars)::bigint AS bytes, count(*) AS files FROM documents GROUP BY 1")
def cache_listing(spark, table):
    files = table("documents").select(F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".npy")).alias("path"), F.col("n_chars").alias("length"))
    kept = files.where(F.rlike("path", F.lit(r"\.npy(\.tmp)?$")))
    return kept.groupBy(F.regexp_extract("path", r"^(/[^/]+/[^/]+)/", 1).alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


@query("SELECT source, coalesce(CASE WHEN doc_id % 2 = 0 THEN sha256(text) END, md5(text)) AS digest, doc_id FROM documents")
def hub_digests(spark, table):
    lfs = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SHA256:"), F.sha2("text", 256)))
    d = text.plain_digest(F.coalesce(lfs, F.md5("text")))
    return table("documents").select("source", d.alias("digest"), "doc_id")
