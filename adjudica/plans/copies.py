"""Queries on fingerprints, digests and parameter statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import fingerprint as fp
from .registry import query

LP = """lp AS (SELECT vec_id, label, list_transform(e, lambda v: v - (ln(list_sum(list_transform(e, lambda w: exp(w - m)))) + m)) AS lp
FROM (SELECT vec_id, label, embedding::double[] AS e, list_max(embedding)::double AS m FROM embeddings))"""
JS = LP + """, ex AS (SELECT a.vec_id, a.label, unnest(a.lp) AS p, unnest(b.lp) AS q FROM lp a JOIN lp b ON b.vec_id = a.vec_id + 1),
mid AS (SELECT *, greatest(p, q) + ln(1 + exp(-abs(p - q))) - ln(2) AS m FROM ex),
met AS (SELECT vec_id, label, greatest(0.5 * sum(exp(p) * (p - m) + exp(q) * (q - m)), 0) AS js, 0.5 * sum((exp(p) - exp(q)) * (p - q)) AS kl, 0.5 * sum(abs(exp(p) - exp(q))) AS tv FROM mid GROUP BY 1, 2),
top AS (SELECT a.vec_id, (list_position(a.lp, list_max(a.lp)) = list_position(b.lp, list_max(b.lp)))::int::double AS top1 FROM lp a JOIN lp b ON b.vec_id = a.vec_id + 1)"""


def neighbours(table):
    """Each vector beside the one of the next id."""
    lp = fp.with_log_probabilities(table("embeddings"), "embedding").select("vec_id", "label", "lp")
    a = lp.withColumnRenamed("lp", "lp_a")
    b = lp.select((F.col("vec_id") - 1).alias("vec_id"), F.col("lp").alias("lp_b"))
    return fp.distances(a.join(b, "vec_id"))


@query(f"WITH {JS} SELECT vec_id, round(js, 9) AS js, round(kl, 9) AS kl, round(tv, 9) AS tv, top1 FROM met JOIN top USING (vec_id)")
def js_pairs(spark, table):
    return neighbours(table).select("vec_id", *[F.round(c, 9).alias(c) for c in ("js", "kl", "tv")], "top1")


@query(f"WITH {JS} SELECT label, round(avg(js), 9) AS mean, round(quantile_cont(js, 0.5), 9) AS p50, round(quantile_cont(js, 0.95), 9) AS p95, round(max(js), 9) AS max FROM met GROUP BY 1")
def js_summary(spark, table):
    s = fp.summary(neighbours(table), "js", ["label"])
    return s.select("label", *[F.round(c, 9).alias(c) for c in ("mean", "p50", "p95", "max")])


@query(f"""WITH {LP}, st AS (SELECT vec_id AS stored_id, lp AS lq FROM lp ORDER BY vec_id DESC LIMIT 100), ca AS (SELECT vec_id AS candidate_id, lp FROM lp WHERE vec_id NOT IN (SELECT stored_id FROM st)),
ex AS (SELECT candidate_id, stored_id, unnest(lp) AS p, unnest(lq) AS q FROM ca, st), mid AS (SELECT *, greatest(p, q) + ln(1 + exp(-abs(p - q))) - ln(2) AS m FROM ex),
met AS (SELECT candidate_id, stored_id, round(greatest(0.5 * sum(exp(p) * (p - m) + exp(q) * (q - m)), 0), 12) AS js FROM mid GROUP BY 1, 2)
SELECT candidate_id, stored_id, round(js, 9) AS js FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY js, stored_id DESC) AS r FROM met) WHERE r = 1""")
def copy_closest(spark, table):
    """The newest 100 are the bank, all others are candidates."""
    lp = fp.with_log_probabilities(table("embeddings"), "embedding")
    bank = table("embeddings").select("vec_id").orderBy(F.desc("vec_id")).limit(100)
    stored = lp.join(F.broadcast(bank), "vec_id", "left_semi").select(F.col("vec_id").alias("stored_id"), F.col("lp").alias("lp_b"))
    return fp.closest(lp.join(F.broadcast(bank), "vec_id", "left_anti").select(F.col("vec_id").alias("candidate_id"), F.col("lp").alias("lp_a")), stored)


def arrivals(table):
    v = table("embeddings")
    return v.select(F.lit("v1").alias("version"), F.col("label").cast("string").alias("key_id"), F.col("vec_id").alias("ord"), F.concat(F.lit("d"), F.col("vec_id")).alias("digest"), F.concat(F.lit("s"), F.col("vec_id")).alias("submission"), F.col("embedding").alias("logits"))


@query()
def copy_families(spark, table):
    return fp.fold_bank(arrivals(table), ["version", "key_id"], limit=0.05)


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id DESC LIMIT 100")
def bank_trim(spark, table):
    return fp.trim_bank(table("embeddings").select("vec_id", "label"), 100, "vec_id")


@query("SELECT vec_id AS id, label::varchar AS key_id, count(*) OVER (PARTITION BY label) AS family_size, 128 AS bytes, CASE WHEN vec_id % 3 = 1 THEN 'payload has the wrong size' WHEN vec_id % 3 = 2 THEN 'payload does not match its digest' END AS refused, vec_id % 3 = 0 AS close FROM embeddings")
def bank_table(spark, table):
    """Rows in the bank's schema with family sizes; payloads read back, of which a third is cut and a third is altered."""
    import numpy as np
    import pandas as pd

    encode, decode = fp.encode, fp.decode

    def stored(batches):
        for pdf in batches:
            payload = [encode(np.asarray(x)) for x in pdf["embedding"]]
            yield pdf[["vec_id", "label", "embedding"]].assign(logits=[p for p, _ in payload], logits_sha256=[d for _, d in payload])

    def read(batches):
        for pdf in batches:
            rows = []
            for i, x, raw, digest in zip(pdf["vec_id"], pdf["embedding"], pdf["logits"], pdf["logits_sha256"], strict=True):
                sent = raw[:-2] if i % 3 == 1 else bytes([raw[0] ^ 1]) + raw[1:] if i % 3 == 2 else raw
                try:
                    rows.append((i, None, bool(np.allclose(decode(sent, 1, len(x), digest)[0], x, atol=1e-2))))
                except ValueError as e:
                    rows.append((i, str(e), False))
            yield pd.DataFrame(rows, columns=["id", "refused", "close"])

    bank = table("embeddings").mapInPandas(stored, "vec_id long, label int, embedding array<float>, logits binary, logits_sha256 string")
    told = bank.mapInPandas(read, "id long, refused string, close boolean")
    sizes = fp.family_sizes(bank, "label")
    held = bank.join(sizes, "label").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("key_id"), "family_size", F.octet_length("logits").alias("bytes"))
    return held.join(told, "id")


NORM = "SELECT round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) AS norm FROM embeddings"


def l2():
    return F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, v: a + v))


@query(f"WITH v AS ({NORM}), c AS (SELECT norm, count(*) AS n FROM v GROUP BY 1) SELECT norm, n, round(n / sum(n) OVER (), 6) AS share FROM c ORDER BY n DESC, norm LIMIT 1")
def norm_clustering(spark, table):
    return fp.modal_share(table("embeddings"), l2())


PARAMETERS = ["model.layers.0.self_attn.q_proj.weight", "model.embed_tokens.weight", "lm_head.weight", "layers.1.mlp.up_proj.weight", "layers.2.ln1.weight", "layers.3.moe.router.weight", "layers.4.fc1.bias", "other.bias"]
NAMES = "list_value(" + ", ".join(f"'{p}'" for p in PARAMETERS) + ")"
BUCKETS = "CASE n WHEN 0 THEN 'attn' WHEN 1 THEN 'embed' WHEN 2 THEN 'lm_head' WHEN 3 THEN 'ffn' WHEN 4 THEN 'norm' WHEN 5 THEN 'moe_router' WHEN 6 THEN 'ffn' ELSE 'bias' END"


def name_of(key):
    return F.get(F.array(*map(F.lit, PARAMETERS)), (F.col(key) % len(PARAMETERS)).cast("int"))


@query(f"SELECT {BUCKETS} AS bucket, round(sqrt(sum(v * v)), 6) AS norm FROM (SELECT vec_id % 8 AS n, unnest(embedding)::double AS v FROM embeddings) GROUP BY 1")
def bucket_norms(spark, table):
    long = table("embeddings").select(name_of("vec_id").alias("name"), F.explode("embedding").alias("value")).withColumn("value", F.col("value").cast("double"))
    return fp.bucket_norms(long, "name", "value")


@query("""SELECT CASE n WHEN 0 THEN 'attn' WHEN 1 THEN 'embed' WHEN 2 THEN 'lm_head' WHEN 3 THEN 'attn' WHEN 4 THEN 'norm' WHEN 5 THEN 'moe_router' ELSE 'other' END AS bucket,
sum(p_size)::bigint AS total, sum(CASE WHEN n = 5 THEN p_size // 8 * 2 ELSE p_size END)::bigint AS active FROM (SELECT p_partkey % 8 AS n, p_size FROM part) GROUP BY 1""")
def param_buckets(spark, table):
    """Totals and active totals by bucket; experts count as two of eight."""
    named = table("part").withColumn("bucket", fp.bucket(name_of("p_partkey"), fp.SIZE_BUCKETS))
    active = F.when(F.col("bucket") == "moe_router", F.floor(F.col("p_size") / 8) * 2).otherwise(F.col("p_size"))
    return named.groupBy("bucket").agg(F.sum("p_size").alias("total"), F.sum(active).cast("long").alias("active"))


@query("""WITH s AS (SELECT vec_id AS step, label, embedding[1]::double AS loss, abs(embedding[2])::double AS norm FROM embeddings)
SELECT label, arg_min(loss, step) AS first_loss, min(loss) AS min_loss, max(loss) AS max_loss, max(norm) AS max_norm, false AS non_finite, max(norm) <= 3 AND max(loss) <= arg_min(loss, step) + 4 AS ok FROM s GROUP BY 1""")
def probe_verdict(spark, table):
    steps = table("embeddings").select(F.col("vec_id").alias("step"), "label", F.get("embedding", F.lit(0)).cast("double").alias("loss"), F.abs(F.get("embedding", F.lit(1)).cast("double")).alias("norm"))
    per = steps.groupBy("label").agg(F.min_by("loss", "step").alias("first_loss"), F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"), F.max("norm").alias("max_norm"), F.bool_or(F.isnan("loss")).alias("non_finite"))
    return per.withColumn("ok", ~F.col("non_finite") & (F.col("max_norm") <= 3) & (F.col("max_loss") <= F.col("first_loss") + 4))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, table):
    d = table("documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""WITH d AS (SELECT source, doc_id::varchar AS name, sha256(text) AS h FROM documents)
SELECT source, sha256(string_agg(name || ':' || h, ';' ORDER BY name)) AS digest, sha256(string_agg(h, '' ORDER BY name)) AS plain, count(*) AS n FROM d GROUP BY 1""")
def digest_of_digests(spark, table):
    """Digest of named digests, whatever order they come in; one list per source, bounded by its files."""
    d = table("documents").select("source", F.struct(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("h")).alias("s"))
    g = d.groupBy("source").agg(F.array_sort(F.collect_list("s")).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: F.concat(x["name"], F.lit(":"), x["h"])), ";")
    return g.select("source", F.sha2(joined, 256).alias("digest"), F.sha2(F.array_join(F.transform("s", lambda x: x["h"]), ""), 256).alias("plain"), F.size("s").cast("long").alias("n"))


@query("SELECT lang, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def concat_hash(spark, table):
    d = table("documents").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))).alias("s"))
    return d.select("lang", F.sha2(F.array_join(F.transform("s", lambda x: x["h"]), ""), 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS uses, count(*) >= 3 AS at_limit FROM documents GROUP BY 1 HAVING count(*) > 1")
def digest_reuse_limit(spark, table):
    d = table("documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("uses")).where("uses > 1")
    return d.withColumn("at_limit", F.col("uses") >= 3)


@query("""WITH x AS (SELECT p_brand AS name, count(DISTINCT p_size) AS na, min(p_size) AS a FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), y AS (SELECT p_brand AS name, min(p_size) AS b FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT count(*) AS n_common, (SELECT count(*) FROM x) AS n_left, count(*) FILTER (a = b) AS n_equal, 2 * count(*) >= (SELECT count(*) FROM x) AS enough, bool_and(a = b) AS copied FROM x JOIN y USING (name)""")
def tensor_sample_compare(spark, table):
    """Named values on both sides: copies if at least half the names meet and all of those agree."""
    side = lambda odd, v: table("part").where(F.col("p_partkey") % 2 == odd).groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").alias(v))
    a, b = side(0, "a"), side(1, "b")
    met = a.join(b, "name").agg(F.count("*").alias("n_common"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"), F.bool_and(F.col("a") == F.col("b")).alias("copied"))
    return met.crossJoin(a.agg(F.count("*").alias("n_left"))).withColumn("enough", F.col("n_common") * 2 >= F.col("n_left"))
