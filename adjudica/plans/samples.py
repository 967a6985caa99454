"""Queries on quotas, samples, packing and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import hashing, text
from ..operators import packing, sampling
from .registry import query

# Weights of the demonstration: patterns over source names, tried in order.
PATTERNS = [("src1", 0.5), ("src2", 0.3), ("src0", 0.1)]


def sources(table):
    s = table("documents").select("source").distinct()
    return s.withColumn("idx", F.row_number().over(W.orderBy("source")) - 1)


SOURCES = "src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx FROM (SELECT DISTINCT source FROM documents))"
WEIGHTED = f"""{SOURCES}, wt AS (SELECT *, 1.0 + idx % 3 AS weight FROM src),
raw AS (SELECT *, 107.0::double * weight / sum(weight) OVER () AS r FROM wt),
quota AS (SELECT source, idx, weight::double AS weight, (floor(r) + CASE WHEN row_number() OVER (ORDER BY r - floor(r) DESC, idx) <= 107 - sum(floor(r)) OVER () THEN 1 ELSE 0 END)::bigint AS quota FROM raw)"""


def weighted(table):
    return sampling.weighted_quotas(sources(table).withColumn("weight", 1.0 + F.col("idx") % 3), 107)


@query(f"WITH {SOURCES} SELECT source, idx, (107 // count(*) OVER () + CASE WHEN idx < 107 % count(*) OVER () THEN 1 ELSE 0 END)::bigint AS quota FROM src")
def quota_equal(spark, table):
    return sampling.equal_quotas(sources(table), 107)


@query(f"WITH {WEIGHTED} SELECT * FROM quota")
def quota_weighted(spark, table):
    return weighted(table)


@query("""WITH s AS (SELECT DISTINCT source FROM documents)
SELECT source, (CASE WHEN contains(source, 'src1') THEN 0.5 WHEN contains(source, 'src2') THEN 0.3 WHEN contains(source, 'src0') THEN 0.1 ELSE 1.0 / count(*) OVER () END)::double AS weight FROM s""")
def weight_pattern_match(spark, table):
    return sampling.pattern_weights(table("documents").select("source").distinct(), PATTERNS)


@query(f"""WITH {WEIGHTED}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || doc_id), doc_id) AS k FROM documents)
SELECT source, doc_id FROM r JOIN quota USING (source) WHERE k <= quota""")
def balanced_sample(spark, table):
    rows = table("documents").select("source", "doc_id")
    return sampling.quota_sample(rows, weighted(table).select("source", "quota"), "s", "doc_id")


SAMPLE = "smp AS (SELECT doc_id, row_number() OVER (ORDER BY md5('s|' || doc_id), doc_id) AS place FROM documents ORDER BY place LIMIT 50)"


@query(f"WITH {SAMPLE} SELECT * FROM smp")
def sample_without_replacement(spark, table):
    return sampling.sample(table("documents").select("doc_id"), 50, "s", "doc_id").select("doc_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {SAMPLE} SELECT sha256(string_agg(doc_id::varchar, ',' ORDER BY place)) AS digest, count(*) AS n FROM smp")
def sample_digest(spark, table):
    return sampling.ids_digest(sampling.sample(table("documents").select("doc_id"), 50, "s", "doc_id"), "doc_id", "place")


@query()
def holdout_sample(spark, table):
    """Indices of NumPy's generator, joined to rows by place, with their digest."""
    n = table("documents").count()
    picked = sampling.exact_choice(n, 64, 7)
    index = spark.createDataFrame([(int(i), k) for k, i in enumerate(picked)], "i long, k int")
    rows = sampling.placed(table("documents").select("doc_id"), "doc_id")
    return rows.join(F.broadcast(index), "i").withColumn("digest", F.lit(sampling.array_digest(picked)))


@query(r"""WITH t AS (SELECT doc_id, text, length(text) AS n, substr(text, 1, 200) AS head FROM documents WHERE length(text) >= 100),
p AS (SELECT *, CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') ELSE -1 END AS sp FROM t)
SELECT doc_id, CASE WHEN n > 200 AND sp > 100 THEN substr(head, 1, sp) WHEN n > 200 THEN head ELSE text END AS text FROM p""")
def text_filter_truncate(spark, table):
    kept = table("documents").where(F.length("text") >= 100)
    return kept.select("doc_id", text.cut_at_space(F.col("text"), 200).alias("text"))


TOKENS = r"tk AS (SELECT doc_id, source, regexp_split_to_array(text, '\s+') AS tokens FROM documents)"
OFFSETS = f"{TOKENS}, off AS (SELECT doc_id, source, tokens, len(tokens) + 1 AS n, (sum(len(tokens) + 1) OVER (PARTITION BY source ORDER BY doc_id))::bigint AS \"end\" FROM tk)"


def token_rows(table):
    return table("documents").select("doc_id", "source", packing.words(F.col("text")).alias("tokens"))


@query(f'WITH {OFFSETS} SELECT doc_id, source, n, "end" - n AS start, "end" FROM off')
def token_offsets(spark, table):
    return packing.token_offsets(token_rows(table), ["source"], ["doc_id"]).drop("tokens")


PACKED = f"""{OFFSETS}, ev AS (SELECT source, "end" - n + k AS o, token FROM (SELECT source, "end", n, unnest(list_append(tokens, '</s>')) AS token, unnest(range(n)) AS k FROM off)),
win AS (SELECT source, o // 2048 AS "window", count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY o)) AS digest FROM ev GROUP BY ALL)"""


@query(f'WITH {PACKED} SELECT source, "window"::bigint AS "window", n_tokens, digest FROM win')
def pack_windows(spark, table):
    packed = packing.pack(token_rows(table), ["source"], ["doc_id"], 2048)
    return packed.select("source", "window", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f'WITH {PACKED} SELECT source, "window"::bigint AS "window", n_tokens, digest FROM win WHERE n_tokens = 2048')
def pack_windows_no_tail(spark, table):
    packed = packing.pack(token_rows(table), ["source"], ["doc_id"], 2048, keep_tail=False)
    return packed.select("source", "window", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS w FROM conversations),
s AS (SELECT conv_id, string_agg(array_to_string(w, ' ') || ' </s>', ' ' ORDER BY turn) AS all_tokens, sum(len(w) + 1)::bigint AS n FROM t GROUP BY 1),
x AS (SELECT conv_id, regexp_split_to_array(all_tokens, ' ') AS a FROM s)
SELECT conv_id, (k // 32)::bigint AS "window", count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY k)) AS digest
FROM (SELECT conv_id, unnest(a) AS token, unnest(range(len(a))) AS k FROM x) GROUP BY 1, 2""")
def pack_conversations(spark, table):
    rows = table("conversations").select("conv_id", "turn", packing.words(F.col("text")).alias("tokens"))
    packed = packing.pack(rows, ["conv_id"], ["turn"], 32)
    return packed.select("conv_id", "window", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("""WITH f AS (SELECT source, doc_id, list(doc_id) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS frame FROM documents)
SELECT source, doc_id, array_to_string(frame, ',') AS frame FROM f WHERE len(frame) = 4""")
def merge_records(spark, table):
    merged = packing.merge_records(table("documents").select("source", "doc_id"), ["source"], "doc_id", 4, "doc_id")
    return merged.select("source", "doc_id", F.array_join(F.transform("frame", lambda x: x.cast("string")), ",").alias("frame"))


@query("""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::double + 4) * 1000)::bigint) AS tokens FROM embeddings)
SELECT count(*) AS n, count(*) FILTER (list_max(tokens) < 6000) AS n_kept, count(*) FILTER (list_max(tokens) >= 6000) AS n_beyond, count(*) FILTER (len(tokens) <> 64) AS n_wrong_length FROM t""")
def vocab_bound(spark, table):
    rows = token_lists(table)
    kept = packing.vocabulary_bound(rows, "tokens", 6000).agg(F.count("*").alias("n_kept"))
    bad = packing.violations(rows, "tokens", 64, 6000).select("n_beyond", "n_wrong_length")
    return rows.agg(F.count("*").alias("n")).crossJoin(kept).crossJoin(bad)


def token_lists(table):
    return table("embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 4) * 1000)).alias("tokens"))


@query("SELECT vec_id, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: floor((x::double + 4) * 1000)::bigint))::bigint AS total FROM embeddings WHERE len(embedding) > 0")
def scan_token_lists(spark, table):
    from ..sources.scans import token_lists as scan

    rows = scan(token_lists(table), "tokens", keep=["vec_id"])
    return rows.select("vec_id", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""WITH i AS (SELECT DISTINCT o_orderkey AS k FROM orders), g AS (SELECT k, CASE WHEN k - lag(k) OVER (ORDER BY k) <= 8 THEN 0 ELSE 1 END AS new FROM i),
r AS (SELECT k, sum(new) OVER (ORDER BY k) AS run FROM g) SELECT min(k) AS "first", max(k) AS "last", count(*) AS n FROM r GROUP BY run""")
def range_coalesce(spark, table):
    keys = table("orders").select(F.col("o_orderkey").alias("k")).distinct()
    return packing.merge_ranges(keys, "k", 8)


@query("WITH x AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM x) SELECT source, n AS \"count\", before, least(n, 333 - before)::bigint AS taken FROM b WHERE before < 333")
def prefix_until_n(spark, table):
    parts = table("documents").groupBy("source").agg(F.count("*").alias("count"))
    return sampling.take_until(parts, 333, "source")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::int AS part FROM documents")
def partition_round_robin(spark, table):
    return sampling.round_robin(table("documents").select("doc_id"), "doc_id", 7)


@query("SELECT doc_id, (ntile(7) OVER (ORDER BY doc_id) - 1)::int AS part FROM documents")
def partition_contiguous(spark, table):
    return sampling.contiguous(table("documents").select("doc_id"), "doc_id", 7)


GREEDY = """WITH RECURSIVE f AS (SELECT source || '/' || lang AS key, sum(n_chars)::bigint AS size FROM documents GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, key) AS r FROM f),
g AS (SELECT 0::bigint AS r, ''::varchar AS key, 0::bigint AS size, 0 AS bin, [0, 0, 0, 0]::bigint[] AS loads UNION ALL
SELECT r, key, size, b - 1, list_transform(loads, lambda x, i: CASE WHEN i = b THEN x + size ELSE x END) FROM
(SELECT o.*, g.loads, list_position(g.loads, list_min(g.loads))::int AS b FROM g JOIN o ON o.r = g.r + 1))
SELECT key, size, bin FROM g WHERE r > 0"""


@query(GREEDY)
def partition_greedy(spark, table):
    files = table("documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("size"))
    return sampling.greedy_bins(files.select(F.concat_ws("/", "source", "lang").alias("key"), "size"), 4)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'base_seed=' || o_custkey ELSE 'block_hash=' || o_orderkey || '|hotkey=' || o_orderstatus || '|base_seed=' || o_custkey END AS material FROM orders""")
def seed_material(spark, table):
    block = F.when(F.col("o_orderkey") % 10 == 0, "default").when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderkey").cast("string"))
    return table("orders").select("o_orderkey", hashing.seed_material(block, F.col("o_orderstatus"), F.col("o_custkey")).alias("material"))


@query()
def seed_integers(spark, table):
    of = hashing.source_seed

    def seeds(batches):
        for pdf in batches:
            yield pdf.assign(seed=[of(42, s) % 2**63 for s in pdf["source"]])

    made = table("documents").select("source").distinct().mapInPandas(seeds, "source string, seed long")
    return made.withColumn("mixed", hashing.iteration_seed(F.length("source")))


@query()
def probe_plan(spark, table):
    tokens = sampling.probe_tokens(1000, 4, 16, 11)
    hidden, at, key = sampling.private_plan(1000, b"secret of this test", 4, 16, 3)
    rows = [(i, [int(x) for x in r], [int(p) for p in at], key, sampling.array_digest(tokens)) for i, r in enumerate(tokens)]
    return spark.createDataFrame(rows, "row int, tokens array<long>, positions array<long>, key_id string, digest string")


@query()
def probe_plans(spark, table):
    """A public probe and a private plan for every submission: tokens by its number, positions by a keyed seed; digests of both."""
    return sampling.probe_plans(table("orders").select(F.col("o_orderkey").alias("id")), b"secret of this test", 1000, 4, 16, 3)


@query("WITH l AS (SELECT doc_id AS seq_idx, quality FROM labels), n AS (SELECT *, row_number() OVER (ORDER BY seq_idx) - 1 AS i FROM l) SELECT seq_idx, ((i // 16) % 4)::int AS device, quality FROM n")
def scatter_gather(spark, table):
    """Batches go round the devices; results come back by sequence."""
    rows = sampling.placed(table("labels").select(F.col("doc_id").alias("seq_idx"), "quality"), "seq_idx")
    sent = rows.select("seq_idx", (packing.batch_of(F.col("i"), 16) % 4).cast("int").alias("device")).repartition(4, "device")
    return sent.join(rows.select("seq_idx", "quality"), "seq_idx")


@query("SELECT 'documents' AS label, doc_id AS id FROM documents UNION ALL SELECT 'pages', page_id FROM pages")
def source_union(spark, table):
    a = table("documents").select(F.lit("documents").alias("label"), F.col("doc_id").alias("id"))
    return a.unionByName(table("pages").select(F.lit("pages").alias("label"), F.col("page_id").alias("id")))


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1")
def first_occurrence(spark, table):
    return table("events").groupBy("user_id").agg(F.min("event_id").alias("first_event"))
