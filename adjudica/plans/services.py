"""Queries on duels as a service and on the ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duel, evaluation
from ..operators.ingest import Plan, ingest
from ..sources.shared import shared_folder
from ..streaming import events as ev
from .duels import DIFFS, PAIRS, RUNNING, boot
from .registry import query

REQUEST = evaluation.DuelRequest("king/model", "miner/model", seq_len=1_000_000, min_chars=0, strategy="all", n_bootstrap=1000, bootstrap_seed=0, batch_size=64, early_stop=False)


def run(spark, table, request):
    """The folder and id of a duel between the two cohort models."""
    folder, labels = shared_folder(spark, "duels"), table("labels")
    rows = table("documents").select("doc_id", "source", "text")
    return folder, evaluation.run_duel(spark, request, rows, lambda d: duel.cohort_scores(d, labels), folder)


VERDICT = f"""WITH {PAIRS}, {DIFFS}, {boot("diffs", 1000, 0)},
l AS (SELECT quantile_cont(mean, 0.001) AS lcb FROM means), o AS (SELECT count(*) AS n_sequences, avg(champion_loss - challenger_loss) AS m FROM pairs)
SELECT 'completed' AS state, n_sequences AS done, lcb > 0.0015 AS accepted, round(m, 6) AS mu_hat, round(lcb, 6) AS lcb, n_sequences, false AS stopped_early FROM o, l"""


@query(VERDICT)
def run_duel(spark, table):
    """A request run to its end, then looked up by id."""
    found = evaluation.evaluation(spark, *run(spark, table, REQUEST))
    return found.select("state", "done", "accepted", "mu_hat", "lcb", "n_sequences", "stopped_early")


@query(f"""WITH {PAIRS}, {RUNNING}, m AS (SELECT batch::bigint + 1 AS ord, (sum(n) OVER w)::bigint AS done, round(sum(d) OVER w / sum(n) OVER w, 6) AS mu_hat FROM per WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING))
SELECT ord, 'progress' AS type, done, mu_hat FROM m UNION ALL SELECT 0, 'started', NULL, NULL UNION ALL SELECT 2147483648, 'verdict', NULL, NULL""")
def duel_progress(spark, table):
    """Events of a run, read as a stream."""
    folder, _ = run(spark, table, REQUEST)
    return ev.drain(evaluation.progress(spark, folder).select("ord", "type", "done", "mu_hat"), "progress", "append")


@query("""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents)),
q AS (SELECT source, 120 // k + CASE WHEN idx < 120 % k THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3610|' || doc_id), doc_id) AS nth FROM documents WHERE length(text) >= 128)
SELECT source, count(*) AS n FROM r JOIN q USING (source) WHERE nth <= quota GROUP BY 1""")
def multi_source_sample(spark, table):
    """The sample of a request over several sources, by its strategy."""
    request = evaluation.MultiSourceRequest("king/model", "miner/model", n=120)
    request.check()
    rows = table("documents").select("doc_id", "source", "text").where(F.length("text") >= request.min_chars)
    return evaluation.SAMPLERS[request.strategy](rows, request).groupBy("source").agg(F.count("*").alias("n"))


SEEDED = """SELECT '{block}' AS block_hash, doc_id, least(len(regexp_split_to_array(text, '\\s+')), 24)::int AS n_words FROM
(SELECT *, row_number() OVER (ORDER BY md5('block_hash={block}|hotkey=5Fx|base_seed=3610|' || doc_id), doc_id) AS r FROM documents WHERE length(text) >= 128) WHERE r <= 100"""


@query(" UNION ALL ".join(SEEDED.format(block=b) for b in ("0xaa", "0xbb")))
def duel_sequences(spark, table):
    """Samples of one submitter at two blocks: other documents, each cut to the length that is asked for."""
    out = None
    for block in ("0xaa", "0xbb"):
        request = evaluation.DuelRequest("king/model", "miner/model", block_hash=block, hotkey="5Fx", seq_len=12, seq_len_multiplier=2, n=100)
        found = evaluation.sequences(table("documents").select("doc_id", "source", "text"), request)
        found = found.select(F.lit(block).alias("block_hash"), "doc_id", F.size(F.split("text", r"\s+")).alias("n_words"))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT count(*) AS n_sequences, true AS same FROM documents")
def scorer_plugin(spark, table):
    """A scorer loaded by name gives what the function itself gives."""
    score = evaluation.load_plugin("adjudica.operators.duel:cohort_scores")
    a, b = score(table("documents"), table("labels")), duel.cohort_scores(table("documents"), table("labels")).withColumnRenamed("champion_loss", "c")
    return a.join(b.select("seq_idx", "c"), "seq_idx").agg(F.count("*").alias("n_sequences"), F.bool_and(F.abs(F.col("champion_loss") - F.col("c")) < 1e-9).alias("same"))


@query("SELECT * FROM (VALUES ('n', '10000'), ('seq_len', '2048'), ('batch_size', '512'), ('alpha', '0.001'), ('delta_threshold', '0.0015'), ('max_sequences', '10000')) t(name, value)")
def describe_service(spark, table):
    told = evaluation.describe(spark)
    return told.where(F.col("name").isin("n", "seq_len", "batch_size", "alpha", "delta_threshold", "max_sequences"))


STREAMS = r"p AS (SELECT source, sum(len(regexp_split_to_array(text, '\s+')) + 1)::bigint AS n FROM documents GROUP BY 1)"


def texts(table):
    return table("documents").select("source", F.col("doc_id").alias("ord"), "text")


@query(f"WITH {STREAMS} SELECT source, (n // 4096)::bigint AS total_shards, (n // 4096 * 4096)::bigint AS total_tokens, (n // 4096 * (4096 * 4 + 128))::bigint AS bytes FROM p WHERE n >= 4096")
def ingest_manifest(spark, table):
    """Texts to full token shards on disk; totals of the manifest that was written."""
    made = ingest(spark, texts(table), shared_folder(spark, "ingest"), Plan(4096))
    return made.groupBy("source").agg(F.count("*").alias("total_shards"), F.sum("n_tokens").alias("total_tokens"), F.sum("size_bytes").alias("bytes"))


@query(f"WITH {STREAMS} SELECT source, n AS total_tokens, ceil(n / 4096)::bigint AS total_shards FROM p WHERE source <> 'src1'")
def ingest_plan(spark, table):
    """A dry run that keeps tails and leaves out what an earlier run completed."""
    done = table("documents").where("source = 'src1'").select("source").distinct()
    made = ingest(spark, texts(table), "", Plan(4096, keep_tail=True, part_id="part-1", dry_run=True), completed=done)
    return made.groupBy("source").agg(F.sum("n_tokens").alias("total_tokens"), F.count("*").alias("total_shards"))


@query(r"""WITH p AS (SELECT sum(len(regexp_split_to_array(text, '\s+')) + 1)::bigint AS n FROM documents WHERE source LIKE 'src1%' OR source LIKE 'src2%'),
s AS (SELECT unnest(range(0, (n + 4095) // 4096)) AS k, n FROM p)
SELECT 'part-7-stream-' || lpad(k::varchar, 6, '0') AS source_file, least(4096, n - k * 4096)::bigint AS n_tokens FROM s""")
def ingest_ordered_part(spark, table):
    """Sources chosen by the beginning of their names as one stream, remainders going on from source to source; the part's manifest."""
    plan = Plan(4096, prefixes=("src1", "src2"), ordered_part=True, keep_tail=True, part_id="part-7", run_id="run", part_manifest_only=True)
    return ingest(spark, texts(table), shared_folder(spark, "ingest"), plan).select("source_file", "n_tokens")
