"""Queries on duels, thresholds and bootstrap bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duel, sampling
from .registry import query

PAIRS = r"""
tok AS (SELECT doc_id, source, unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents),
cnt AS (SELECT doc_id, source, token, count(*) AS n FROM tok GROUP BY ALL),
flag AS (SELECT d.doc_id, coalesce(quality = 1, false) AS a, coalesce(quality = 1 AND toxic = 0, false) AS b FROM documents d LEFT JOIN labels USING (doc_id)),
model AS (SELECT token, coalesce(sum(n) FILTER (a), 0) AS na, coalesce(sum(n) FILTER (b), 0) AS nb FROM cnt JOIN flag USING (doc_id) GROUP BY token),
tot AS (SELECT sum(na) AS ta, sum(nb) AS tb, count(*) AS v FROM model),
sc AS (SELECT token, -ln((na + 1.0::double) / (ta + v)::double) AS la, -ln((nb + 1.0::double) / (tb + v)::double) AS lb FROM model, tot),
pairs AS (SELECT doc_id AS seq_idx, source, sum(la * n) / sum(n) AS champion_loss, sum(lb * n) / sum(n) AS challenger_loss FROM cnt JOIN sc USING (token) GROUP BY 1, 2)
"""


def drawn(b: str, k: str, seed: int) -> str:
    """What duel.bootstrap_means draws, in SQL."""
    p, (m0, m1, m2) = duel.PRIME, duel.MULTIPLIERS
    x = f"((({k}::bigint * {m0} + {b}::bigint * {m1} + {seed}) % {p}) * {m2} % {p})"
    y = f"(({x} * {x} + {k}) % {p})"
    return f"(({y} * {y} + {x}) % {p})"


def boot(values: str, replicates: int, seed: int) -> str:
    """CTEs ``draws`` and ``means`` over a CTE with (i, d)."""
    return f"""
size AS (SELECT count(*) AS n FROM {values}),
draws AS (SELECT b, {drawn("b", "k", seed)} % n AS i FROM size, range({replicates}) t(b), (SELECT unnest(range(n)) AS k FROM size)),
means AS (SELECT b, avg(d) AS mean FROM draws JOIN {values} USING (i) GROUP BY b)
"""


DIFFS = "diffs AS (SELECT row_number() OVER (ORDER BY seq_idx) - 1 AS i, champion_loss - challenger_loss AS d FROM pairs)"


def pairs_of(table):
    return duel.cohort_scores(table("documents"), table("labels"))


@query(f"""WITH {PAIRS}, {DIFFS}, {boot("diffs", 1000, 0)},
l AS (SELECT quantile_cont(mean, 0.001) AS lcb FROM means),
o AS (SELECT count(*) AS n_sequences, avg(champion_loss) AS c, avg(challenger_loss) AS h, avg(champion_loss - challenger_loss) AS m FROM pairs)
SELECT lcb > 0.0015 AS accepted, CASE WHEN lcb > 0.0015 THEN 'challenger' ELSE 'king' END AS verdict, round(m, 6) AS mu_hat, round(lcb, 6) AS lcb,
  0.0015::double AS delta, 0.001::double AS alpha, 1000::bigint AS n_bootstrap, n_sequences, round(c, 6) AS avg_champion_loss, round(h, 6) AS avg_challenger_loss
FROM o, l""")
def duel_verdict(spark, table):
    return duel.verdict(pairs_of(table))


@query(f"""WITH {PAIRS} SELECT source, count(*) AS n, round(avg(champion_loss), 6) AS avg_champion_loss,
round(avg(challenger_loss), 6) AS avg_challenger_loss, round(avg(champion_loss - challenger_loss), 6) AS mu_hat FROM pairs GROUP BY source""")
def duel_source_scores(spark, table):
    return duel.source_scores(pairs_of(table))


@query(f"WITH {PAIRS} SELECT seq_idx, source, round(champion_loss, 6) AS champion_loss, round(challenger_loss, 6) AS challenger_loss FROM pairs")
def duel_pair_losses(spark, table):
    return pairs_of(table).select("seq_idx", "source", F.round("champion_loss", 6).alias("champion_loss"), F.round("challenger_loss", 6).alias("challenger_loss"))


RUNNING = """numbered AS (SELECT *, row_number() OVER (ORDER BY seq_idx) - 1 AS i FROM pairs),
per AS (SELECT i // 64 AS batch, count(*) AS n, sum(champion_loss) AS c, sum(champion_loss - challenger_loss) AS d FROM numbered GROUP BY 1)"""


@query(f"""WITH {PAIRS}, {RUNNING} SELECT batch::bigint AS batch, (sum(n) OVER w)::bigint AS done, round(sum(c) OVER w / sum(n) OVER w, 6) AS champion_mean,
round(sum(d) OVER w / sum(n) OVER w, 6) AS mu_hat FROM per WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)""")
def duel_running_mu(spark, table):
    return duel.running_means(pairs_of(table), 64)


STOPS = """numbered AS (SELECT champion_loss - challenger_loss AS d, row_number() OVER (ORDER BY seq_idx) - 1 AS i, count(*) OVER () AS n FROM pairs),
seen AS (SELECT i // 64 AS batch, i + 1 AS done, n, sum(d) OVER w AS total, quantile_cont(d, 0.94) OVER w AS q, i = max(i) OVER (PARTITION BY i // 64) AS last
  FROM numbered WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
stop AS (SELECT batch, done, n, (total + (n - done) * q) / n AS bound FROM seen WHERE last AND done < n AND done >= floor(n * 0.2)),
first_stop AS (SELECT * FROM stop WHERE bound < 0.0015 ORDER BY batch LIMIT 1)"""


@query(f"WITH {PAIRS}, {STOPS} SELECT batch::bigint AS batch, done, n, round(bound, 6) AS heuristic_bound FROM first_stop")
def duel_early_stop(spark, table):
    return duel.early_stop(pairs_of(table), 64, 0.0015)


@query(f"""WITH {PAIRS}, {STOPS}, prefix AS (SELECT i, d FROM numbered, first_stop WHERE i < done), {boot("prefix", 200, 7)}
SELECT (SELECT done FROM first_stop) AS n_sequences_evaluated, round(avg(d), 6) AS mu_hat, (SELECT round(quantile_cont(mean, 0.001), 6) FROM means) AS lcb FROM prefix HAVING count(*) > 0""")
def duel_partial_lcb(spark, table):
    pairs = pairs_of(table)
    stop = duel.early_stop(pairs, 64, 0.0015).select("done")
    rows = duel.numbered(pairs.select("seq_idx", duel.advantage().alias("d")), "seq_idx")
    prefix = rows.crossJoin(F.broadcast(stop)).where("i < done")  # one row at most
    lcb = duel.bootstrap_means(prefix.select("i", "d"), 200, 7).agg(F.round(F.percentile("mean", F.lit(0.001)), 6).alias("lcb"))
    mean = prefix.agg(F.max("done").alias("n_sequences_evaluated"), F.round(F.avg("d"), 6).alias("mu_hat")).where("n_sequences_evaluated is not null")
    return mean.crossJoin(lcb)


@query("SELECT count(*) AS n_sequences, 0.0::double AS mu_hat, 0.0::double AS lcb, false AS accepted FROM documents")
def self_duel(spark, table):
    own = table("documents").select(F.col("doc_id").alias("seq_idx"), F.length("text").cast("double").alias("champion_loss"))
    v = duel.verdict(own.withColumn("challenger_loss", F.col("champion_loss")), 50)
    return v.select("n_sequences", "mu_hat", "lcb", "accepted")


@query(r"""WITH v AS (SELECT event_type, value AS d, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events WHERE event_id % 10 = 0),
s AS (SELECT event_type, count(*) AS n FROM v GROUP BY 1),
dr AS (SELECT event_type, b, DRAWN % n AS i FROM (SELECT event_type, n, unnest(range(n)) AS k FROM s), range(100) t(b)),
m AS (SELECT event_type, b, avg(d) AS mean FROM dr JOIN v USING (event_type, i) GROUP BY 1, 2)
SELECT event_type, round(quantile_cont(mean, 0.05), 6) AS low, round(quantile_cont(mean, 0.95), 6) AS high FROM m GROUP BY 1""".replace(" WHERE event_id % 10 = 0", "").replace("DRAWN", drawn("b", "k", 11)))
def bootstrap_ci_events(spark, table):
    events = table("events").select("event_type", "event_id", F.col("value").alias("d"))
    values = sampling.placed(events, "event_id", "i", "event_type").drop("event_id")
    means = duel.bootstrap_means(values, 100, 11, "event_type")
    q = lambda p, name: F.round(F.percentile("mean", F.lit(p)), 6).alias(name)
    return means.groupBy("event_type").agg(q(0.05, "low"), q(0.95, "high"))


@query()
def bootstrap_exact_numpy(spark, table):
    return duel.capped_verdict(pairs_of(table), 1000, 0.001, 0.0015, 0)


@query()
def paired_eval_alt(spark, table):
    """The stand-alone runner: its generator is seeded from a hash of the block and the submitter."""
    from ..functions.hashing import blake_seed

    return duel.capped_verdict(pairs_of(table), 1000, 0.001, 0.0015, blake_seed("block|hotkey"))


@query(r"""WITH x AS (SELECT event_type, value FROM events), e AS (SELECT max(value) FILTER (event_type = 'purchase') AS good_max, min(value) FILTER (event_type <> 'purchase') AS trick_min FROM x)
SELECT good_max, trick_min, greatest((good_max + trick_min) / 2, good_max * 1.5) AS threshold FROM e""")
def threshold_midpoint_factor(spark, table):
    return duel.midpoint_threshold(table("events"), "value", F.col("event_type") == "purchase", 1.5)


@query(r"""WITH x AS (SELECT doc_id, quality, 0.001 * (1 + ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 100) * CASE WHEN quality = 0 THEN 0.01 ELSE 2 END AS dist FROM labels),
e AS (SELECT max(dist) FILTER (quality = 0) AS copy_max, min(dist) FILTER (quality = 1) AS independent_min FROM x)
SELECT copy_max::double AS copy_max, independent_min::double AS independent_min, copy_max >= independent_min AS overlap,
CASE WHEN copy_max < independent_min THEN round(sqrt(copy_max::double * independent_min::double), 9) END AS threshold FROM e""")
def threshold_log_midpoint(spark, table):
    from ..functions.hashing import hash32

    spread = F.lit(0.001) * (1 + hash32(F.col("doc_id").cast("string")) % 100)
    rows = table("labels").withColumn("dist", spread * F.when(F.col("quality") == 0, 0.01).otherwise(2.0))
    found = duel.log_midpoint_threshold(rows, "dist", F.col("quality") == 0)
    return found.select("copy_max", "independent_min", "overlap", "threshold")
