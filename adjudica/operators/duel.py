"""Paired losses, bootstrap verdicts, early stop and per-source scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.shared import dropped, kept
from . import sampling

#: Pairs of one duel never exceed this, so a table of them may be broadcast.
MAX_SEQUENCES = 10_000
#: Values of a bootstrap that a task holds for its draws, 8 bytes each; of more, each task has a part and all draws.
MAX_BROADCAST = 4_000_000
#: Values of a row in which they are shipped, draws of a task about, and the most tasks that values are shipped to.
PACKED, DRAWS, MAX_SHIPPED = 65_536, 16_000_000, 16
#: Values of a range within which one task follows quantiles, about, and the most ranges.
RANGE, MAX_RANGES = 50_000, 256
#: Tokens of a model that are broadcast for scoring, the most frequent ones (some 100 bytes each).
HOT_TOKENS = 100_000
EARLY_STOP_FRACTION = 0.2
EARLY_STOP_QUANTILE = 0.94


def tokens(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", F.explode(F.split("text", r"\s+")).alias("token"))


def unigram_model(rows: DataFrame, name: str) -> DataFrame:
    """(token, count) of a cohort's tokens."""
    return rows.groupBy("token").agg(F.count("*").alias(name))


def cohort_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(seq_idx, source, champion_loss, challenger_loss): mean cross-entropy in nats per token.

    Two add-one unigram models are counted in one pass: the champion's from
    documents of quality 1, the challenger's from those that are not toxic either.
    A document counts as often as documents and labels of its id meet. Texts are
    shuffled once, to meet their labels. For scoring, the HOT_TOKENS most frequent
    tokens are broadcast, so that of their occurrences only sums by document are
    shuffled; the others meet the model in an equi-join. The result is a kept table.
    """
    champion = F.coalesce(F.col("quality") == 1, F.lit(False))
    challenger = champion & F.coalesce(F.col("toxic") == 0, F.lit(False))
    rows = documents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    marks = labels.groupBy("doc_id").agg(F.count_if(champion).alias("a"), F.count_if(challenger).alias("b"))
    times = lambda c: (F.col("rows") * F.coalesce(c, F.lit(0))).alias(c)
    flags = rows.join(marks, "doc_id", "left").select("doc_id", times("a"), times("b"))
    token = F.explode(F.split("text", r"\s+")).alias("token")
    flagged = documents.select("doc_id", "text").join(flags.hint("merge"), "doc_id").select("a", "b", token)
    model = kept(flagged.groupBy("token").agg(F.count("*").alias("n"), F.sum("a").alias("na"), F.sum("b").alias("nb")), "model")
    totals = model.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count("*").alias("v"))
    loss = lambda n, t: -F.log((F.col(n) + 1.0) / (F.col(t) + F.col("v")))
    # One row of totals.
    scored = model.crossJoin(F.broadcast(totals)).select("token", "n", loss("na", "ta").alias("la"), loss("nb", "tb").alias("lb"))
    often = _often(model)
    hot, cold = scored.where(F.col("n") > often).drop("n"), scored.where(F.col("n") <= often).drop("n")
    occurrences = tokens(documents)
    sums = [F.sum("la").alias("sa"), F.sum("lb").alias("sb"), F.count("*").alias("n")]
    parts = [kept(occurrences.join(F.broadcast(hot), "token").groupBy("doc_id", "source").agg(*sums), "hot")]
    if not cold.isEmpty():
        rare = occurrences.join(F.broadcast(hot.select("token")), "token", "left_anti")
        parts.append(kept(rare.join(cold.hint("merge"), "token").groupBy("doc_id", "source").agg(*sums), "cold"))
    mean = lambda c: F.sum(c) / F.sum("n")
    both = reduce(DataFrame.unionByName, parts).groupBy(F.col("doc_id").alias("seq_idx"), "source")
    out = kept(both.agg(mean("sa").alias("champion_loss"), mean("sb").alias("challenger_loss")), "losses")
    dropped(model, *parts)
    return out


def _often(model: DataFrame) -> int:
    """A count that some HOT_TOKENS tokens of the model exceed at most; 0 if there are no more than that."""
    n = model.count()
    if n <= HOT_TOKENS:
        return 0
    # The error of the quantile is a tenth of the hot tokens' share.
    found = model.agg(F.percentile_approx("n", 1 - HOT_TOKENS / n, min(10 * n // HOT_TOKENS + 1, 1_000_000))).first()
    return found[0]


def pair(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """Losses of one sequence side by side."""
    return champion.join(challenger, "seq_idx")


def advantage() -> Column:
    return F.col("champion_loss") - F.col("challenger_loss")


def source_scores(pairs: DataFrame) -> DataFrame:
    """Per source: count, mean losses, mean advantage, to six places."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return pairs.groupBy("source").agg(
        F.count("*").alias("n"),
        mean(F.col("champion_loss"), "avg_champion_loss"),
        mean(F.col("challenger_loss"), "avg_challenger_loss"),
        mean(advantage(), "mu_hat"),
    )


def numbered(values: DataFrame, order: str) -> DataFrame:
    """values with ``i``: 0-based place by a number ``order``, whatever the number of rows."""
    return sampling.placed(values, order, "i")


# A prime modulus and the multipliers of the draws.
PRIME, MULTIPLIERS = 2_147_483_647, (48_271, 69_621, 16_807)


def bootstrap_means(values: DataFrame, replicates: int, seed: int, group: str | None = None) -> DataFrame:
    """Means of resamples of ``d``: draw k of replicate b takes row draw(b, k, seed) mod n.

    values: (group?, i, d) with i from 0 within the group. Draws are neither stored nor
    shuffled: packed values go to some tasks, each of which makes the draws of its share
    of the replicates and sums what they take. A task holds MAX_BROADCAST values; of
    more, it sums what draws take of its part. A null d is drawn, but not counted.
    """
    keys = [group] if group else []
    held, packed_in = MAX_BROADCAST, min(PACKED, MAX_BROADCAST)
    i = F.col("i")
    cut = values.select(*keys, F.floor(i / held).alias("_part"), F.floor(i % held / packed_in).alias("_piece"), F.struct(i, F.col("d").cast("double").alias("d")).alias("_v"))
    if group:
        cut = cut.where(F.col(group).isNotNull())
    packed = cut.groupBy(*keys, "_part", "_piece").agg(F.array_sort(F.collect_list("_v")).alias("_v"))
    packed = kept(packed.select(*keys, "_part", "_piece", F.col("_v.d").alias("_d")), "values")
    sizes = packed.groupBy(*keys).agg(F.sum(F.size("_d")).alias("_n"))
    sized = packed.join(sizes, keys) if keys else packed.crossJoin(F.broadcast(sizes))
    shares = F.least(F.ceil(F.col("_n") * replicates / DRAWS), F.lit(min(replicates, MAX_SHIPPED)))
    tasks = sized.withColumn("_shares", shares.cast("long")).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)))
    by = [*keys, "_part", "_share"]
    spread = tasks.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    schema = T.StructType([*[packed.schema[k] for k in keys], T.StructField("b", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    sums = spread.groupBy(*by).applyInArrow(_drawn_sums(replicates, seed, group, held), schema)
    n = F.sum("n")
    return sums.groupBy(*keys, "b").agg(F.when(n > 0, F.sum("s") / n).alias("mean"))


def _drawn_sums(replicates: int, seed: int, group: str | None, held: int, step: int = 32_768):
    """For one share of replicates and one part of the values: (b, s, n), sum and number of what draws take there."""
    prime, (m0, m1, m2) = PRIME, MULTIPLIERS

    def run(table):
        import numpy as np
        import pyarrow as pa

        def mod(v):  # of numbers below 2^63 by a prime 2^31 - 1
            v = (v & u(prime)) + (v >> u(31))
            v = (v & u(prime)) + (v >> u(31))
            return np.minimum(v, v - u(prime))  # below 0 wraps round

        u = np.uint64
        part, share, shares, n = (table.column(c)[0].as_py() for c in ("_part", "_share", "_shares", "_n"))
        rows = table.column("_d").combine_chunks()
        rows = [rows[int(j)].values for j in np.argsort(table.column("_piece").to_numpy())]
        d = np.concatenate([r.to_numpy(zero_copy_only=False) for r in rows])
        known = None
        if any(r.null_count for r in rows):
            known = np.concatenate([r.is_valid().to_numpy(zero_copy_only=False) for r in rows])
            d[~known] = 0
        bs = np.arange(share, replicates, shares)
        sums, counts = np.zeros(len(bs)), np.zeros(len(bs), np.int64)
        for start in range(0, n, step):
            k = np.arange(start, min(start + step, n), dtype=u)
            k0 = k * u(m0)
            for j, b in enumerate(bs.tolist()):
                x = mod(mod(k0 + u((b * m1 + seed) % prime)) * u(m2))
                y = mod(x * x + k)
                at = mod(y * y + x)
                if n < 2**31:
                    at = at.astype(np.uint32)
                    at -= at // np.uint32(n) * np.uint32(n)
                if n > held:
                    at = at.astype(np.int64) - part * held
                    at = at[(at >= 0) & (at < len(d))]
                sums[j] += d[at].sum()
                counts[j] += len(at) if known is None else known[at].sum()
        out = {"b": bs, "s": sums, "n": counts}
        own = {group: table.column(group).take(pa.array(np.zeros(len(bs), np.int64)))} if group else {}
        return pa.table(own | out)

    return run


def verdict(pairs: DataFrame, replicates: int = 1000, alpha: float = 0.001, delta: float = 0.0015, seed: int = 0) -> DataFrame:
    """One row: mu_hat, the alpha-quantile of resampled means, and whether it is above delta (strictly)."""
    pairs = kept(pairs, "pairs")  # read by the draws and by the overall means
    d = numbered(pairs.select("seq_idx", advantage().alias("d")), "seq_idx").drop("seq_idx")
    lcb = bootstrap_means(d, replicates, seed).agg(F.percentile("mean", F.lit(alpha)).alias("lcb"))
    overall = pairs.agg(
        F.count("*").alias("n_sequences"),
        F.avg("champion_loss").alias("c"),
        F.avg("challenger_loss").alias("h"),
        F.avg(advantage()).alias("m"),
    )
    accepted = F.col("lcb") > F.lit(delta)
    return overall.crossJoin(lcb).select(
        accepted.alias("accepted"),
        F.when(accepted, "challenger").otherwise("king").alias("verdict"),
        F.round("m", 6).alias("mu_hat"),
        F.round("lcb", 6).alias("lcb"),
        F.lit(delta).alias("delta"),
        F.lit(alpha).alias("alpha"),
        F.lit(replicates).cast("long").alias("n_bootstrap"),
        "n_sequences",
        F.round("c", 6).alias("avg_champion_loss"),
        F.round("h", 6).alias("avg_challenger_loss"),
    )


def exact_verdict(pairs: DataFrame, replicates: int, alpha: float, delta: float, seed: int) -> DataFrame:
    """The same with NumPy's generator, whose state runs through all replicates: one task by nature.

    Bounded by MAX_SEQUENCES rows; more is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        d = pd.concat(parts)["d"].to_numpy(float) if parts else np.empty(0)
        if len(d) > MAX_SEQUENCES:
            raise ValueError(f"a duel has {MAX_SEQUENCES} sequences at most")
        if not len(d):
            return
        rng = np.random.default_rng(seed)
        means = np.array([d[rng.integers(0, len(d), len(d))].mean() for _ in range(replicates)])
        lcb = float(np.quantile(means, alpha))
        yield pd.DataFrame({"n_sequences": [len(d)], "mu_hat": [d.mean()], "lcb": [lcb], "accepted": [lcb > delta]})

    one = pairs.select("seq_idx", advantage().alias("d")).orderBy("seq_idx").coalesce(1)
    return one.mapInPandas(run, "n_sequences long, mu_hat double, lcb double, accepted boolean")


def capped_verdict(pairs: DataFrame, replicates: int, alpha: float, delta: float, seed: int) -> DataFrame:
    """exact_verdict of the first MAX_SEQUENCES pairs, with how many were asked for and whether that cut any."""
    asked = pairs.agg(F.count("*").alias("n_requested"))
    first = exact_verdict(pairs.orderBy("seq_idx").limit(MAX_SEQUENCES), replicates, alpha, delta, seed)
    return first.crossJoin(F.broadcast(asked)).withColumn("capped", F.col("n_requested") > MAX_SEQUENCES)


def batches(pairs: DataFrame, size: int) -> DataFrame:
    """pairs with i (place by seq_idx) and batch."""
    return numbered(pairs, "seq_idx").withColumn("batch", F.floor(F.col("i") / size))


def running_means(pairs: DataFrame, size: int) -> DataFrame:
    """After each batch: pairs done, mean champion loss and mean advantage so far."""
    per = batches(pairs, size).groupBy("batch").agg(F.count("*").alias("n"), F.sum("champion_loss").alias("c"), F.sum(advantage()).alias("d"))
    so_far = W.orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    done = F.sum("n").over(so_far)
    return per.select(
        "batch",
        done.alias("done"),
        F.round(F.sum("c").over(so_far) / done, 6).alias("champion_mean"),
        F.round(F.sum("d").over(so_far) / done, 6).alias("mu_hat"),
    )


def stop_points(pairs: DataFrame, size: int, delta: float, quantile: float = EARLY_STOP_QUANTILE, fraction: float = EARLY_STOP_FRACTION, n: int | None = None) -> DataFrame:
    """Batch ends with the heuristic bound: what is left of n sequences is taken at a quantile of what was seen.

    Values are cut into ranges about equally large, and ranges are counted by batch, which
    tells the range of each end's quantile and the rank there. Each range's values are
    then followed in order by one task, which answers the ends that ask it.
    """
    rows = kept(batches(pairs.select("seq_idx", advantage().alias("d")), size).select("i", "batch", "d"), "advantages")
    upto = W.orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = rows.groupBy("batch").agg((F.max("i") + 1).alias("done"), F.sum("d").alias("s"), F.count("d").alias("c"))
    seen = F.sum("c").over(upto)
    at = (seen - 1) * F.lit(quantile)
    ends = kept(per.select("batch", "done", F.sum("s").over(upto).alias("total"), F.when(seen > 0, at).alias("at")), "ends")
    ranks = [(side, f(F.col("at")).cast("long")) for side, f in (("lower", F.floor), ("upper", F.ceil))]
    known = rows.where("d is not null").withColumn("_o", F.nanvl("d", F.lit(float("inf"))))
    cut = sampling.with_pieces(known, "_o", max(RANGE, -(-rows.count() // MAX_RANGES)))
    ranges = kept(cut.groupBy(F.col("_piece").alias("range"), "batch").agg(F.collect_list("d").alias("ds")), "ranges")
    # All ends by all ranges, MAX_RANGES and some at most.
    every = ends.crossJoin(F.broadcast(ranges.select("range").distinct()))
    counted = every.join(ranges.select("range", "batch", F.size("ds").alias("c")), ["range", "batch"], "left")
    along = W.partitionBy("range").orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = counted.withColumn("c", F.coalesce(F.sum("c").over(along), F.lit(0)))
    below = F.coalesce(F.sum("c").over(W.partitionBy("batch").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = counted.withColumn("below", below).withColumn("ask", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), r.alias("rank")) for s, r in ranks])))
    asked = asked.where("ask.rank >= below and ask.rank < below + c").select("range", "batch", F.col("ask.side").alias("side"), (F.col("ask.rank") - F.col("below")).alias("rank"))
    asked = kept(asked, "asked")
    followed = ranges.join(asked.select("range").distinct(), "range", "left_semi")
    empty = lambda kind: F.lit(None).cast(kind)
    both = followed.select("range", "batch", "ds", empty("string").alias("side"), empty("long").alias("rank")).unionByName(asked.select("range", "batch", empty("array<double>").alias("ds"), "side", "rank"))
    answers = both.groupBy("range").applyInPandas(_followed(), "batch long, side string, value double").groupBy("batch")
    answers = answers.agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s, _ in ranks])
    floor, ceil = (r for _, r in ranks)
    q = F.when(floor == ceil, F.col("lower")).otherwise((ceil - F.col("at")) * F.col("lower") + (F.col("at") - floor) * F.col("upper"))
    total = rows.agg(F.count("*").alias("n") if n is None else F.lit(n).cast("long").alias("n"))
    told = ends.join(answers, "batch", "left").crossJoin(F.broadcast(total))
    bound = (F.col("total") + (F.col("n") - F.col("done")) * q) / F.col("n")
    ready = (F.col("done") < F.col("n")) & (F.col("done") >= F.floor(F.col("n") * fraction))
    return told.select("batch", F.col("done").cast("int").alias("done"), "n", bound.alias("heuristic_bound"), (ready & (bound < delta)).alias("stops"))


def _followed():
    """Values of one range, by batch, and ranks that are asked at batch ends: the value of each rank among those so far."""

    def run(rows):
        import numpy as np
        import pandas as pd

        values = rows[rows["side"].isna()].sort_values("batch")
        asked = rows[rows["side"].notna()].sort_values("batch")
        places = np.repeat(values["batch"].to_numpy(np.int64), [len(d) for d in values["ds"]])
        distinct, which = np.unique(np.concatenate([*values["ds"], np.empty(0)]), return_inverse=True)
        counts, done, out = np.zeros(len(distinct), np.int64), 0, []
        for batch, ask in asked.groupby("batch"):
            upto = int(np.searchsorted(places, batch, "right"))
            np.add.at(counts, which[done:upto], 1)
            done = upto
            out.append(distinct[np.searchsorted(np.cumsum(counts), ask["rank"].to_numpy(np.int64), "right")])
        return pd.DataFrame({"batch": asked["batch"].astype("int64"), "side": asked["side"], "value": np.concatenate([*out, np.empty(0)])})

    return run


def early_stop(pairs: DataFrame, size: int, delta: float, n: int | None = None) -> DataFrame:
    """The first batch end that stops the duel; no row if none does. n: sequences of the duel, if pairs are only the first of them."""
    found = stop_points(pairs, size, delta, n=n).where("stops").orderBy("batch").limit(1)
    return found.select("batch", "done", "n", F.round("heuristic_bound", 6).alias("heuristic_bound"))


def sequence_losses(scored: DataFrame) -> DataFrame:
    """Mean loss of each sequence from (seq_idx, nll) per position."""
    return scored.groupBy("seq_idx").agg((F.sum("nll") / F.count("*")).alias("loss"))


def score_with(sequences: DataFrame, scorer, schema: str) -> DataFrame:
    """Plug-in point for models: scorer takes and yields pandas batches."""
    return sequences.mapInPandas(scorer, schema)


def log_midpoint_threshold(rows: DataFrame, value: str, is_copy: Column) -> DataFrame:
    """sqrt(largest copy distance x smallest independent distance); refused where the cohorts overlap."""
    ends = rows.agg(F.max(F.when(is_copy, F.col(value))).alias("copy_max"), F.min(F.when(~is_copy, F.col(value))).alias("independent_min"))
    overlap = F.col("copy_max") >= F.col("independent_min")
    middle = F.sqrt(F.greatest("copy_max", F.lit(1e-12)) * F.greatest("independent_min", F.lit(1e-12)))
    return ends.withColumn("overlap", overlap).withColumn("threshold", F.when(~overlap, F.round(middle, 9)))


def midpoint_threshold(rows: DataFrame, value: str, is_good: Column, factor: float) -> DataFrame:
    """max(midpoint between the cohorts, factor x largest good value), over finite values."""
    finite = rows.where(~F.isnan(value) & (F.abs(value) < float("inf")))
    ends = finite.agg(F.max(F.when(is_good, F.col(value))).alias("good_max"), F.min(F.when(~is_good, F.col(value))).alias("trick_min"))
    return ends.withColumn("threshold", F.greatest((F.col("good_max") + F.col("trick_min")) / 2, F.col("good_max") * factor))
