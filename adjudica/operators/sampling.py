"""Quotas, weights, and reproducible samples by hash order."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import hash32, keyed_seed


def equal_quotas(sources: DataFrame, total: int) -> DataFrame:
    """sources (idx, ...) with quota: equal shares, the first ``total mod n`` get one more."""
    n = F.count("*").over(W.partitionBy())
    return sources.withColumn("quota", (F.floor(F.lit(total) / n) + F.when(F.col("idx") < F.lit(total) % n, 1).otherwise(0)).cast("long"))


def weighted_quotas(sources: DataFrame, total: int) -> DataFrame:
    """sources (idx, weight, ...) with quota by largest remainder, ties by idx."""
    whole = W.partitionBy()
    raw = F.lit(float(total)) * F.col("weight") / F.sum("weight").over(whole)
    base = sources.withColumn("_raw", raw).withColumn("_floor", F.floor("_raw"))
    rank = F.row_number().over(W.orderBy(F.desc(F.col("_raw") - F.col("_floor")), "idx"))
    left = F.lit(total) - F.sum("_floor").over(whole)
    quota = (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")
    return base.withColumn("quota", quota).drop("_raw", "_floor")


def source_quotas(sources: DataFrame, total: int, weights: list[float] | None, count: int) -> DataFrame:
    """Weighted quotas; equal ones where the list of weights is missing or has the wrong length."""
    if not weights or len(weights) != count:
        return equal_quotas(sources, total)
    table = F.array(*[F.lit(float(w)) for w in weights])
    return weighted_quotas(sources.withColumn("weight", F.get(table, F.col("idx").cast("int"))), total)


def pattern_weights(sources: DataFrame, patterns: list[tuple[str, float]]) -> DataFrame:
    """sources (source) with weight: of the first pattern that the name contains, else 1 / n."""
    spark = sources.sparkSession
    table = spark.createDataFrame([(i, p, float(w)) for i, (p, w) in enumerate(patterns)], "ordinal int, pattern string, w double")
    # Patterns are a configured list, so this loop join is with a table of known size.
    hit = sources.join(F.broadcast(table), F.contains(F.col("source"), F.col("pattern")), "left")
    first = hit.groupBy("source").agg(F.min_by("w", "ordinal").alias("w"))
    return first.select("source", F.coalesce("w", 1.0 / F.count("*").over(W.partitionBy())).alias("weight"))


def hash_order(seed: str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))


def quota_sample(rows: DataFrame, quotas: DataFrame, seed: str, key: str) -> DataFrame:
    """The first ``quota`` rows of each source in hash order."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(hash_order(seed, key), key))
    return rows.join(quotas, "source").withColumn("rank", rank).where("rank <= quota").drop("rank", "quota")


def sample(rows: DataFrame, k: int, seed: str, key: str) -> DataFrame:
    """k rows without replacement (all, shuffled, if there are fewer), with their place."""
    order = hash_order(seed, key)
    top = rows.withColumn("_h", order).orderBy("_h", key).limit(k)
    return top.withColumn("place", F.row_number().over(W.orderBy("_h", key))).drop("_h")


def ids_digest(rows: DataFrame, key: str, place: str) -> DataFrame:
    """SHA-256 over the ids of a sample in order."""
    ordered = F.array_sort(F.collect_list(F.struct(place, key)))
    return rows.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x[key].cast("string")), ","), 256).alias("digest"), F.count("*").alias("n"))


def take_until(parts: DataFrame, n: int, order: str) -> DataFrame:
    """Leading parts (order, count) until their counts reach n, with how much each gives."""
    before = F.coalesce(F.sum("count").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = parts.withColumn("before", before.cast("long")).where(F.col("before") < n)
    return cut.withColumn("taken", F.least("count", F.lit(n) - F.col("before")).cast("long"))


def rotate(files: DataFrame, start: int, limit: int) -> DataFrame:
    """files (idx) from a seeded start on, round to the front, ``limit`` at most."""
    n = F.count("*").over(W.partitionBy())
    return files.withColumn("turn", (F.col("idx") - start + n) % n).where(F.col("turn") < limit)


#: Rows of a piece, about; the most pieces; and the error of the quantiles that bound them, as a share of a piece.
PIECE, MAX_PIECES, PIECE_ERROR = 500_000, 1000, 0.1


def with_pieces(rows: DataFrame, order: str, size: int = PIECE) -> DataFrame:
    """rows with ``_piece``, ranges of a numeric column that hold about ``size`` rows each, in its order; nulls are in the first.

    Bounds are quantiles of the column as it is, so neither gaps nor crowds of values make
    a piece large or pieces many. The driver gets one bound for each piece.
    """
    n = rows.count()
    pieces = min(-(-n // size), MAX_PIECES)
    if pieces <= 1:
        return rows.withColumn("_piece", F.lit(0))
    at = [i / pieces for i in range(1, pieces)]
    bounds = rows.select(F.percentile_approx(order, at, int(pieces / PIECE_ERROR)).alias("b")).first()["b"]
    return rows.withColumn("_piece", _below(F.col(order), sorted(set(bounds or []))))


def _below(value: Column, bounds: list, step: int = 32) -> Column:
    """How many of the bounds are less than the value; they are looked at by groups, then in one group."""
    if not bounds:
        return F.lit(0)
    count = lambda values: F.aggregate(values, F.lit(0), lambda n, b: n + F.when(value > b, 1).otherwise(0))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    group = F.greatest(count(F.array(*[F.lit(g[0]) for g in groups])) - 1, F.lit(0))
    inside = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group)
    return group * step + count(inside)


def placed(rows: DataFrame, order: str, name: str = "i", group: str | None = None) -> DataFrame:
    """rows with their 0-based place by a numeric column, null first, without one task for all; within a group, if one is given.

    Pieces of the column are counted, the counts are put in one order, and rows are
    numbered within their piece.
    """
    keys = [group] if group else []
    cut = with_pieces(rows, order)
    counts = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    along = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias("_g") for k in keys], F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(F.col(order).asc_nulls_first()))
    same = F.col("_piece") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_g"))
    numbered = cut.withColumn("_in", within).join(before, same)
    return numbered.withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_piece", "_p", "_g", "_before", "_in")


def running_total(rows: DataFrame, order: str, value: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with the sum of ``value`` over the rows before them by a numeric column and ties, without one task for all."""
    cut = with_pieces(rows, order)
    sums = cut.groupBy("_piece").agg(F.sum(value).alias("_sum"))
    before = sums.select("_piece", F.coalesce(F.sum("_sum").over(W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = W.partitionBy("_piece").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(W.unboundedPreceding, -1)
    summed = cut.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(before, "_piece")
    return summed.withColumn(name, F.col("_base") + F.col("_in")).drop("_piece", "_base", "_in")


def round_robin(rows: DataFrame, order: str, n: int) -> DataFrame:
    return placed(rows, order, "_i").withColumn("part", (F.col("_i") % n).cast("int")).drop("_i")


def contiguous(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n runs of equal length, of which the first ones have one row more."""
    total = rows.agg(F.count("*").alias("_all"))
    longer = F.col("_all") % n
    size = F.floor(F.col("_all") / n)
    part = F.when(F.col("_i") < longer * (size + 1), F.floor(F.col("_i") / (size + 1))).otherwise(longer + F.floor((F.col("_i") - longer * (size + 1)) / F.greatest(size, F.lit(1))))
    return placed(rows, order, "_i").crossJoin(F.broadcast(total)).withColumn("part", part.cast("int")).drop("_i", "_all")


def greedy_bins(items: DataFrame, n: int) -> DataFrame:
    """(key, size) -> bin: longest first, each to the least loaded bin. Sequential by nature."""

    def run(batches):
        import heapq

        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(["size", "key"], ascending=[False, True])
        heap = [(0, b) for b in range(n)]
        out = []
        for key, size in zip(rows["key"], rows["size"], strict=True):
            load, b = heapq.heappop(heap)
            out.append((key, size, b))
            heapq.heappush(heap, (load + size, b))
        yield pd.DataFrame(out, columns=["key", "size", "bin"])

    return items.select("key", "size").coalesce(1).mapInPandas(run, "key string, size long, bin int")


def probe_tokens(vocabulary: int, batch: int, length: int, seed: int) -> np.ndarray:
    """Public probe: integers of NumPy's generator."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, vocabulary, (batch, length), dtype=np.int64)


def private_plan(vocabulary: int, secret: bytes, rows: int, length: int, positions: int) -> tuple[np.ndarray, np.ndarray, str]:
    """Private probe: tokens and sorted positions from keyed seeds, and the key's public id. Stays on the driver."""
    tokens = np.random.default_rng(keyed_seed(secret, "tokens")).integers(0, vocabulary, (rows, length), dtype=np.int64)
    at = np.sort(np.random.default_rng(keyed_seed(secret, "positions")).choice(length, positions, replace=False))
    return tokens, at, hashlib.sha256(secret).hexdigest()[:16]


def probe_plans(submissions: DataFrame, secret: bytes, vocabulary: int, rows: int, length: int, positions: int) -> DataFrame:
    """(id, public_digest, private_digest, positions, key_id) for submissions (id): each has probes of its own, made where its row is.

    The public probe is seeded by the id, the private one by a key of the secret and the
    id; only digests and positions leave the task. A null id has none.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for i in pdf["id"].tolist():
                own = keyed_seed(secret, f"submission:{i}").to_bytes(8, "little")
                tokens, at, _ = private_plan(vocabulary, own, rows, length, positions)
                out.append((i, array_digest(probe_tokens(vocabulary, rows, length, i)), array_digest(tokens), at.tolist(), hashlib.sha256(secret).hexdigest()[:16]))
            yield pd.DataFrame(out, columns=["id", "public_digest", "private_digest", "positions", "key_id"])

    known = submissions.select(F.col("id").cast("long").alias("id")).where("id is not null")
    return known.mapInPandas(run, "id long, public_digest string, private_digest string, positions array<long>, key_id string")


def array_digest(values: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(values, dtype="<i8").tobytes()).hexdigest()


def exact_choice(size: int, k: int, seed: int) -> np.ndarray:
    """k indices without replacement, or all shuffled, by NumPy's generator."""
    rng = np.random.default_rng(seed)
    return rng.permutation(size) if k >= size else rng.choice(size, k, replace=False)


__all__ = [n for n in dir() if not n.startswith("_")] + ["hash32"]
