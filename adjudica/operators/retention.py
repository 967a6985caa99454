"""What to delete from caches: keep-recent, watermark, newest-n, protected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import sampling


def keep_recent(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """rows with evict: beyond the newest n of their group, ties by id.

    The n-th row of each group is found first, of which each task sends n rows a group at
    most; all others are held against it, so no group meets in one task.
    """
    if n < 1:
        return rows.withColumn("evict", F.lit(True))
    w = W.partitionBy(group).orderBy(F.desc(order), "id")
    top = rows.select(group, order, "id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    last = top.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.max_by(F.struct(F.col(order).alias("o"), F.col("id").alias("i")), "_r").alias("_last"))
    met = rows.join(last, F.col(group).eqNullSafe(F.col("_g")), "left")
    return met.withColumn("evict", (F.col("_n") >= n) & ~_within(order, F.col("_last"))).drop("_g", "_n", "_last")


def _within(order: str, last: Column) -> Column:
    """Whether a row comes at or before ``last`` (o, i), newest first, nulls last, then by id, nulls first."""
    same = F.col(order).eqNullSafe(last["o"]) & (F.col("id").isNull() | F.coalesce(F.col("id") <= last["i"], F.lit(False)))
    newer = F.coalesce(F.col(order) > last["o"], F.col(order).isNotNull() & last["o"].isNull())
    return F.coalesce(newer | same, F.lit(False))


def watermark(rows: DataFrame, size: str, age: str, limit: int, target: float = 0.7, protected: Column | None = None, strict: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows to delete, by ``age`` (a number, least first) and ties, until the total is at most target x limit (below it if strict).

    Nothing goes while the total is within the limit. Protected rows count but stay. Sizes
    are summed by ranges of the age first, so the listing may have any length.
    """
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    free = rows if protected is None else rows.where(~protected)
    summed = sampling.running_total(free, age, size, "_before", ties).crossJoin(F.broadcast(total))
    left = F.col("_total") - F.col("_before")
    over = left >= target * limit if strict else left > target * limit
    return summed.where((F.col("_total") > limit) & over).drop("_total", "_before")


def newest_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    """rows with keep: among the newest n, ties by id."""
    kept = keep_recent(rows.withColumn("_all", F.lit(0)), "_all", order, n)
    return kept.withColumn("keep", ~F.col("evict")).drop("_all", "evict")


def complete(files: DataFrame, folder: str) -> DataFrame:
    """Folders with whether they hold a configuration and weights, and their size."""
    name = F.substring_index("path", "/", -1)
    return files.groupBy(folder).agg(
        (F.max((name == "config.json").cast("int")) + F.max(F.endswith("path", F.lit(".safetensors")).cast("int")) == 2).alias("complete"), F.sum("length").cast("long").alias("bytes")
    )
