"""Who owned a submitter's key: at the head of the chain, else at the block of the reveal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Blocks of a piece: entries of one key meet in one task only within so many.
PIECE = 50_000


def as_of(rows: DataFrame, entries: DataFrame, key: str, at: str, value: str, piece: int = PIECE) -> DataFrame:
    """rows with ``value`` of the last entry (key, at, value) of their key at or before ``at``; null where there is none or it is null.

    Rows and entries are put in one order by block, and the last entry is carried along, so
    each is touched once and no row meets all entries of its key. A key's blocks are cut
    into pieces; the last entry of each piece is carried over to the next ones, so a key
    with a third of all rows is spread like any other. Of several entries of one key and
    block the largest value counts, a null below any.
    """
    names = rows.columns
    told = entries.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias("_v"))
    told = told.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.struct(F.col("_v").alias("v")).alias("_told"), F.lit(None).cast(rows.schema).alias("_row"))
    asked = rows.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.lit(None).cast(told.schema["_told"].dataType).alias("_told"), F.struct(*names).alias("_row"))
    both = told.unionByName(asked).withColumn("_piece", F.floor(F.col("_at") / piece))
    # An entry's block comes before the rows of the same block.
    order = [F.col("_at").asc_nulls_first(), F.col("_row").isNotNull()]
    within = W.partitionBy("_key", "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = told.withColumn("_piece", F.floor(F.col("_at") / piece)).groupBy("_key", "_piece").agg(F.max_by("_told", "_at").alias("_last"))
    # One row for each key and piece that holds entries or rows.
    pieces = both.select("_key", "_piece").distinct().join(last, ["_key", "_piece"], "left")
    carried = pieces.withColumn("_carried", F.last("_last", ignorenulls=True).over(W.partitionBy("_key").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)))
    found = both.withColumn("_here", F.last("_told", ignorenulls=True).over(within)).where("_row is not null")
    met = found.join(carried.select("_key", "_piece", "_carried"), ["_key", "_piece"], "left")
    return met.select("_row.*", F.coalesce("_here", "_carried")["v"].alias(value))


def owners(reveals: DataFrame, entries: DataFrame, key: str = "hotkey", block: str = "block", owner: str = "coldkey") -> DataFrame:
    """reveals with their owner and ``owner_source``: that of the newest entry of their key, else as of the reveal's block (if over 0), else null.

    entries (key, block, owner): each change of owner, an empty or null owner where a key
    was given up. A reveal without a key or block is only looked up at the head, or not at all.
    """
    plain = entries.withColumn(owner, F.nullif(F.trim(F.col(owner).cast("string")), F.lit("")))
    same = plain.where(F.col(block).isNotNull()).groupBy(key, block).agg(F.max(owner).alias(owner))
    head = same.groupBy(key).agg(F.max_by(F.struct(F.col(owner).alias("o")), block).alias("_head")).select(key, F.col("_head.o").alias("_head"))
    met = reveals.join(head, key, "left")
    dated = as_of(met, plain, key, block, owner)
    then = F.when(F.col(block) > 0, F.col(owner))
    source = F.when(F.col("_head").isNotNull(), "head").when(then.isNotNull(), "reveal_block")
    return dated.withColumn("owner_source", source).withColumn(owner, F.coalesce("_head", then)).drop("_head")
