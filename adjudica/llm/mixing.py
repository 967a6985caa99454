"""Operator 6, mixing sources to target weights by systematic sampling.

Sources, by code point with null last, weigh 1, 2, 3, repeating. Their targets
share the total size; a target stops at ``MAX_REPEATS`` times its source's size
and what it leaves is shared by weight among the others (water filling).

Within a source every document expects target / source_size copies. Documents
stand in one order, by size class and then by hash of the id, so that every
size is sampled at the same rate. Expected copies are summed along that order,
one offset per source is added, and a document is emitted once per integer
boundary that its share of the sum crosses.

The sum needs only a document's rank. Ranks are dealt out in pieces: documents of
one source, size class and hash range. Piece counts are summed first (a few rows
for each shuffle partition), so no source, however large, meets in one task, and
the order does not depend on how many pieces there are.

Defined results: null and empty texts have size 0 and are not emitted; a table or
source without words has target 0; repeated rows of one id stand side by side in
the order and each has its own share; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, word_count

MAX_REPEATS = 3
WEIGHT_CYCLE = 3
SEED = "mix-1"
#: Tables with a row for each source, or source and size class, are broadcast up to this many rows.
MAX_BROADCAST_SOURCES = 200_000
#: 2 ** 32, the range of the hash that orders documents.
RANGE = 4294967296


def hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs -> with weight and target. One row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % WEIGHT_CYCLE + 1).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(MAX_REPEATS)))
    # Sources reach their caps in the order of cap / weight. With the first k capped, the others
    # get level x weight; the source is capped if that level exceeds its own cap / weight.
    by_fill = W.orderBy("fill", F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before"))
    filled = (
        w.withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("capped", F.col("level") >= F.col("fill"))
        .withColumn("open_level", F.min(F.when(~F.col("capped"), F.struct("fill", "source", "level"))).over(every)["level"])
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open_level") * F.col("weight"))
    return filled.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def size_class(size: Column) -> Column:
    """0 for no words, then sixteen classes for each doubling."""
    return F.when(size <= 0, F.lit(0)).otherwise(F.floor(F.log2(size.cast("double")) * 16) + 1).cast("int")


def mix_sources(documents: DataFrame) -> DataFrame:
    """Every document with size, source_size, target, and copies: how often the mix emits it."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    order = hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    light = scratch.save(sized.withColumn("_class", size_class(F.col("size"))).withColumn("_hash", order))
    classes = scratch.save(light.groupBy("source", "_class").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    sizes = classes.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"), F.sum("n").alias("n_docs"))
    few = classes.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    table = hint(targets(sizes).withColumnRenamed("source", "_source"))
    # Pieces of about a quarter of a partition's fair share.
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 200)
    total = classes.agg(F.sum("n").alias("_all"))
    pieces = classes.crossJoin(F.broadcast(total)).select(
        F.col("source").alias("_source"),
        F.col("_class").alias("_c"),
        F.ceil(F.col("n") * parts / F.greatest("_all", F.lit(1))).cast("long").alias("_pieces"),
    )
    # At most the number of sources times some 300 classes: a table of counts, not of documents.
    cut = light.join(hint(pieces), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_c")))
    cut = cut.drop("_source", "_c").withColumn("_salt", F.floor(F.col("_hash") * F.col("_pieces") / RANGE))
    counts = cut.groupBy("source", "_class", "_salt").agg(F.count("*").alias("n"))
    along = W.partitionBy("source").orderBy("_class", "_salt").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(
        F.col("source").alias("_source"), F.col("_class").alias("_c"), F.col("_salt").alias("_s"),
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_before"),
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_c")) & (F.col("_salt") == F.col("_s"))
    placed = cut.join(before, same).drop("_source", "_c", "_s")
    within = W.partitionBy("source", "_class", "_salt").orderBy("_hash", "doc_id", "size")
    ranked = placed.withColumn("rank", F.col("_before") + F.row_number().over(within))
    joined = ranked.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hash32(F.concat(F.lit(SEED), F.coalesce("source", F.lit("")))) / RANGE
    copies = F.floor(F.col("rank") * rate + offset) - F.floor((F.col("rank") - 1) * rate + offset)
    return joined.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"))


def take(documents: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is drawn, columns as they came."""
    scratch = Scratch(documents.sparkSession, "mixing")
    # Rows of one id, source and size are drawn together; their copies are dealt out by text.
    drawn = mix_sources(documents).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__copies"))
    drawn = scratch.save(drawn.where(F.get("__copies", F.lit(0)) > 0))
    drawn = drawn.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), "__copies")
    keyed = documents.withColumn("__words", word_count(F.col("text")))
    same = (
        F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__words") == F.col("__n"))
    )
    alone = F.size("__copies") == 1
    times = keyed.join(drawn.where(alone), same).withColumn("__times", F.get("__copies", F.lit(0)))
    if not drawn.where(~alone).isEmpty():
        # Only repeated rows need to be numbered; the texts of all others are not sorted.
        several = keyed.join(drawn.where(~alone), same)
        nth = F.row_number().over(W.partitionBy("doc_id", "source", "__words").orderBy(F.xxhash64("text")))
        times = times.unionByName(several.withColumn("__times", F.coalesce(F.get("__copies", nth - 1), F.lit(0))))
    times = times.where("__times > 0")
    return times.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*documents.columns)
