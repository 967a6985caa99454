"""Shard manifests: totals, coverage, repair, merge, mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DONE = ["completed", "merged"]


def totals(shards: DataFrame, keys: list[str]) -> DataFrame:
    return shards.groupBy(*keys).agg(F.count("*").alias("total_shards"), F.sum("n_tokens").cast("long").alias("total_tokens"))


def manifest(shards: DataFrame, tokenizer: str, version: str = "v3") -> DataFrame:
    """One document: version, tokenizer, totals and the shard list in key order (bounded by the shard count)."""
    entry = F.struct(*sorted(c for c in shards.columns))
    return shards.agg(
        F.lit(version).alias("version"), F.lit(tokenizer).alias("tokenizer"), F.lit("uint32").alias("dtype"),
        F.count("*").alias("total_shards"), F.sum("n_tokens").cast("long").alias("total_tokens"), F.sort_array(F.collect_list(entry)).alias("shards"),
    )


def put(document: DataFrame, path: str) -> None:
    """Write one JSON document; Spark's commit makes it whole or absent."""
    document.coalesce(1).write.mode("overwrite").json(path)


def pending(files: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return files.join(completed.select(key), key, "left_anti")


def coverage(expected: DataFrame, seen: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """(key, reason): missing files first, then failed ones that were not seen; each once. That is the repair list."""
    missing = expected.select(key).distinct().join(seen.select(key), key, "left_anti").withColumn("reason", F.lit("missing"))
    again = failed.select(key).distinct().join(seen.select(key), key, "left_anti").withColumn("reason", F.lit("failed"))
    both = missing.unionByName(again)
    return both.groupBy(key).agg(F.max("reason").alias("reason"))


def duplicates(parts: DataFrame, key: str) -> DataFrame:
    """Keys that several parts list; a merge with any is refused."""
    return parts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def in_order(parts: DataFrame, source_order: DataFrame, key: str) -> DataFrame:
    """Shards by their source's order, then key, with their place."""
    joined = parts.join(source_order, "source")
    return joined.withColumn("place", F.row_number().over(W.orderBy("ord", key)))


def class_counts(rows: DataFrame, status: Column, classes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows, and rows of each status, as one count per column."""
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("requested"), *[F.count_if(status == c).alias(c) for c in classes])


def existing(wanted: DataFrame, there: DataFrame, key: str, size: str) -> DataFrame:
    """wanted with state: ok, wrong_size or missing at the destination."""
    other = there.select(F.col(key), F.col(size).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("_there") != F.col(size), "wrong_size").otherwise("ok")
    return wanted.join(other, key, "left").withColumn("state", state).drop("_there")


def destination(key: Column, old: str, new: str) -> Column:
    """key below another prefix."""
    return F.when(F.startswith(key, F.lit(old)), F.concat(F.lit(new), F.substring(key, F.lit(len(old) + 1), F.length(key)))).otherwise(F.concat(F.lit(new), key))
