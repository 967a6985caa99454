"""Submissions: gates, queue, champions, weights, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A reign keeps this many champions, the current one included.
CHAIN = 5
# Configuration keys that must not differ, in the order they are tried.
LOCKED_KEYS = [
    "vocab_size", "hidden_size", "num_hidden_layers", "num_attention_heads", "num_key_value_heads", "head_dim",
    "intermediate_size", "model_type", "tie_word_embeddings", "rope_theta", "max_position_embeddings", "max_seq_len",
]


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row per key; the first listed one on ties is the smallest id."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), "id"))).where("_r = 1").drop("_r")


def gate(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with reason: the first rule that holds, or ``queued``."""
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules], F.lit("queued"))
    return rows.withColumn("reason", reason)


def fold_queue(rows: DataFrame) -> DataFrame:
    """(ord, hotkey, digest, reason) of submissions in order.

    A submitter's first row counts, its later ones are seen; of the first rows, one
    digest is queued once. Both firsts are minima with partial sums, so that no key,
    however common, meets in one task; ``ord`` is unique.
    """
    first = rows.groupBy("hotkey").agg(F.min("ord").alias("_first"))
    told = rows.join(first, "hotkey").withColumn("_own", F.col("ord") == F.col("_first"))
    queued = told.where("_own").groupBy("digest").agg(F.min("ord").alias("_queued"))
    told = told.join(queued, "digest", "left")
    reason = F.when(~F.col("_own"), "seen_hotkey").when(F.col("ord") != F.col("_queued"), "digest_already_completed").otherwise("queued")
    return told.select("ord", "hotkey", "digest", reason.alias("reason"))


def requeue_front(queue: DataFrame, entry: DataFrame) -> DataFrame:
    """queue (place from 0, repo, ...) with one entry in front, all others a place on, and other rows of its repository dropped."""
    rest = queue.join(entry.select("repo"), "repo", "left_anti").withColumn("place", (F.col("place") + 1).cast("long"))
    return entry.withColumn("place", F.lit(0).cast("long")).unionByName(rest, allowMissingColumns=True)


def succession(wins: DataFrame, order: str) -> DataFrame:
    """Accepted challengers with their reign number, newest CHAIN of them."""
    numbered = wins.withColumn("reign_number", F.row_number().over(W.orderBy(order)))
    previous = numbered.withColumn("previous_repo", F.lag("model_repo").over(W.orderBy(order)))
    return previous.orderBy(F.desc("reign_number")).limit(CHAIN)


def displace(chain: DataFrame, digest: str, entry: DataFrame) -> DataFrame:
    """Earlier identical weights take the current slot: its digest leaves the chain, its reign number stays."""
    reign = chain.agg(F.max("reign_number").alias("reign_number"))
    return chain.where(F.col("king_digest") != digest).unionByName(entry.crossJoin(reign), allowMissingColumns=True)


def equal_weights(chain: DataFrame, registered: DataFrame, fallback_uid: int) -> DataFrame:
    """(uid, weight): 1 / n among the chain's registered submitters, once each; all to the fallback if there are none."""
    first = chain.groupBy("hotkey").agg(F.min("place").alias("place")).join(registered, "hotkey")
    weights = first.select("uid", (F.lit(1.0) / F.count("*").over(W.partitionBy())).alias("weight"))
    spare = chain.sparkSession.createDataFrame([(fallback_uid, 1.0)], "uid long, weight double")
    none = first.agg(F.count("*").alias("n")).where("n = 0").select()
    return weights.unionByName(spare.crossJoin(none))


def payout(rows: DataFrame, emission: str, blocks_per_hour: int, price: float) -> DataFrame:
    """Projected pay: per hour in tokens and in currency, in full and in equal shares."""
    n = F.greatest(F.count("*").over(W.partitionBy()), F.lit(1))
    hour = F.col(emission) * blocks_per_hour
    return rows.withColumn("per_hour", F.round(hour, 6)).withColumn("usd_per_hour", F.round(hour * price, 4)).withColumn("equal_per_hour", F.round(hour / n, 6)).withColumn("weight_share", F.round(1.0 / n, 9))


def refresh(history: DataFrame, current: DataFrame) -> DataFrame:
    """history with the submitter's uid of now (none if gone) and owner of now, else the stored owner."""
    now = current.select("hotkey", F.col("uid").alias("_uid"), F.col("coldkey").alias("_cold"))
    joined = history.drop("uid").join(now, "hotkey", "left")
    return joined.withColumn("coldkey", F.coalesce("_cold", "coldkey")).withColumnRenamed("_uid", "uid").drop("_cold")


def is_failed(accepted: Column, verdict: Column, code: Column) -> Column:
    return ~F.coalesce(accepted, F.lit(False)) & ((F.coalesce(verdict, F.lit("")) == "error") | code.isNotNull())


def newest(rows: DataFrame, test: Column, order: str, n: int, key: str | None = None) -> DataFrame:
    """The newest n rows that pass, one per key."""
    kept = rows.where(test)
    if key:
        kept = kept.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return kept.orderBy(F.desc(order)).limit(n)


def config_mismatches(a: DataFrame, b: DataFrame, key: str, strict: bool) -> DataFrame:
    """Long rows (key, field, value) of two sides: fields that differ.

    strict: absent differs from present. Otherwise a field that is null on either side is let pass.
    """
    x = a.select(key, "field", F.col("value").alias("left_value"))
    y = b.select(key, "field", F.col("value").alias("right_value"))
    both = x.join(y, [key, "field"], "full_outer")
    differ = ~F.col("left_value").eqNullSafe(F.col("right_value"))
    if not strict:
        differ = differ & F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    return both.where(differ)


def first_mismatch(mismatches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    return mismatches.groupBy(key).agg(F.min_by("field", place).alias("field"))


def code_policy(files: Column, allowed: list[str], auto_map: Column, expected: dict[str, str]) -> Column:
    """Reason why a repository's code is refused, or null."""
    extra = F.array_except(F.filter(files, lambda f: F.endswith(f, F.lit(".py"))), F.array(*map(F.lit, allowed)))
    keys = F.array_sort(F.map_keys(auto_map)) != F.array_sort(F.array(*map(F.lit, expected)))
    other = F.lit(False)
    for k, v in expected.items():
        other = other | ~F.try_element_at(auto_map, F.lit(k)).eqNullSafe(F.lit(v))
    return F.when(F.size(extra) > 0, F.concat(F.lit("unexpected file: "), F.get(F.array_sort(extra), F.lit(0)))).when(keys, F.lit("auto_map keys differ")).when(other, F.lit("auto_map values differ"))


def layout(files: DataFrame, folder: str) -> DataFrame:
    """Per folder: single, sharded (index and all numbered shards) or incomplete; and its size."""
    name = F.col("name")
    shard = F.rlike(name, F.lit(r"^model-\d{5}-of-\d{5}\.safetensors$"))
    wanted = F.max(F.when(shard, F.regexp_extract(name, r"-of-(\d{5})", 1).cast("int")))
    g = files.groupBy(folder).agg(
        F.max((name == "model.safetensors").cast("int")).alias("one"), F.max((name == "model.safetensors.index.json").cast("int")).alias("index"),
        F.count_if(shard).alias("shards"), wanted.alias("wanted"), F.max((name == "config.json").cast("int")).alias("config"), F.sum("length").alias("bytes"),
    )
    kind = F.when((F.col("config") == 0), "incomplete").when(F.col("one") == 1, "single").when((F.col("index") == 1) & (F.col("shards") == F.col("wanted")), "sharded").otherwise("incomplete")
    return g.select(folder, kind.alias("layout"), "bytes")
