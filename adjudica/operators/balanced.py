"""A sample balanced over sources and, within each, over shards; and windows packed until there are enough.

Two levels of quotas: each source gets its part of the total, and that part is shared
equally by its shards in a seeded order. A shard is read beyond its share where a
vocabulary bound may drop sequences; shards behind the shared ones are read only while
the source is short, for what it lacks. What each shard gives follows from a few numbers:
how many rows it has, and at which places of its own order those stand that the bound drops.
So one aggregate over the candidates is folded along each source's list of shards, and
only rows that are taken are joined back. No shard is sorted beyond what a source can ask
of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import sampling

# How far beyond its share a shard is read when a vocabulary bound applies.
OVER, EXTRA = 1.5, 8


@dataclass(frozen=True)
class Balance:
    """shards_per_source: shards that share a source's part, 0 for all of them. Zero turns the other bounds off."""

    total: int
    seed: str
    vocabulary: int = 0
    shards_per_source: int = 0
    max_per_shard: int = 0
    max_shards: int = 0
    weights: tuple[float, ...] = ()

    def reads(self, share: int) -> int:
        """Rows of a shard that are looked at for so many wanted ones."""
        share = min(share, self.max_per_shard) if self.max_per_shard > 0 else share
        return int(share * OVER) + EXTRA if self.vocabulary > 0 else share


def shard_orders(shards: DataFrame, balance: Balance) -> DataFrame:
    """(source, shard, nth): each source's shards in seeded order, from 0, ``max_shards`` at most."""
    w = W.partitionBy("source").orderBy(sampling.hash_order(balance.seed, "source", "shard"), "shard")
    placed = shards.select("source", "shard").distinct().withColumn("nth", F.row_number().over(w) - 1)
    return placed.where(F.col("nth") < balance.max_shards) if balance.max_shards > 0 else placed


def fold_source(shards: pd.DataFrame, target: int, balance: Balance) -> list[tuple[str, int, int]]:
    """(shard, rows read, rows taken) along one source's shards (shard, n_rows, dropped: places of bad rows, from 1)."""
    sharing = min(balance.shards_per_source, len(shards)) if balance.shards_per_source > 0 else len(shards)
    base, more = divmod(target, max(1, sharing))
    have, out = 0, []
    for i, (shard, n_rows, dropped) in enumerate(zip(shards["shard"], shards["n_rows"], shards["dropped"], strict=True)):
        if have >= target:
            break
        share = base + (i < more) if i < sharing else target - have
        read = min(n_rows, balance.reads(share))
        good = read - sum(p <= read for p in dropped)
        out.append((shard, int(read), int(min(good, target - have))))
        have += good
    return out


def balanced_sample(rows: DataFrame, balance: Balance, index: str = "idx", largest: str = "largest") -> DataFrame:
    """rows (source, shard, idx, largest, ...) of the sample with ``place``, its position in the joint shuffle.

    ``largest``: a sequence's largest token, held against the vocabulary bound. Sources
    are taken in name order, for weights by position. A source that cannot give its part
    is an error. Null sources, shards and indices take no part.
    """
    rows = rows.where(F.col("source").isNotNull() & F.col("shard").isNotNull() & F.col(index).isNotNull())
    sources = rows.select("source").distinct().withColumn("idx", F.row_number().over(W.orderBy("source")) - 1)  # a row for each source
    n_sources = len(balance.weights)
    quotas = sampling.source_quotas(sources, balance.total, list(balance.weights), n_sources).select("source", "quota")
    if balance.weights and (found := sources.count()) != n_sources:
        quotas = sampling.equal_quotas(sources, balance.total).select("source", "quota") if found else quotas
    order = W.partitionBy("source", "shard").orderBy(sampling.hash_order(balance.seed, "source", "shard", index), index)
    most = balance.reads(balance.total)  # no shard is asked for more
    good = F.col(largest) < balance.vocabulary if balance.vocabulary > 0 else F.lit(True)
    near = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).withColumn("_good", F.coalesce(good, F.lit(False)))
    counts = near.groupBy("source", "shard").agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_list(F.when(~F.col("_good"), F.col("_n")))).alias("dropped"))
    listed = shard_orders(rows, balance).join(counts, ["source", "shard"]).join(quotas, "source")
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        made = fold_source(pdf, int(pdf["quota"].iloc[0]), balance)
        return pd.DataFrame([(pdf["source"].iloc[0], *m) for m in made], columns=["source", "shard", "reads", "takes"])

    # A group is one source's list of shards: a row for each shard, none for its sequences.
    plan = listed.groupBy("source").applyInPandas(run, f"source {kinds['source']}, shard {kinds['shard']}, reads long, takes long")
    short = quotas.join(plan.groupBy("source").agg(F.sum("takes").alias("got")), "source", "left").where(F.coalesce("got", F.lit(0)) < F.col("quota"))
    if lacking := short.orderBy("source").limit(20).collect():
        raise ValueError("; ".join(f"source {r['source']} has only {r['got'] or 0} of {r['quota']} sequences" for r in lacking))
    read = near.join(plan, ["source", "shard"]).where("_n <= reads and _good")
    taken = read.withColumn("_k", F.row_number().over(W.partitionBy("source", "shard").orderBy("_n"))).where("_k <= takes")
    joint = W.orderBy(sampling.hash_order(f"{balance.seed}|joint", "source", "shard", index), "source", "shard", index)
    return taken.select(*rows.columns).withColumn("place", F.row_number().over(joint) - 1)  # ``total`` rows
