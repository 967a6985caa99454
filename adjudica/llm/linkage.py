"""Connected groups from blocks of rows, without all pairs within a block.

Rows that share a block key may be linked; a verify function says which pairs
are. Each block is first compared with one hub only, a central row. Rows known to
be connected need no further comparison with each other, so only blocks that
still hold rows of different components are looked at again. There the row that
shares most with others is a second hub, and only pairs of different components
that pass an exact bound are compared, once each, however many blocks they share.
The groups are those of all pairs of all blocks, while a block of n linked rows
costs n - 1 comparisons.

Blocks are counted and their hubs found by aggregates with partial sums, and
members meet their hub in an equi-join, which adaptive execution splits where a
block is hot. Components come from repeated hooking to the smallest neighbour
and pointer jumping, each round a scratch table in the shared folder that goes
when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release_shuffles

#: Shared blocks of one table that are broadcast at most, 16 bytes each.
BROADCAST = 1_000_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of all ids in edges (a, b); component is the smallest id reachable."""
    both = edges.select("a", "b").where("a <> b")
    left = scratch.save(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        # Every id hooks to its smallest neighbour, if that is smaller than itself.
        ends = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.save(ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).withColumnRenamed("a", "id"))
        moving = True
        while moving:  # pointer jumping to the roots, two jumps a table
            over = up.select(F.col("id").alias("via"), F.col("to").alias("next"))
            once = up.join(over, F.col("to") == F.col("via")).select("id", "to", "next")
            over = up.select(F.col("id").alias("via"), F.col("to").alias("root"))
            twice = once.join(over, F.col("next") == F.col("via")).select("id", F.col("root").alias("to"), (F.col("root") != F.col("next")).alias("moved"))
            jumped = scratch.save(twice)
            moving = not jumped.where("moved").isEmpty()
            scratch.free(up)
            up = jumped
        up_a = up.select(F.col("id").alias("a"), F.col("to").alias("ra"))
        up_b = up.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        rest = left.join(up_a, "a").join(up_b, "b").where("ra <> rb")
        rest = scratch.save(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if labels is None:
            new = up.select("id", F.col("to").alias("component"))
        else:
            moved = up.select(F.col("id").alias("component"), "to")
            new = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        new = scratch.save(new)
        scratch.free(left, labels, up)
        left, labels = rest, new
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    scratch.free(left)
    return labels


def link_blocks(
    members: DataFrame | list[DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    near: Callable | None = None,
    prepare: Callable[[DataFrame], None] | None = None,
    describe: Callable[[DataFrame], DataFrame] | None = None,
    hopeful: Callable | None = None,
    closer: Callable | None = None,
    describe_late: Callable[[], DataFrame] | None = None,
) -> DataFrame:
    """Components (id, component) of the ids that have a link.

    members: (block, id), one row per id and block; in a list, each table has blocks
    of its own and is shuffled by itself. verify takes distinct pairs (a, b) and
    returns (a, b, linked), and ``both``, what the two share, if describe is given.
    prepare is told the ids (id) that may be verified, before the first pair is. near is a
    cheap necessary condition on two accessors of columns; those are by id in what
    describe or describe_late returns. describe makes them from the ids (id) that the
    first star leaves open, for a second star; its column ``met`` tells how much a row shares with others at most, and rows
    that are not hopeful, by one accessor, link with nothing. closer is a further
    necessary condition that also reads ``core``, what a row shares with its block's
    second hub.

    A block's first hub is its member with most rows beside it over all its blocks: one
    in the middle of a group links more of it than one at its edge.
    """
    spark, parts = scratch.spark, []
    for part in [members] if isinstance(members, DataFrame) else members:
        counts = part.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
        if isinstance(members, DataFrame):
            parts.append(scratch.save(part.join(counts, "block")))
        else:  # few of many blocks are shared: their rows are found without a shuffle of the others
            counts = scratch.save(counts)
            few = counts.count() <= BROADCAST
            parts.append(scratch.save(part.join(counts.hint("broadcast" if few else "merge"), "block")))
            scratch.free(counts)
        release_shuffles(spark)
    shared = reduce(DataFrame.unionByName, parts)
    if prepare is not None:
        prepare(shared.select("id").distinct())
    beside = shared.groupBy("id").agg(F.sum("n").alias("beside"))
    hubs = shared.select("block", "id").join(beside, "id").groupBy("block").agg(F.max_by("id", "beside").alias("hub"))
    starred = scratch.save(shared.select("block", "id").join(hubs, "block"))
    scratch.free(*parts)
    links = scratch.save(verify(_pairs(starred.where("id <> hub"), "hub")).where("linked").select("a", "b"))
    groups = components(links, scratch)
    release_shuffles(spark)
    rest = _mixed(starred, groups, scratch)
    scratch.free(starred)
    if rest.isEmpty():
        scratch.free(links, rest)
        return groups
    hub_columns = ["hub"]
    info = describe_late() if describe_late is not None else None
    if describe is not None:
        info = describe(rest.select("id").distinct())
        own = rest.join(info, "id").where(hopeful(F.col))
        middle = own.groupBy("block").agg(F.max_by("id", "met").alias("middle"))
        starred = scratch.save(own.select("block", "id", "hub").join(middle, "block"))
        told = scratch.save(verify(_pairs(starred.where("id <> middle"), "middle")))
        more = scratch.save(links.unionByName(told.where("linked").select("a", "b")))
        scratch.free(links, groups, rest)
        links, groups = more, components(more, scratch)
        side = told.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("both").alias("core"))
        least, most = F.least("middle", "id"), F.greatest("middle", "id")
        cored = starred.join(side, (least == F.col("_a")) & (most == F.col("_b")), "left").select("block", "id", "hub", "middle", "core")
        rest = _mixed(cored, groups, scratch)
        scratch.free(told, starred)
        hub_columns.append("middle")
        release_shuffles(spark)
    if info is not None:
        rest = rest.join(info, "id")
    # Each row knows all its open blocks, so that a pair is met in the first one that it shares.
    rest = rest.join(rest.groupBy("id").agg(F.collect_list("block").alias("in")), "id")
    columns = [c for c in rest.columns if c not in ("block", "id", "component")]
    x = rest.select("block", F.col("id").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"a_{c}") for c in columns])
    y = rest.select("block", F.col("id").alias("b"), F.col("component").alias("cb"), *[F.col(c).alias(f"b_{c}") for c in columns])
    other = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    for h in hub_columns:  # a hub has been compared with its whole block already
        other = other & (F.col("a") != F.col(f"a_{h}")) & (F.col("b") != F.col(f"a_{h}"))
    for bound in (near, closer if "core" in columns else None):
        if bound is not None:
            other = other & bound(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    other = other & (F.array_min(F.array_intersect("a_in", "b_in")) == x["block"])
    late = scratch.save(verify(x.join(y, (x["block"] == y["block"]) & other).select("a", "b")).where("linked").select("a", "b"))
    if not late.isEmpty():
        scratch.free(groups)
        groups = components(links.unionByName(late), scratch)
    scratch.free(late, links, rest)
    release_shuffles(spark)
    return groups


def _pairs(starred: DataFrame, hub: str) -> DataFrame:
    return starred.select(F.least(hub, "id").alias("a"), F.greatest(hub, "id").alias("b")).distinct()


def _mixed(starred: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of blocks that still hold more than one component, with their component."""
    told = starred.join(groups.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = told.groupBy("block").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("block")
    return scratch.save(told.join(mixed, "block"))

