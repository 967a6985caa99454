"""Operator 13, centroid clustering: Lloyd's rounds filtered through kd-trees, in whole numbers.

Vectors are cut into pieces of at most ``TREE_ROWS`` rows, and each piece becomes a
kd-tree, once: a node splits at the median of its widest component and holds its
number of vectors, their component sums and their bounding box. A round sends the
centroids, k of them, down every tree. Of a node's candidates the one nearest the
middle of its box is held against each other one at that corner of the box which
favours the other most; a candidate that is strictly farther there is farther from
every vector of the node and goes. A node with one candidate left gives its count
and sums whole; a leaf with several is settled vector by vector. What leaves a task
is one count and one sum for each centroid and component.

All values are integers, so neither the split of the table into pieces nor the order
of the sums shows in the result; ties go to the smaller number, in leaves as in
nodes, for only strictly worse candidates are dropped.

Trees are tables in the shared folder: a lost executor costs a repeated task. Only
centroids, k rows of ``DIMENSIONS`` numbers, pass through the driver.

Defined results: vectors that are null, of another length, with a null or non-finite
component, or with a component beyond ``LIMIT`` in size (where squared distances
would leave 64 bits) are left out; repeated rows count as often as they occur; a
null vec_id is hashed as none and sorts last; equal hashes are ordered by the vector;
with fewer than k vectors there are as many centroids as vectors; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

ship(__name__)

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Largest component in size, after scaling: differences of squares of 64 components stay below 2 ** 63.
LIMIT = 2**26
TREE_ROWS = 8192
LEAF_ROWS = 16

TREE = "vec_ids binary, known binary, vectors binary, first binary, last binary, left binary, low binary, high binary, sums binary"
PARTS = ("vec_ids", "known", "vectors", "first", "last", "left", "low", "high", "sums")


def quantise(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of floor(SCALE * x)."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LIMIT / SCALE))
    fits = (F.size("embedding") == dimensions) & F.coalesce(good, F.lit(False))
    return embeddings.where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def grow(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A kd-tree over the rows: their order, and for each node first and last row, left child (-1: leaf), box and sums.

    The right child follows the left one; parents come before their children.
    """
    order = np.arange(len(vectors))
    first, last, left, low, high, sums = [0], [len(vectors)], [], [], [], []
    at = 0
    while at < len(first):
        a, b = first[at], last[at]
        rows = vectors[order[a:b]]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        low.append(lo)
        high.append(hi)
        sums.append(rows.sum(axis=0))
        if b - a <= LEAF_ROWS or (lo == hi).all():
            left.append(-1)
        else:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, np.argmax(hi - lo)], half, kind="introselect")]
            left.append(len(first))
            first += [a, a + half]
            last += [a + half, b]
        at += 1
    return {
        "order": order, "first": np.array(first), "last": np.array(last), "left": np.array(left),
        "low": np.array(low), "high": np.array(high), "sums": np.array(sums),
    }


def survivors(low: np.ndarray, high: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which candidates (nodes x k) no other candidate strictly dominates over the node's box."""
    middle = (low + high)[:, None, :] - 2 * centroids[None, :, :]
    # Twice the distance to the middle, in floating point: it only says against whom to test.
    near = np.where(open_, np.square(middle.astype(np.float64)).sum(axis=2), np.inf).argmin(axis=1)
    best = centroids[near][:, None, :]
    other = centroids[None, :, :]
    corner = np.where(other > best, high[:, None, :], low[:, None, :])
    # |other - corner|^2 - |best - corner|^2, a sum of exact products
    worse = ((other - best) * (other + best - 2 * corner)).sum(axis=2) > 0
    return open_ & ~worse


def descend(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The cluster of each row in tree order (-1: still open), and the nodes (node, cluster) that were given whole."""
    clusters = np.full(len(tree["vectors"]), -1, np.int32)
    whole: list[tuple[int, int]] = []
    nodes, open_ = np.array([0]), np.ones((1, len(centroids)), bool)
    while len(nodes):
        open_ = survivors(tree["low"][nodes], tree["high"][nodes], open_, centroids)
        settled = open_.sum(axis=1) == 1
        for node, c in zip(nodes[settled].tolist(), open_[settled].argmax(axis=1).tolist(), strict=True):
            clusters[tree["first"][node] : tree["last"][node]] = c
            whole.append((node, c))
        nodes, open_ = nodes[~settled], open_[~settled]
        leaf = tree["left"][nodes] < 0
        for node, mask in zip(nodes[leaf].tolist(), open_[leaf], strict=True):
            a, b = tree["first"][node], tree["last"][node]
            at = np.flatnonzero(mask)
            gap = tree["vectors"][a:b, None, :] - centroids[None, at, :]
            clusters[a:b] = at[(gap * gap).sum(axis=2).argmin(axis=1)]
        inner = tree["left"][nodes[~leaf]]
        nodes, open_ = np.concatenate([inner, inner + 1]), np.concatenate([open_[~leaf], open_[~leaf]])
    return clusters, whole


def totals(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and component sums by centroid: whole nodes give their stored sums, open leaves their rows."""
    clusters, whole = descend(tree, centroids)
    counts = np.bincount(clusters, minlength=len(centroids)).astype(np.int64)
    sums = np.zeros((len(centroids), centroids.shape[1]), np.int64)
    by_row = np.ones(len(clusters), bool)
    for node, c in whole:
        sums[c] += tree["sums"][node]
        by_row[tree["first"][node] : tree["last"][node]] = False
    np.add.at(sums, clusters[by_row], tree["vectors"][by_row])
    return counts, sums


def unpack(row: dict[str, bytes], dimensions: int) -> dict[str, np.ndarray]:
    tree = {k: np.frombuffer(row[k], np.int64) for k in PARTS if k != "known"}
    for k in ("vectors", "low", "high", "sums"):
        tree[k] = tree[k].reshape(-1, dimensions)
    return tree | {"known": np.frombuffer(row["known"], np.bool_)}


def trees(vectors: DataFrame, dimensions: int) -> DataFrame:
    """A kd-tree for every ``TREE_ROWS`` rows of each partition."""

    def run(batches):
        ids, rows, held = [], [], 0

        def close():
            known = np.concatenate([i[0] for i in ids])
            vec_ids, v = np.concatenate([i[1] for i in ids]), np.concatenate(rows)
            for at in range(0, len(v), TREE_ROWS):
                tree = grow(v[at : at + TREE_ROWS])
                order = tree["order"] + at
                tree |= {"vec_ids": vec_ids[order], "known": known[order], "vectors": v[order]}
                yield pa.RecordBatch.from_pydict({k: pa.array([np.ascontiguousarray(tree[k]).tobytes()], pa.binary()) for k in PARTS})

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
            column = batch.column("vec_id")
            ids.append((column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)))
            rows.append(v)
            held += len(v)
            if held >= TREE_ROWS:
                yield from close()
                ids, rows, held = [], [], 0
        if held:
            yield from close()

    return vectors.select("vec_id", "v").mapInArrow(run, TREE)


def move(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dimensions = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                n, s = totals(unpack(row, dimensions), centroids)
                counts += n
                sums += s
        cells = k * (dimensions + 1)
        each = np.concatenate([counts[:, None], sums], axis=1).reshape(-1)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(cells), pa.int32()), "value": pa.array(each)})

    parts = forest.mapInArrow(run, "cell int, value long")
    # Longer than 64 bits, for sums over all partitions; k x (components + 1) rows come back.
    found = parts.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("value")).collect()
    table = np.zeros(k * (dimensions + 1), object)
    for r in found:
        table[r["cell"]] = int(r["value"])
    table = table.reshape(k, dimensions + 1)
    moved = centroids.copy()
    for c in range(k):
        if table[c, 0]:
            moved[c] = [int(s // table[c, 0]) for s in table[c, 1:]]
    return moved


def assign(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dimensions = centroids.shape[1]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tree = unpack(row, dimensions)
                clusters, _ = descend(tree, centroids)
                gap = tree["vectors"] - centroids[clusters]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(tree["vec_ids"], pa.int64(), mask=~tree["known"]),
                    "cluster": pa.array(clusters, pa.int32()),
                    "distance": pa.array((gap * gap).sum(axis=1), pa.int64()),
                })

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids (k x components)."""
    scratch = Scratch(embeddings.sparkSession, "kdmeans")
    vectors = quantise(embeddings, dimensions)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(len(start), dimensions)
    forest = scratch.save(trees(vectors, dimensions))
    if len(centroids):
        for _ in range(rounds):
            centroids = move(forest, centroids)
        assigned = scratch.save(assign(forest, centroids))
    else:
        assigned = embeddings.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long")
    scratch.free(forest)
    return assigned, centroids


def report_clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Every vector with its cluster, squared distance, the inertia of its cluster and of all, and its centroid's digest."""
    assigned, centroids = cluster_vectors(embeddings, k, rounds, seed)
    spark = embeddings.sparkSession
    by = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist()) if c in by]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows at most
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
