"""Operator 4, near-duplicates: min-max hashing, banding, exact confirmation.

A document's set holds its distinct shingles of five words. Each of
``PERMUTATIONS`` permutations is evaluated once per shingle and both its minimum
and its maximum are kept, so 64 evaluations give a signature of 128 values.
Minima and maxima form separate bands of ``ROWS`` values; two sets with
similarity s share no band with probability (1 - s^4)^32, 5e-6 at 0.75.

Documents with equal sets are one class and meet once. Classes that share a band
are compared by ``linkage.link_blocks``: with the band's smallest class first,
then across what is still apart. A link is confirmed on the full sets of both
texts. Class ids are 64-bit digests of the sorted set.

Defined results: a null text, or one without words, has an empty set and links
with nothing; with fewer than five words the whole sequence is the one shingle;
texts are read whole; repeated rows form a class; a null doc_id can be linked
but never names a component unless all ids in it are null; extra columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release_shuffles, ship
from .linkage import link_blocks

ship(__name__)

SHINGLE = 5
PERMUTATIONS = 64
ROWS = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
CACHE_WORDS = 1_000_000


class WordHash(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.lower and bytes.split know ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


_RANDOM = np.random.default_rng(20240601)
MULTIPLIERS = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RANDOM.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)


def bands(values: np.ndarray) -> np.ndarray:
    """Band keys of a set's min-max signature; x -> a * x + b with odd a permutes the 64-bit range."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(values), 1024):
        product = values[i : i + 1024, None] * MULTIPLIERS + ADDENDS
        np.minimum(low, product.min(0), out=low)
        np.maximum(high, product.max(0), out=high)
    rows = np.concatenate([low, high]).reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for i in range(ROWS):
        key = (key ^ (key >> np.uint64(31)) ^ rows[:, i]) * np.uint64(0x9FB21C651E98DF25)
    return (key ^ (key >> np.uint64(28))).view(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, bands) of every row; set_id and bands are null for empty sets."""
    schema = "doc_id long, text_hash long, n_shingles long, set_id long, bands array<long>"

    def scan(batches):
        import pyarrow as pa
        import xxhash

        hashes = WordHash()
        for batch in batches:
            n, ids, keys = [], [], []
            for text in batch.column(2):
                values = shingles(text.as_py(), hashes)
                n.append(len(values))
                if len(values):
                    ids.append(xxhash.xxh3_64_intdigest(values.tobytes()) - 2**63)
                    keys.append(bands(values))
                else:
                    ids.append(None)
                    keys.append(None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_id", "bands"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) of whole texts (id, text)."""

    def scan(batches):
        import pyarrow as pa

        hashes = WordHash()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                values = shingles(text.as_py(), hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))], ["id", "shingles"]
                )

    return texts.mapInArrow(scan, "id long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``both``, the size of their intersection, and whether they are linked. sets: (id, shingles)."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    told = pairs.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sizes"))
    return told.select("a", "b", "both", (100 * F.col("both") >= PERCENT * (F.col("sizes") - F.col("both"))).alias("linked"))


def may_link(x, y):
    """Necessary for a link: an intersection cannot exceed what either set shares with any other.

    inter >= p * union is the same as inter * (1 + p) >= p * (sizes together).
    """
    return F.least(x("met"), y("met")) * (100 + PERCENT) >= (x("n") + y("n")) * PERCENT


def may_link_any(x):
    """Necessary for a link with any row: the intersection is at least that share of the row itself."""
    return x("met") * 100 >= x("n") * PERCENT


def may_link_beside(x, y):
    """The same bound taken apart: inside the set of the block's hub, and outside of it.

    The hub itself has no core and has been compared with all.
    """
    outside = F.least(x("met") - x("core"), y("met") - y("core"))
    return (F.least(x("core"), y("core")) + outside) * (100 + PERCENT) >= (x("n") + y("n")) * PERCENT


def near_duplicates(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (smallest id reachable) and kept, for every row."""
    scratch = scratch or Scratch(documents.sparkSession, "neardup")
    signed = scratch.save(signatures(documents))
    far = 2**63 - 1
    order = F.coalesce("doc_id", F.lit(far))
    classes = signed.where("set_id is not null").select("set_id", order.alias("order"), "text_hash").groupBy("set_id")
    classes = scratch.save(classes.agg(F.min("order").alias("first"), F.min_by("text_hash", "order").alias("text_hash")))
    # One row of each class carries its bands.
    chosen = signed.withColumn("order", order).join(classes.select("set_id", F.col("first").alias("order"), "text_hash"), ["set_id", "order", "text_hash"])
    members = chosen.select(F.col("set_id").alias("id"), F.explode("bands").alias("block")).distinct()
    all_rows = scratch.save(signed.drop("bands"))
    sets: list[DataFrame] = []

    def prepare(ids: DataFrame) -> None:
        """Sets of all classes that share a band, from whole texts, made once."""
        scratch.free(signed)
        needed = ids.join(classes, ids["id"] == classes["set_id"]).select("id", "first", F.col("text_hash").alias("key"))
        docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(far)).alias("order"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
        # One plan at every size: a broadcast here would turn into a shuffle of the texts as pairs grow.
        texts = docs.join(needed.hint("merge"), (F.col("order") == F.col("first")) & (F.col("text_hash") == F.col("key"))).select("id", "text")
        made = scratch.save(shingle_sets(texts))
        release_shuffles(scratch.spark)
        # A repeated row of one id gives its set twice.
        sets.append(made.dropDuplicates(["id"]) if made.count() != needed.count() else made)

    def verify(pairs: DataFrame) -> DataFrame:
        return confirm(pairs, sets[0])

    def describe(ids: DataFrame) -> DataFrame:
        """(id, n, met): set size, and how many of its shingles another of these sets holds too."""
        each = sets[0].join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("shingle"))
        often = each.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1").select("shingle")
        met = each.join(often, "shingle").groupBy("id").agg(F.count("*").alias("met"))
        sizes = sets[0].join(ids, "id", "left_semi").select("id", F.size("shingles").cast("long").alias("n"))
        return scratch.save(sizes.join(met, "id", "left").select("id", "n", F.coalesce("met", F.lit(0).cast("long")).alias("met")))

    groups = link_blocks(members, verify, scratch, near=may_link, prepare=prepare, describe=describe, hopeful=may_link_any, closer=may_link_beside)
    # Names of components, by class first: at most one row per class meets here.
    groups = groups.select(F.col("id").alias("set_id"), "component")
    named = classes.select("set_id", "first").join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    names = named.groupBy("component").agg(F.min("first").alias("name"))
    of_class = named.join(names, "component").select("set_id", F.when(F.col("name") != far, F.col("name")).alias("component_id"))
    linked = all_rows.where("set_id is not null").join(of_class, "set_id").drop("set_id")
    alone = all_rows.where("set_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    found = scratch.save(linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    scratch.free(all_rows, classes, groups, *sets)
    release_shuffles(scratch.spark)
    return found


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """documents with one row of each group; columns as they came."""
    scratch = Scratch(documents.sparkSession, "neardup")
    kept = near_duplicates(documents, scratch).where("kept")
    kept = scratch.save(kept.groupBy("doc_id", "text_hash", "n_shingles").agg(F.count("*").alias("__n")))
    keys = kept.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.when(F.col("n_shingles") > 0, F.col("__n")).otherwise(1).alias("__n"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    if keys.where("__n > 1").isEmpty():
        return documents.join(keys, same, "left_semi")
    # Repeated rows: the same id and text more than once; one of them stays.
    once = documents.join(keys.where("__n = 1"), same, "left_semi")
    again = documents.join(keys.where("__n > 1"), same, "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))
