"""Operator 10, repeated byte strings: prefix doubling over a sparse suffix array.

Every byte covered by a 400-byte string that also starts elsewhere is removed.
A suffix array of all bytes would cost hundreds of bytes of shuffle for each byte
of text, so only chosen suffixes are sorted. Positions are chosen by content: in
each stretch of ``STRETCH`` positions, the one with the least hash of the next
``GRAM`` bytes. Equal strings have equal choices, so of any two equal 400-byte
strings the same chosen position lies in the first STRETCH bytes of both, and
the 400 - STRETCH bytes behind it agree.

Ranks are names (64-bit hashes) of the bytes behind a position. A round pairs the rank
of a position with that of the bytes at a growing offset, has Spark sort the pairs by
range, so that a very common passage spreads over many tasks, drops what is unique and
goes on with the rest at twice the length:
Round 0: GRAM bytes, in the document, by doubling 1, 2, 4, 8, 16; it chooses.
Rounds 1 to 4: 64 bytes, then those 64 behind them, 128 behind those, and the last 17,
  400 - STRETCH + 1 bytes in all. A row carries 16-bit names of the pieces to come, so
  that no round reads a text again; what such a name fails to part, round 5 does.
Round 5: the rank is paired with that of the STRETCH + 399 bytes around the
  position, past the threshold. Where this pair is repeated, all 400-byte strings
  that start in the stretch are, and they are settled.
Round 6: where one rank has several round-5 ranks, the 400-byte strings
  of one member of each are named and counted themselves.

Equal texts are sorted once; every byte of a copied text of 400 bytes or more
goes. Long texts are hashed in blocks.

Defined results: a null text counts as empty; nothing goes from texts under 400
bytes; repeated rows are copies of each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, release_shuffles, ship

ship(__name__)

LENGTH = 400
STRETCH = 128
GRAM = 16
RIGHT = LENGTH - STRETCH + 1
BLOCK = 1 << 18
#: Bytes that rounds 1 to 4 see: offset and end of the piece each adds.
PIECES = [(0, 64), (64, 128), (128, 256), (256, RIGHT)]

BYTE_HASH = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling."""
    h = BYTE_HASH[data]
    size, factor = 1, 0x01000193
    while size < GRAM:
        h = h[:-size] * np.uint32(factor) + h[size:]
        factor = factor * factor & 0xFFFFFFFF
        size *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def extreme(values: np.ndarray, pick) -> np.ndarray:
    """pick (minimum or maximum) over each STRETCH neighbouring values."""
    step = 1
    while step < STRETCH:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def chosen(data: np.ndarray) -> np.ndarray:
    """Places whose gram hash is least in a stretch that lies within data."""
    out = []
    reach = STRETCH + GRAM
    for i in range(0, max(1, len(data) - reach), BLOCK):
        h = gram_hashes(data[i : i + BLOCK + reach])
        if len(h) < STRETCH:
            break
        least = extreme(h, np.minimum)
        padded = np.zeros(len(least) + 2 * (STRETCH - 1), np.uint32)
        padded[STRETCH - 1 : STRETCH - 1 + len(least)] = least
        out.append(np.flatnonzero(extreme(padded, np.maximum) == h) + i)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary or string column, without copying."""
    n = len(column)
    wide = "large" in str(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize) if n else np.zeros(1, kind)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets.astype(np.int64)


#: Texts of so many bytes, or one longer text, are judged at once.
PART = 1 << 20


def parts(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of some PART bytes, whatever batch they came in."""
    bounds = np.flatnonzero(np.diff(offsets[:-1] // PART)) + 1
    edges = [0, *bounds.tolist(), len(offsets) - 1]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def ranked(documents: DataFrame) -> DataFrame:
    """(rank, text_hash, place, piece_1, ...): the chosen places of every text, the name of their first bytes and of the pieces behind."""

    def scan(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as name
        from xxhash import xxh32_intdigest as short

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            view = memoryview(data)
            for lo in range(0, len(keys), 500):
                hi = min(lo + 500, len(keys))
                first = offsets[lo]
                places = chosen(data[first : offsets[hi]]) + first
                row = np.searchsorted(offsets[lo : hi + 1], places, "right") - 1 + lo
                inside = places + RIGHT <= offsets[row + 1]
                places, row = places[inside], row[inside]
                at, n = places.tolist(), len(places)
                a, b = PIECES[0]
                columns = [pa.array(np.fromiter((name(view[p + a : p + b]) for p in at), np.uint64, n).view(np.int64))]
                columns += [pa.array(keys[row], pa.int64()), pa.array((places - offsets[row]).astype(np.int32))]
                columns += [pa.array(np.fromiter((short(view[p + a : p + b]) for p in at), np.uint32, n).astype(np.uint16).view(np.int16)) for a, b in PIECES[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["rank", "text_hash", "place", *NEXT])

    return documents.select("text_hash", "data").mapInArrow(scan, "rank long, text_hash long, place int, " + ", ".join(f"{c} short" for c in NEXT))


NEXT = [f"piece_{i}" for i in range(1, len(PIECES))]


def doubled(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(rank, text_hash, place) of the places whose RIGHT bytes occur elsewhere, by rounds of sorted pairs."""
    left = scratch.save(ranked(documents))
    for n in range(len(PIECES)):
        if n:
            paired = F.xxhash64("rank", NEXT[n - 1])
            left = before.withColumn("rank", paired).drop(NEXT[n - 1])
        found = drop_unique(left, scratch)
        scratch.free(left if n == 0 else before)
        release_shuffles(scratch.spark)
        before = found
    return found


#: Rows of one rank that wait for their neighbours at most.
HELD = 100_000


def drop_unique(ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose rank occurs at several places, sorted by Spark; one row for each place.

    A partition's first and last rank are kept in any case, as their neighbours
    are elsewhere: the rounds to come decide about them.
    """

    names = ["rank", "text_hash", "place", *[c for c in ranks.columns if c not in ("rank", "text_hash", "place")]]

    def mark(batches):
        import pyarrow as pa

        held = None  # rows of the last rank so far
        begun = False
        told = None  # a rank of which rows are out already

        def flush(columns, last):
            nonlocal begun
            rank, key, place = columns[:3]
            new = np.ones(len(rank), bool)
            new[1:] = (rank[1:] != rank[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
            columns = [x[new] for x in columns]
            rank = columns[0]
            same = rank[1:] == rank[:-1]
            keep = np.zeros(len(rank), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if not begun and len(rank):
                keep[0] = True
                begun = True
            if last and len(rank):
                keep[-1] = True
            if told is not None:
                keep |= rank == told
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names)

        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            # The last two rows wait, so that each row is judged beside its neighbours.
            start = np.searchsorted(rows[0], rows[0][-1], "left")
            if start == 0 and len(rows[0]) > HELD:  # one rank fills the batch: all but the last row are repeats
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in rows], names)
                begun, told, held = True, rows[0][-1], [x[-1:] for x in rows]
                continue
            if start:
                yield flush([x[:start] for x in rows], False)
            held = [x[start:] for x in rows]
        if held is not None:
            yield flush(held, True)

    n = max(2, int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["rank", "text_hash", "place"]
    ordered = ranks.select(*names).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return scratch.save(ordered.mapInArrow(mark, ranks.select(*names).schema))


def around(texts: DataFrame) -> DataFrame:
    """Round 5: (rank, wide, text_hash, place, low, high); starts low..high lie in the place's stretch."""

    def scan(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as name

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            view = memoryview(data)
            keys, lists = batch.column(0).to_pylist(), batch.column(2)
            for i, key in enumerate(keys):
                first, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                rows = [[], [], [], [], [], []]
                for a in sorted(set(lists[i].as_py())):
                    low, high = max(0, a - STRETCH + 1), min(a, n - LENGTH)
                    if low > high:
                        continue
                    rows[0].append(name(view[first + a : first + a + RIGHT]) - 2**63)
                    # The offsets take part: only strings cut alike are compared whole.
                    wide = name(view[first + low : first + high + LENGTH], seed=(a - low) * 1024 + (a - high))
                    for column, x in zip(rows[1:], (wide - 2**63, key, a, low, high), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["rank", "wide", "text_hash", "place", "low", "high"])

    return texts.mapInArrow(scan, "rank long, wide long, text_hash long, place long, low long, high long")


def strings_at(texts: DataFrame) -> DataFrame:
    """Round 6: (name, text_hash, start) of the 400-byte strings that start in the given ranges."""

    def scan(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as name

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            view = memoryview(data)
            keys = batch.column(0).to_pylist()
            for i, key in enumerate(keys):
                first = int(offsets[i])
                starts = sorted({p for r in batch.column(2)[i].as_py() for p in range(r["low"], r["high"] + 1)})
                for j in range(0, len(starts), 50_000):
                    part = starts[j : j + 50_000]
                    names = [name(view[first + p : first + p + LENGTH]) - 2**63 for p in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array([key] * len(part), pa.int64()), pa.array(part, pa.int64())],
                        ["name", "text_hash", "start"],
                    )

    return texts.mapInArrow(scan, "name long, text_hash long, start long")


def cut(texts: DataFrame) -> DataFrame:
    """(text_hash, n_removed, n_spans, kept, kept_sha256) of texts with repeated starts (low, high)."""

    def scan(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            keys = batch.column(0).to_pylist()
            for lo, hi in parts(offsets):
                rows = [[], [], [], [], []]
                for i in range(lo, hi):
                    own = data[offsets[i] : offsets[i + 1]]
                    step = np.zeros(len(own) + 1, np.int32)
                    for r in batch.column(2)[i].as_py():
                        step[r["low"]] += 1
                        step[r["high"] + LENGTH] -= 1
                    gone = np.cumsum(step[:-1]) > 0
                    kept = own[~gone].tobytes()
                    values = (keys[i], int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept, hashlib.sha256(kept).hexdigest())
                    for column, x in zip(rows, values, strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["text_hash", "n_removed", "n_spans", "kept", "kept_sha256"]
                )

    return texts.mapInArrow(scan, "text_hash long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def repeated_strings(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Texts with strings repeated outside exact copies: (text_hash, data, ranges of starts), and copied text_hashes."""
    spark = documents.sparkSession
    long = documents.where(F.octet_length("text") >= LENGTH)
    docs = long.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").cast("binary").alias("data"))
    left = doubled(docs, scratch)
    by_text = left.groupBy("text_hash").agg(F.collect_list("place").alias("places"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    light = long.select(F.xxhash64("text").alias("text_hash"), order.alias("doc"))
    copies = scratch.save(light.groupBy("text_hash").agg(F.min("doc").alias("doc"), F.count("*").alias("n")))
    # One row of each text; a repeated row of one id may give it twice, which changes no set below.
    one = by_text.join(copies, "text_hash").select(F.col("text_hash").alias("t"), F.col("doc").alias("d"), "places")
    full = long.select(F.xxhash64("text").alias("text_hash"), order.alias("doc"), F.col("text").cast("binary").alias("data"))
    texts = full.join(one, (F.col("text_hash") == F.col("t")) & (F.col("doc") == F.col("d"))).select("text_hash", "data", "places")
    texts = scratch.save(texts)
    scratch.free(left)
    release_shuffles(spark)
    wide = scratch.save(around(texts).distinct())
    pairs = scratch.save(wide.groupBy("rank", "wide").agg(F.count("*").alias("n")))
    several = pairs.groupBy("rank").agg(F.count("*").alias("kinds")).where("kinds > 1").select("rank")
    # Settled: the round-5 pair is repeated.
    settled = wide.join(pairs.where("n > 1"), ["rank", "wide"], "left_semi").select("text_hash", "low", "high")
    # Not settled: one member of each pair under ranks with several.
    member = wide.groupBy("rank", "wide").agg(F.min(F.struct("text_hash", "low", "high")).alias("m"))
    asked = member.join(several, "rank", "left_semi").select("m.text_hash", "m.low", "m.high").distinct()
    asked = asked.groupBy("text_hash").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    open_texts = texts.select("text_hash", "data").join(asked, "text_hash")
    # One exchange by name; a name has one row per text and start, so none is hot. Neighbours in
    # the order (text, start) differ unless a repeated input row gave a text twice.
    named = strings_at(open_texts)
    by_name = W.partitionBy("name").orderBy("text_hash", "start")
    away = lambda at: (F.col("text_hash") != at("text_hash")) | (F.col("start") != at("start"))
    before = lambda c: F.lag(c).over(by_name)
    after = lambda c: F.lead(c).over(by_name)
    named = named.withColumn("again", F.coalesce(away(before), F.lit(False)) | F.coalesce(away(after), F.lit(False)))
    more = named.where("again").select("text_hash", F.col("start").alias("low"), F.col("start").alias("high"))
    ranges = settled.unionByName(more).distinct()
    ranges = scratch.save(ranges.groupBy("text_hash").agg(F.collect_list(F.struct("low", "high")).alias("ranges")))
    scratch.free(wide, pairs)
    release_shuffles(spark)
    return texts.select("text_hash", "data").join(ranges, "text_hash"), copies.where("n > 1").select("text_hash")


def report_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    scratch = Scratch(documents.sparkSession, "suffixdedup")
    texts, copied = repeated_strings(documents, scratch)
    found = scratch.save(cut(texts).drop("kept")).distinct()
    release_shuffles(documents.sparkSession)
    found = found.select(F.col("text_hash").alias("__t"), "n_removed", "n_spans", "kept_sha256")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64("text").alias("text_hash"), F.sha2(text, 256).alias("own")
    )
    whole = copied.select(F.col("text_hash").alias("__c"))
    far = F.col("__c").isNotNull() & (F.col("n_bytes") >= LENGTH)
    joined = docs.join(found, F.col("text_hash") == F.col("__t"), "left").join(whole, F.col("text_hash") == F.col("__c"), "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(far, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(far, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(far, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )
