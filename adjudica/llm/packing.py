"""Operator 11, packing: windows filled by minimum bin slack over remaining lengths.

Every document is its token ids and an end mark. What fills windows by itself is cut
off in whole windows; of each document a rest of fewer tokens than a window remains.
Rests are packed by their lengths alone, and there are at most capacity - 1 lengths,
however many documents. A window takes the longest rest and, of all multisets of the
others, one that leaves the least slack: a bitset subset-sum over the lengths at
hand, bounded by their counts, walked back from the longest length. The same multiset
is used as often as the counts allow, so the number of plans follows the number of
lengths and not that of documents. If no multiset fills the window, all that is left
is longer than its slack: a rest is cut there, and what remains of it is a length
like any other. The last tokens, fewer than a window, are laid into sequences of
powers of two, which need no padding.

The plan is made on the driver from one count per length. Documents find their place
in it by their rank among those of one length: a running count within the task that
tokenised them, plus a sum over the tasks before, so no length meets in one task.

Defined results: null and empty texts are the end mark alone; repeated rows and
null ids are packed each by itself; texts are encoded whole; an empty table gives no
piece; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import encoders
from .common import Scratch, ship

ship(__name__)

CAPACITY = 1024
END = 0
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Slot:
    """Where rests of length ``rest`` and ranks first to last - 1 put ``length`` of their tokens, those from ``start`` on.

    They are the items from ``nth`` on of a plan that lays ``each`` of them side by side,
    from ``offset`` on, into every sequence from ``sequence`` on.
    """

    rest: int
    first: int
    last: int
    start: int
    length: int
    sequence: int
    offset: int
    each: int
    nth: int

    def place(self, rank: int) -> tuple[int, int]:
        """(sequence, offset) of a rank."""
        window, side = divmod(self.nth + rank - self.first, self.each)
        return self.sequence + window, self.offset + side * self.length


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within counts whose sum is the largest up to ``room``; long lengths first where several are."""
    mask, reach = (1 << (room + 1)) - 1, 1
    items, before = [], []
    for length in sorted(counts):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            n = min(times, left)
            items.append((length, n))
            before.append(reach)
            reach |= reach << (length * n) & mask
            left, times = left - n, times * 2
    at, chosen = reach.bit_length() - 1, {}
    for (length, n), was in zip(reversed(items), reversed(before), strict=True):
        if at >= length * n and was >> (at - length * n) & 1:
            chosen[length] = chosen.get(length, 0) + n
            at -= length * n
    return chosen


class Rests:
    """What is still to be packed: by length, runs of (rest, first rank, last rank, start)."""

    def __init__(self, counts: dict[int, int]):
        self.runs = {n: [(n, 0, c, 0)] for n, c in counts.items() if c}
        self.counts = {n: c for n, c in counts.items() if c}

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out, runs = [], self.runs[length]
        self.counts[length] -= n
        while n:
            rest, first, last, start = runs.pop()
            if last - first > n:
                runs.append((rest, first, last - n, start))
                first = last - n
            out.append((rest, first, last, start))
            n -= last - first
        if not runs:
            del self.runs[length], self.counts[length]
        return out

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        self.runs.setdefault(length, []).append(run)
        self.counts[length] = self.counts.get(length, 0) + run[2] - run[1]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """Slots for all rests, and the number of sequences they make."""
    rests, slots, made = Rests(counts), [], 0
    tokens = sum(n * c for n, c in counts.items())

    def lay(runs, length: int, offset: int, each: int) -> None:
        nth = 0
        for rest, first, last, start in runs:
            slots.append(Slot(rest, first, last, start, length, made, offset, each, nth))
            nth += last - first

    def window(room: int, times: int | None) -> int:
        """Fill one window, ``times`` times or as often as it goes; the number of times."""
        fits = [n for n in rests.counts if n <= room]
        chosen: dict[int, int] = {}
        if fits:
            seed = max(fits)
            others = {n: c - (n == seed) for n, c in rests.counts.items() if n <= room - seed and c > (n == seed)}
            chosen = closest(others, room - seed)
            chosen[seed] = chosen.get(seed, 0) + 1
        slack = room - sum(n * c for n, c in chosen.items())
        cut = max((n for n, c in rests.counts.items() if c > chosen.get(n, 0)), default=0) if slack else 0
        uses = chosen | ({cut: chosen.get(cut, 0) + 1} if cut else {})
        times = times or min(rests.counts[n] // c for n, c in uses.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            lay(rests.take(length, times * chosen[length]), length, offset, chosen[length])
            offset += length * chosen[length]
        if cut:
            runs = rests.take(cut, times)
            lay(runs, slack, offset, 1)
            for rest, first, last, start in runs:
                rests.put(cut - slack, (rest, first, last, start + slack))
        return times

    while tokens >= capacity:
        times = window(capacity, None)
        made += times
        tokens -= times * capacity
    for power in reversed(range(capacity.bit_length())):
        if tokens >> power & 1:
            window(1 << power, 1)
            made += 1
    return slots, made


def tokenise(documents: DataFrame, tokenizer: str, capacity: int, end: int) -> tuple[DataFrame, str]:
    """(doc_id, part, nth, windows_before, n, rest, ids): nth among the task's rests of that length; ids as in the second value.

    A task's number and its running counts are saved with the rows, so a repeated task replaces them together.
    """
    raw = encoders.read_file(tokenizer)
    kind = "<u2" if max(len(encoders.token_bytes(raw)), end + 1) <= 65_536 else "<u4"
    shipped = documents.sparkSession.sparkContext.broadcast(raw)

    def run(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoders.byte_bpe(shipped.value)
        seen, windows = np.zeros(capacity, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = {k: [] for k in ("nth", "windows_before", "n", "rest", "ids")}
            for text in texts:
                ids = np.array(encode([text])[0] + [end], kind)
                rest = len(ids) % capacity
                out["nth"].append(int(seen[rest]))
                out["windows_before"].append(windows)
                out["n"].append(len(ids))
                out["rest"].append(rest)
                out["ids"].append(ids.tobytes())
                seen[rest] += 1
                windows += len(ids) // capacity
            columns = {"doc_id": batch.column("doc_id"), "part": pa.array([part] * len(texts), pa.int32())}
            columns |= {k: pa.array(v, pa.int64()) for k, v in out.items() if k not in ("ids", "rest")}
            columns |= {"rest": pa.array(out["rest"], pa.int32()), "ids": pa.array(out["ids"], pa.binary())}
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in ("doc_id", "part", "nth", "windows_before", "n", "rest", "ids")})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, part int, nth long, windows_before long, n long, rest int, ids binary"), kind


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    capacity is a power of two; sequences are numbered from 0 without gaps.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    rows, kind = tokenise(documents, tokenizer, capacity, end)
    rows = scratch.save(rows)
    # One row for each task and length: what comes before a task's rests, and before its whole windows.
    groups = rows.groupBy("part", "rest").agg(F.count("*").alias("n_rests"), F.sum(F.floor(F.col("n") / capacity)).cast("long").alias("windows"))
    groups = scratch.save(groups)
    by_part = groups.groupBy("part").agg(F.sum("windows").alias("windows"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    windows = by_part.select("part", F.coalesce(F.sum("windows").over(earlier), F.lit(0)).alias("window_base"))
    along = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranks = groups.select("part", "rest", F.coalesce(F.sum("n_rests").over(along), F.lit(0)).alias("rank_base"))
    base = scratch.save(ranks.join(windows, "part"))
    # capacity rows at most
    counts = {r["rest"]: int(r["n"]) for r in groups.where("rest > 0").groupBy("rest").agg(F.sum("n_rests").alias("n")).collect()}
    full = int(groups.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).first()["n"])
    slots, _ = plan(counts, capacity)
    by_rest: dict[int, list[Slot]] = {}
    for s in slots:
        by_rest.setdefault(s.rest, []).append(s)
    # A few slots for each length; see the module's text.
    shipped = spark.sparkContext.broadcast({rest: (found, np.array([(s.first, s.last) for s in found], np.int64)) for rest, found in by_rest.items()})

    def run(batches):
        table = shipped.value
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "nth", "windows_before", "n", "rest", "ids", "rank_base", "window_base")]
            for doc_id, nth, before, n, rest, raw, rank_base, window_base in zip(*columns, strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
                whole = n - rest
                for i in range(whole // capacity):
                    at = i * capacity
                    out.append((doc_id, at, capacity, ids[4 * at : 4 * (at + capacity)], n, window_base + before + i, 0))
                if rest:
                    rank, (found, bounds) = nth + rank_base, table[rest]
                    for k in np.flatnonzero((bounds[:, 0] <= rank) & (rank < bounds[:, 1])).tolist():
                        at, length, (sequence, offset) = whole + found[k].start, found[k].length, found[k].place(rank)
                        out.append((doc_id, at, length, ids[4 * at : 4 * (at + length)], n, full + sequence, offset))
            for i in range(0, len(out), 4096):
                part = list(zip(*out[i : i + 4096], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return rows.join(base, ["part", "rest"]).mapInArrow(run, PIECES)
