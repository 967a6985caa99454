"""Token shards: NumPy files of little-endian uint32, one stream or rows of equal width.

``spark.read.format("npytok").option("width", 128).load(path)`` reads records as
(record_idx, tokens). Headers alone are read to plan; bounds or a list of indices become
the byte ranges that are the input partitions, near ones as one range. ``records`` does
the same for a table of indices of any size.

``df.write.format("npytok").save(folder)`` writes rows (shard, n_tokens, tokens), sorted
within shards, one task a shard. Every attempt of a task writes into its own folder; the
driver moves the files of those that count into place and writes the manifest last, so
neither a failed nor a repeated attempt leaves or changes a shard.
"""

from __future__ import annotations

import ast
import hashlib
import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from . import ranges

MAGIC = b"\x93NUMPY"
RECORDS_PER_PARTITION = 65_536
#: Records that may lie unasked between two asked ones read at once.
GAP = 64
#: Bytes read at a time.
BLOCK = 8 << 20
#: Bytes before the tokens of a shard written here.
HEAD = 128
MANIFEST = "manifest.json"
ENTRY = "source_file: string, key: string, n_tokens: long, size_bytes: long, sha256: string"


def read_header(raw: bytes) -> tuple[int, tuple[int, ...]]:
    """(offset of the data, shape) from a file's first bytes; only little-endian uint32 in C order is accepted."""
    if raw[:6] != MAGIC:
        raise ValueError("no NumPy file")
    wide = raw[6] >= 2
    size = struct.unpack_from("<I" if wide else "<H", raw, 8)[0]
    start = 12 if wide else 10
    header = ast.literal_eval(raw[start : start + size].decode("latin1"))
    if header["descr"] != "<u4":
        raise ValueError(f"tokens must be <u4, not {header['descr']}")
    if header["fortran_order"] or len(header["shape"]) not in (1, 2):
        raise ValueError(f"shape {header['shape']} is neither a stream nor records")
    return start + size, tuple(header["shape"])


def header_of(path: str) -> tuple[int, tuple[int, ...]]:
    with ranges.Ranges(path) as f:
        return read_header(f.file.read_at(65_536, 0))


def token_count(path: str) -> int:
    """Tokens of a shard, from its header alone."""
    return int(np.prod(header_of(path)[1], dtype=np.int64))


def make_header(n: int) -> bytes:
    text = str({"descr": "<u4", "fortran_order": False, "shape": (n,)})
    return MAGIC + b"\x01\x00" + struct.pack("<H", HEAD - 10) + (text + " " * (HEAD - 11 - len(text)) + "\n").encode("latin1")


@dataclass(frozen=True)
class Shard:
    """A shard's records: ``base`` is the index of its first among all shards of the path."""

    path: str
    offset: int
    base: int
    n: int
    width: int


def shards(path: str, width: int = 0) -> list[Shard]:
    """The shards at a path in name order, from their headers; a file that is too short is an error."""
    found = ranges.files(path, ".npy")
    out, base = [], 0
    for (file, size), (offset, shape) in zip(found, ranges.headers([f for f, _ in found], header_of), strict=True):
        if size < offset + 4 * int(np.prod(shape, dtype=np.int64)):
            raise ValueError(f"{file} is truncated")
        each = shape[1] if len(shape) == 2 else width or 1
        n = shape[0] if len(shape) == 2 else shape[0] // each
        out.append(Shard(file, offset, base, n, each))
        base += n
    return out


def near(indices: np.ndarray, gap: int = GAP) -> list[tuple[int, int]]:
    """(first, last) of the runs of sorted distinct indices that have at most ``gap`` from one to the next."""
    if not len(indices):
        return []
    cuts = np.flatnonzero(np.diff(indices) > gap)
    return list(zip(indices[np.r_[0, cuts + 1]].tolist(), indices[np.r_[cuts, len(indices) - 1]].tolist(), strict=True))


def read_run(file: ranges.Ranges, shard: Shard, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first record, records) in blocks; first and last are the shard's own indices, last included."""
    step = max(1, BLOCK // (4 * shard.width))
    for i in range(first, last + 1, step):
        n = min(step, last + 1 - i)
        raw = file.read(shard.offset + 4 * i * shard.width, 4 * n * shard.width)
        yield i, np.frombuffer(raw, "<u4").reshape(n, shard.width)


def as_batch(indices: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(tokens) + 1, dtype=np.int32) * tokens.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.reshape(-1).astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(indices, pa.int64()), lists], ["record_idx", "tokens"])


class Run(InputPartition):
    def __init__(self, shard: Shard, first: int, last: int, wanted: list[int] | None):
        super().__init__((shard, first, last, wanted))


class Reader(DataSourceReader):
    """Options say what is read: ``low`` and ``high`` (both included), ``indices`` (a JSON list).

    They are options, not filters pushed down: Spark 4.1 keeps what a Python reader was
    told by one query for the next one on the same DataFrame that has no filter.
    """

    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", 0))
        self.low, self.high = int(options.get("low", 0)), int(options["high"]) if "high" in options else None
        self.wanted = set(json.loads(options["indices"])) if "indices" in options else None

    def partitions(self) -> list[Run]:
        out = []
        for s in shards(self.path, self.width):
            low, high = max(self.low - s.base, 0), s.n - 1 if self.high is None else min(s.n - 1, self.high - s.base)
            if self.wanted is not None:
                asked = np.array(sorted(i - s.base for i in self.wanted if low <= i - s.base <= high), np.int64)
                out += [Run(s, a, b, asked[(asked >= a) & (asked <= b)].tolist()) for a, b in near(asked)]
            else:
                out += [Run(s, i, min(high, i + RECORDS_PER_PARTITION - 1), None) for i in range(low, high + 1, RECORDS_PER_PARTITION)]
        return out or [Run(Shard("", 0, 0, 0, 1), 0, -1, None)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        shard, first, last, wanted = partition.value
        if last < first:
            return
        with ranges.Ranges(shard.path) as f:
            for i, tokens in read_run(f, shard, first, last):
                own = np.arange(i, i + len(tokens))
                if wanted is not None:
                    keep = np.isin(own, wanted)
                    own, tokens = own[keep], tokens[keep]
                yield as_batch(shard.base + own, tokens)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    entries: list[tuple[str, str, int, int, str]]


class Writer(DataSourceArrowWriter):
    """One file for each shard; see the module's text for when it appears."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        if [f.name for f in schema.fields] != ["shard", "n_tokens", "tokens"]:
            raise ValueError("npytok writes rows (shard, n_tokens, tokens)")
        self.folder, self.overwrite, self.prefix = options["path"], overwrite, options.get("prefix", "")
        self.manifest, self.document = options.get("manifest", MANIFEST), json.loads(options.get("document", "{}"))
        self.aside = ranges.join(self.folder, f"_writing-{uuid.uuid4().hex}")
        if not overwrite and ranges.exists(ranges.join(self.folder, self.manifest)):
            raise FileExistsError(f"{self.folder} has a manifest {self.manifest}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        mine, done = ranges.join(self.aside, uuid.uuid4().hex), []
        name, out, digest, want, n = None, None, None, 0, 0

        def close() -> None:
            out.close()
            if n != want:
                raise ValueError(f"shard {name} has {n} tokens, not {want}")
            done.append((name, f"{self.prefix}{name}.npy", n, HEAD + 4 * n, digest.hexdigest()))

        for batch in iterator:
            tokens = batch.column(2)
            for i, (shard, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if shard != name:
                    if out is not None:
                        close()
                    if any(shard == d[0] for d in done):
                        raise ValueError(f"the rows of shard {shard} do not follow each other")
                    name, want, n, digest = shard, size, 0, hashlib.sha256()
                    out = ranges.create(ranges.join(mine, f"{self.prefix}{shard}.npy"))
                    head = make_header(size)
                    digest.update(head)
                    out.write(head)
                raw = np.asarray(tokens[i].values.to_numpy(zero_copy_only=False), "<u4").tobytes()
                digest.update(raw)
                out.write(raw)
                n += len(raw) // 4
        if out is not None:
            close()
        return Written(mine, done)

    def commit(self, messages: list[Written | None]) -> None:
        """All shards into place, then the manifest; if that fails on the way, those moved go again."""
        made = [(m.folder, *e) for m in messages if m for e in m.entries]
        moved: list[str] = []
        try:
            if len({e[1] for e in made}) != len(made):
                raise ValueError("a shard was written by two tasks; its rows must be in one partition")
            for folder, _, key, *_ in made:
                target = ranges.join(self.folder, key)
                if not self.overwrite and ranges.exists(target):
                    raise FileExistsError(f"{target} is there already")
                ranges.move(ranges.join(folder, key), target)
                moved.append(target)
            entries = [{"source_file": name, "key": key, "n_tokens": n, "size_bytes": size, "sha256": digest} for _, name, key, n, size, digest in sorted(made, key=lambda e: e[2])]
            totals = {"total_shards": len(entries), "total_tokens": sum(e["n_tokens"] for e in entries)}
            ranges.put(ranges.join(self.folder, self.manifest), json.dumps(self.document | {"dtype": "uint32"} | totals | {"shards": entries}).encode())
        except BaseException:
            for target in moved:
                ranges.remove(target)
            raise
        finally:
            ranges.remove(self.aside)

    def abort(self, messages: list[Written | None]) -> None:
        ranges.remove(self.aside)


class NpyTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npytok"

    def schema(self) -> str:
        return "record_idx bigint, tokens array<bigint>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known."""
    spark.dataSource.register(NpyTokens)


def scan(spark: SparkSession, path: str, width: int = 0, low: int = 0, high: int | None = None, indices: list[int] | None = None) -> DataFrame:
    """Records of the shards at a path: all, those from low to high, or those of a list of indices."""
    register(spark)
    read = spark.read.format("npytok").option("width", width).option("low", low)
    if high is not None:
        read = read.option("high", high)
    if indices is not None:
        read = read.option("indices", json.dumps(sorted(set(indices))))
    return read.load(path)


def records(spark: SparkSession, path: str, indices: DataFrame, width: int = 0) -> DataFrame:
    """(record_idx, tokens, bytes_read) of a table of indices (record_idx); repeated ones give one row, unknown ones none.

    Indices meet by stretches of ``RECORDS_PER_PARTITION`` records, and of each stretch
    only the ranges that hold them are read. bytes_read: of a range's first record, the
    bytes read for the range; else 0. The driver knows one row for each shard.
    """
    known = shards(path, width)
    bases = np.array([s.base for s in known], np.int64)

    def run(batches):
        for batch in batches:
            asked = np.unique(batch.column("record_idx").to_numpy())
            which = np.searchsorted(bases, asked, side="right") - 1
            for k in np.unique(which[which >= 0]).tolist():
                shard = known[k]
                own = asked[which == k] - shard.base
                own = own[own < shard.n]
                if not len(own):
                    continue
                with ranges.Ranges(shard.path) as f:
                    for first, last in near(own):
                        size = 4 * shard.width * (last - first + 1)
                        for i, tokens in read_run(f, shard, first, last):
                            at = own[(own >= i) & (own < i + len(tokens))]
                            if len(at):
                                got = as_batch(shard.base + at, tokens[at - i])
                                cost = np.zeros(len(at), np.int64)
                                cost[0], size = size, 0
                                yield got.append_column("bytes_read", pa.array(cost))

    stretch = F.floor(F.col("record_idx") / RECORDS_PER_PARTITION)
    asked = indices.select(F.col("record_idx").cast("long").alias("record_idx")).where("record_idx >= 0").distinct()
    dealt = asked.withColumn("_s", stretch).repartition("_s").sortWithinPartitions("record_idx").select("record_idx")
    return dealt.mapInArrow(run, "record_idx long, tokens array<bigint>, bytes_read long")


def entries(spark: SparkSession, folder: str, manifest: str = MANIFEST) -> DataFrame:
    """The shards that a manifest lists."""
    path = ranges.join(folder, manifest)
    document = spark.read.schema(f"shards array<struct<{ENTRY}>>").option("multiLine", True).json(path)
    return document.select(F.explode("shards").alias("s")).select("s.*")


def write_shards(streams: DataFrame, folder: str, source: str = "source", order: str = "ord", prefix: str = "", manifest: str = MANIFEST, document: dict | None = None) -> DataFrame:
    """One shard for each value of ``source`` from rows (source, ord, tokens); returns the manifest's rows.

    A shard is one file and so one task; to spread a large source, cut it into shards by
    offset first, as ``ingest.shard_slices`` does. ``document``: more fields of the manifest.
    """
    spark = streams.sparkSession
    register(spark)
    rows = streams.select(F.col(source).cast("string").alias("shard"), F.col(order).alias("_o"), "tokens")
    sizes = rows.groupBy("shard").agg(F.sum(F.size("tokens")).cast("long").alias("n_tokens"))
    sorted_rows = rows.join(sizes, "shard").repartition("shard").sortWithinPartitions("shard", "_o").select("shard", "n_tokens", "tokens")
    write = sorted_rows.write.format("npytok").mode("append").option("prefix", prefix).option("manifest", manifest)
    write.option("document", json.dumps(document or {})).save(folder)
    return entries(spark, folder, manifest)


def clean(folder: str) -> int:
    """Remove what writes left whose driver was lost; their number. Not while another write runs there."""
    system, inner, before = ranges.at(folder)
    left = [i.path for i in system.get_file_info(ranges.fs.FileSelector(inner)) if posixpath.basename(i.path).startswith("_writing-")]
    for path in left:
        ranges.remove(before + path)
    return len(left)
