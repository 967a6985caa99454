"""Tensor containers read by ranges: eight bytes of length, a JSON header, then only the bytes that are asked for.

``spark.read.format("tensors").option("first", 65536).load(path)`` has one row for each
tensor of the files at a path: (file, tensor, dtype, shape, n_bytes, head, bytes_read),
``head`` being the first bytes of its data. To plan, headers are read and no data; input
partitions are byte ranges, so a file of any size is read in parallel and never whole.
Options ``files`` and ``tensors`` (JSON lists of names) leave all others unread. Of a file whose header can't be
read there is one row with null tensor and the reason.

A model in several files has an index that names the file of each tensor (``weight_map``);
``tensor_index`` reads it, or makes it from headers where there is a single file.
"""

from __future__ import annotations

import hashlib
import json
import random
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import ranges

HEADER_LIMIT = 100_000_000
SUFFIX = ".safetensors"
INDEX = "model.safetensors.index.json"
SINGLE = "model.safetensors"
FIRST_BYTES = 65_536
#: Bytes of data of an input partition, and tensors of one.
PARTITION_BYTES, PARTITION_TENSORS = 64 << 20, 1024
#: Unasked bytes between two asked ranges that are cheaper read than skipped.
GAP = 4096
# Tensors compared when two models have another number of files, and bytes of each.
SAMPLE_TENSORS, SAMPLE_BYTES = 12, 65_536
SCHEMA = "file string, tensor string, dtype string, shape array<long>, n_bytes long, head binary, bytes_read long, error string"


def parse(raw: bytes) -> dict:
    """Tensor entries of a header's JSON."""
    entries = {k: v for k, v in json.loads(raw).items() if k != "__metadata__"}
    for name, e in entries.items():
        a, b = e["data_offsets"]
        if not 0 <= a <= b:
            raise ValueError(f"tensor {name} has offsets {a} to {b}")
    return entries


def header_size(raw: bytes, there: int) -> int:
    """Length of the JSON header from a file's first eight bytes; ``there``: bytes of the file."""
    if len(raw) < 8:
        raise ValueError("no header")
    (n,) = struct.unpack("<Q", raw[:8])
    if n > HEADER_LIMIT or 8 + n > there:
        raise ValueError("header beyond the file")
    return n


def read_header(raw: bytes) -> tuple[dict, int]:
    """Tensor entries and the offset at which their data starts, from a file's bytes."""
    n = header_size(raw, len(raw))
    return parse(raw[8 : 8 + n]), 8 + n


@dataclass(frozen=True)
class Head:
    """What a file's header says; ``start``: where its data starts."""

    file: str
    entries: dict
    start: int
    error: str | None = None


def head_of(file: str, size: int) -> Head:
    """Two reads: eight bytes, then the header itself."""
    try:
        with ranges.Ranges(file) as f:
            n = header_size(f.file.read_at(8, 0), size)
            entries = parse(f.read(8, n))
        if any(8 + n + e["data_offsets"][1] > size for e in entries.values()):
            raise ValueError("data beyond the file")
        return Head(file, entries, 8 + n)
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return Head(file, {}, 0, f"{type(e).__name__}: {e}"[:200])


class Bytes(InputPartition):
    """A file's tensors (name, dtype, shape, bytes of it, first byte, bytes to read), by first byte."""

    def __init__(self, file: str, tensors: list[tuple], error: str | None = None):
        super().__init__((file, tensors, error))


def runs(tensors: list[tuple]) -> Iterator[list[tuple]]:
    """Tensors whose ranges lie close enough to be read at once."""
    held, end = [], 0
    for t in tensors:
        if held and (t[4] - end > GAP or t[4] + t[5] - held[0][4] > PARTITION_BYTES):
            yield held
            held = []
        held.append(t)
        end = max(end, t[4] + t[5]) if len(held) > 1 else t[4] + t[5]
    if held:
        yield held


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.first = options["path"], int(options.get("first", FIRST_BYTES))
        self.names = {k: set(json.loads(options[f"{k}s"])) if f"{k}s" in options else None for k in ("file", "tensor")}

    def wanted(self, column: str, value: str) -> bool:
        return self.names[column] is None or value in self.names[column]

    def partitions(self) -> list[Bytes]:
        found = [(f, size) for f, size in ranges.files(self.path, SUFFIX) if self.wanted("file", f)]
        out: list[Bytes] = []
        for head in ranges.headers(found, lambda x: head_of(*x)):
            if head.error is not None:
                out.append(Bytes(head.file, [], head.error))
            tensors, size = [], 0
            asked = [(name, e) for name, e in head.entries.items() if self.wanted("tensor", name)]
            for name, e in sorted(asked, key=lambda x: (x[1]["data_offsets"], x[0])):
                a, b = e["data_offsets"]
                if tensors and (size + min(b - a, self.first) > PARTITION_BYTES or len(tensors) == PARTITION_TENSORS):
                    out.append(Bytes(head.file, tensors))
                    tensors, size = [], 0
                tensors.append((name, e["dtype"], list(e["shape"]), b - a, head.start + a, min(b - a, self.first)))
                size += tensors[-1][5]
            if tensors:
                out.append(Bytes(head.file, tensors))
        return out or [Bytes("", [])]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        file, tensors, error = partition.value
        if error is not None:
            yield file, None, None, None, None, None, 0, error
        if not tensors:
            return
        with ranges.Ranges(file) as f:
            for run in runs(tensors):
                low, high = run[0][4], max(t[4] + t[5] for t in run)
                raw = f.read(low, high - low) if high > low else b""
                for i, (name, dtype, shape, n, start, size) in enumerate(run):
                    yield file, name, dtype, shape, n, raw[start - low : start - low + size], len(raw) if i == 0 else 0, None


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def scan(spark: SparkSession, path: str, first: int = FIRST_BYTES, files: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of the format, with ``first`` bytes of each tensor; of these files and these names alone, if given."""
    spark.dataSource.register(Tensors)
    read = spark.read.format("tensors").option("first", first)
    for option, value in (("files", files), ("tensors", names)):
        if value is not None:
            read = read.option(option, json.dumps(sorted(value)))
    return read.load(path)


def digests(rows: DataFrame) -> DataFrame:
    """(file, tensor, dtype, n_bytes, sha256) of a scan."""
    return rows.select("file", "tensor", "dtype", "n_bytes", F.sha2("head", 256).alias("sha256"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Containers from rows (file, tensor, dtype, shape, data), below ``folder``; (file, n_tensors, size_bytes).

    A container is one task's; a repeated attempt replaces the file by the same one.
    """

    def run(batches):
        held, name = [], None

        def close():
            entries, at = {}, 0
            for tensor, dtype, shape, data in held:
                entries[tensor] = {"dtype": dtype, "shape": list(map(int, shape)), "data_offsets": [at, at + len(data)]}
                at += len(data)
            head = json.dumps(entries, separators=(",", ":")).encode()
            ranges.put(ranges.join(folder, name), b"".join([struct.pack("<Q", len(head)), head, *[h[3] for h in held]]))
            return pd.DataFrame({"file": [name], "n_tensors": [len(held)], "size_bytes": [8 + len(head) + at]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.file != name and held:
                    yield close()
                    held = []
                name = row.file
                held.append((row.tensor, row.dtype, row.shape, bytes(row.data)))
        if held:
            yield close()

    dealt = rows.select("file", "tensor", "dtype", "shape", "data").repartition("file").sortWithinPartitions("file", "tensor")
    return dealt.mapInPandas(run, "file string, n_tensors long, size_bytes long")


def tensor_digests(files: DataFrame, first: int = FIRST_BYTES) -> DataFrame:
    """(path, tensor, dtype, n_bytes, sha256) from rows (path, content) that already hold whole small files.

    A file whose header cannot be read gives one row with a null tensor.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    entries, at = read_header(raw)
                except ValueError:
                    rows.append((path, None, None, None, None))
                    continue
                for name, e in sorted(entries.items()):
                    a, b = e["data_offsets"]
                    rows.append((path, name, e["dtype"], b - a, hashlib.sha256(raw[at + a : at + min(b, a + first)]).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "tensor", "dtype", "n_bytes", "sha256"]).astype({"n_bytes": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, tensor string, dtype string, n_bytes long, sha256 string")


def tensor_index(spark: SparkSession, folder: str) -> DataFrame:
    """(tensor, file) of a model: its index, else the header of its single file; no row if it has neither."""
    folder = ranges.canonical(folder)
    index = ranges.join(folder, INDEX)
    if ranges.exists(index):
        found = json.loads(ranges.get(index)).get("weight_map", {})
        rows = [(t, ranges.join(folder, f)) for t, f in sorted(found.items())]
    else:
        single = ranges.join(folder, SINGLE)
        size = dict(ranges.files(single)).popitem()[1] if ranges.exists(single) else 0
        rows = [(t, single) for t in sorted(head_of(single, size).entries)] if size else []
    return spark.createDataFrame(rows, "tensor string, file string")


def chosen_tensors(names: list[str], challenger: str, champion: str, n: int = SAMPLE_TENSORS) -> list[str]:
    """n of a model's tensors, drawn by the digests of both sides; all of them, shuffled, if there are fewer."""
    seed = int(hashlib.blake2b((challenger + champion).encode(), digest_size=8).hexdigest(), 16)
    return random.Random(seed).sample(sorted(names), min(n, len(names)))


def sampled_copy(spark: SparkSession, challenger: str, champion: str, challenger_digest: str, champion_digest: str, n: int = SAMPLE_TENSORS, first: int = SAMPLE_BYTES) -> DataFrame:
    """One row: whether the champion's sampled tensors begin alike in the challenger.

    (n_sampled, n_common, n_different, n_half, copied). n tensors of the champion, ``first``
    bytes of each; the challenger's file of a tensor comes from its own index. copied is
    null where fewer than half of the sample are in both, as nothing can be said then.
    """
    names = [r["tensor"] for r in tensor_index(spark, champion).select("tensor").collect()]  # names of one model
    sample = chosen_tensors(names, challenger_digest, champion_digest, n)

    def side(folder: str, name: str) -> DataFrame:
        where = tensor_index(spark, folder).where(F.col("tensor").isin(sample))
        if (found := where.select("file").distinct().collect()) == []:
            return spark.createDataFrame([], f"tensor string, {name} string")
        rows = scan(spark, folder, first, [r["file"] for r in found], sample).join(where, ["tensor", "file"])
        return rows.select("tensor", F.sha2("head", 256).alias(name))

    both = side(champion, "a").join(side(challenger, "b"), "tensor")
    counts = both.agg(F.count("*").alias("n_common"), F.count_if(F.col("a") != F.col("b")).alias("n_different"))
    half = max(1, min(n, len(names)) // 2)
    known = F.col("n_common") >= half
    return counts.select(F.lit(len(sample)).cast("long").alias("n_sampled"), "n_common", "n_different", F.when(known, F.col("n_different") == 0).alias("copied"))


def fingerprint_join(left: DataFrame, right: DataFrame, name: str = "tensor", value: str = "sha256") -> DataFrame:
    """(tensor, same) of the names that both sides have."""
    b = right.select(name, F.col(value).alias("_other"))
    return left.join(b, name).select(name, F.col(value).eqNullSafe(F.col("_other")).alias("same"))
