"""Shards and tensor containers by ranges: what is read, what a failed write leaves."""

import hashlib
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.sources import npytok, ranges, tensors

ROWS = T.StructType([T.StructField("shard", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])


def stored(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, entries in files.items():
        at, head = 0, {"__metadata__": {"format": "pt"}}
        for tensor, raw in entries.items():
            head[tensor] = {"dtype": "U8", "shape": [len(raw)], "data_offsets": [at, at + len(raw)]}
            at += len(raw)
        text = json.dumps(head).encode()
        with open(f"{folder}/{name}", "wb") as f:
            f.write(struct.pack("<Q", len(text)) + text + b"".join(entries.values()))


@pytest.fixture
def counted(monkeypatch):
    """Every range that is read in this process."""
    seen, read = [], ranges.Ranges.read
    monkeypatch.setattr(ranges.Ranges, "read", lambda self, start, length: seen.append((self.path, start, length)) or read(self, start, length))
    return seen


def some_tensors(rng, sizes):
    return {f"layer.{i}.weight": rng.integers(0, 256, n, dtype=np.uint8).tobytes() for i, n in enumerate(sizes)}


def test_tensor_scan_reads_headers_and_first_bytes_only(spark, tmp_path, counted):
    rng = np.random.default_rng(1)
    files = {"a.safetensors": some_tensors(rng, [100_000, 0, 7, 50_000]), "b.safetensors": some_tensors(rng, [300_000])}
    stored(tmp_path, files)
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "c.safetensors").write_bytes(b"abc")
    (tmp_path / "d.safetensors").write_bytes(struct.pack("<Q", 10**9) + b"{}")
    want = {(f, t): (len(raw), hashlib.sha256(raw[:1000]).hexdigest()) for f, e in files.items() for t, raw in e.items()}
    got = tensors.digests(tensors.scan(spark, str(tmp_path), 1000)).collect()
    assert {(r.file.rsplit("/", 1)[1], r.tensor): (r.n_bytes, r.sha256) for r in got if r.tensor} == want
    assert {r.file.rsplit("/", 1)[1] for r in got if not r.tensor} == {"c.safetensors", "d.safetensors"}
    reader = tensors.Reader({"path": str(tmp_path), "first": "1000"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    heads = sum(n for _, start, n in counted if start == 8)
    assert sum(n for *_, n in counted) - heads == sum(min(1000, len(raw)) for e in files.values() for raw in e.values()) == sum(r[6] for r in rows)


def test_tensor_scan_by_name_leaves_the_rest_unread(spark, tmp_path, counted):
    stored(tmp_path, {"a.safetensors": some_tensors(np.random.default_rng(2), [90_000] * 5)})
    reader = tensors.Reader({"path": str(tmp_path), "first": "64", "tensors": '["layer.1.weight", "layer.3.weight"]'})
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 2
    assert [n for _, start, n in counted if start != 8] == [64, 64]
    rows = tensors.scan(spark, str(tmp_path), names=["layer.4.weight"])
    assert [r.n_bytes for r in rows.collect()] == [90_000]


def test_near_tensors_are_read_at_once_and_large_files_in_parts(tmp_path, counted, monkeypatch):
    stored(tmp_path, {"a.safetensors": some_tensors(np.random.default_rng(3), [100] * 50)})
    reader = tensors.Reader({"path": str(tmp_path), "first": "64"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 50 and len([1 for _, start, _ in counted if start != 8]) == 1
    monkeypatch.setattr(tensors, "PARTITION_TENSORS", 20)
    assert len(reader.partitions()) == 3


def test_sampled_copy_across_layouts(spark, tmp_path):
    rng = np.random.default_rng(4)
    whole = some_tensors(rng, [5000] * 20)
    stored(tmp_path / "king", {"model.safetensors": whole})
    halves = [dict(list(whole.items())[:9]), dict(list(whole.items())[9:])]
    names = ["model-00001-of-00002.safetensors", "model-00002-of-00002.safetensors"]
    stored(tmp_path / "copy", dict(zip(names, halves, strict=True)))
    index = {"weight_map": {t: n for n, e in zip(names, halves, strict=True) for t in e}}
    (tmp_path / "copy" / tensors.INDEX).write_text(json.dumps(index))
    row = tensors.sampled_copy(spark, str(tmp_path / "copy"), str(tmp_path / "king"), "sha256:b", "sha256:a").first()
    assert (row.n_sampled, row.n_common, row.n_different, row.copied) == (12, 12, 0, True)
    sample = tensors.chosen_tensors(list(whole), "sha256:b", "sha256:a")
    stored(tmp_path / "other", {"model.safetensors": whole | {sample[0]: b"x" * 5000}})
    assert tensors.sampled_copy(spark, str(tmp_path / "other"), str(tmp_path / "king"), "sha256:b", "sha256:a").first().copied is False
    stored(tmp_path / "few", {"model.safetensors": {t: whole[t] for t in sample[:5]}})
    assert tensors.sampled_copy(spark, str(tmp_path / "few"), str(tmp_path / "king"), "sha256:b", "sha256:a").first().copied is None
    (tmp_path / "none").mkdir()
    assert tensors.sampled_copy(spark, str(tmp_path / "none"), str(tmp_path / "king"), "sha256:b", "sha256:a").first().copied is None


def test_containers_written_by_tasks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 3}.safetensors", f"t{i}", "U8", [3], bytearray([i, i, i])) for i in range(9)], "file string, tensor string, dtype string, shape array<long>, data binary")
    assert sum(r.n_tensors for r in tensors.write_files(rows, str(tmp_path / "m")).collect()) == 9
    back = tensors.scan(spark, str(tmp_path / "m")).collect()
    assert {(r.file.rsplit("/", 1)[1], r.tensor, bytes(r.head)) for r in back} == {(f"f{i % 3}.safetensors", f"t{i}", bytes([i] * 3)) for i in range(9)}
    assert not [f for f in os.listdir(tmp_path / "m") if f.startswith(".")]


def shard_rows(spark, shards, parts=2):
    rows = [(name, sum(map(len, pieces)), p) for name, pieces in shards.items() for p in pieces]
    return spark.createDataFrame(rows, ROWS).repartition(parts, "shard").sortWithinPartitions("shard")


def test_shards_and_manifest_appear_together(spark, tmp_path):
    npytok.register(spark)
    shards = {f"s{i}": [[i] * 3, list(range(i))] for i in range(1, 6)}
    folder = str(tmp_path / "out")
    shard_rows(spark, shards).write.format("npytok").mode("append").option("document", '{"tokenizer": "t"}').save(folder)
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["total_shards"] == 5 and manifest["tokenizer"] == "t"
    for e in manifest["shards"]:
        raw = (tmp_path / "out" / e["key"]).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (e["size_bytes"], e["sha256"])
        assert np.load(tmp_path / "out" / e["key"]).tolist() == [t for p in shards[e["source_file"]] for t in p]
    assert sorted(os.listdir(folder)) == ["manifest.json", *[f"s{i}.npy" for i in range(1, 6)]]
    with pytest.raises(Exception, match="has a manifest"):
        shard_rows(spark, shards).write.format("npytok").mode("append").save(folder)


@pytest.mark.parametrize("fault", ["count", "split"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, fault):
    npytok.register(spark)
    folder = tmp_path / "out"
    rows = spark.createDataFrame([("a", 5 if fault == "count" else 2, [1, 2]), ("b", 2, [3, 4]), *[("a", 2, [5, 6])] * (fault == "split")], ROWS)
    rows = rows.coalesce(1) if fault == "count" else rows.repartition(3)
    with pytest.raises(Exception, match="tokens, not|two tasks|do not follow"):
        rows.write.format("npytok").mode("append").save(str(folder))
    assert not folder.exists() or os.listdir(folder) == []


def test_attempts_write_apart_and_only_the_counted_one_is_moved(tmp_path):
    import pyarrow as pa

    writer = npytok.Writer({"path": str(tmp_path)}, ROWS, False)
    batch = pa.RecordBatch.from_pydict({"shard": ["a", "a"], "n_tokens": [4, 4], "tokens": [[1, 2], [3, 4]]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.folder != kept.folder and not (tmp_path / "a.npy").exists()
    writer.commit([kept])
    assert np.load(tmp_path / "a.npy").tolist() == [1, 2, 3, 4]
    assert sorted(os.listdir(tmp_path)) == ["a.npy", "manifest.json"]
    other = npytok.Writer({"path": str(tmp_path), "manifest": "second.json"}, ROWS, False)
    other.write(iter([batch]))
    other.abort([None])
    assert sorted(os.listdir(tmp_path)) == ["a.npy", "manifest.json"]
    npytok.Writer({"path": str(tmp_path), "manifest": "third.json"}, ROWS, False).write(iter([batch]))  # its driver is lost
    assert npytok.clean(str(tmp_path)) == 1 and sorted(os.listdir(tmp_path)) == ["a.npy", "manifest.json"]


def test_a_commit_that_fails_takes_its_shards_back(tmp_path, monkeypatch):
    import pyarrow as pa

    def writer(**options):
        made = npytok.Writer({"path": str(tmp_path)} | options, ROWS, False)
        batch = pa.RecordBatch.from_pydict({"shard": ["x/a", "b"], "n_tokens": [1, 1], "tokens": [[1], [3]]})
        return made, made.write(iter([batch]))

    first, told = writer()
    monkeypatch.setattr(ranges, "put", lambda *_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        first.commit([told])
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    monkeypatch.undo()
    second, told = writer()
    second.commit([told])
    third, told = writer(manifest="again.json")
    with pytest.raises(FileExistsError):
        third.commit([told])
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.npy", "b.npy", "manifest.json"]


def test_far_indices_read_one_range_each(spark, tmp_path, counted):
    np.save(tmp_path / "a.npy", np.arange(40_000, dtype="<u4"))
    np.save(tmp_path / "b.npy", np.arange(40_000, 80_000, dtype="<u4").reshape(-1, 8))
    reader = npytok.Reader({"path": str(tmp_path), "width": "8", "indices": "[3, 5, 2000, 9000]"})
    parts = reader.partitions()
    got = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert {x["record_idx"]: x["tokens"][0] for x in got} == {3: 24, 5: 40, 2000: 16_000, 9000: 72_000}
    assert [n for *_, n in counted] == [3 * 32, 32, 32]  # 3 to 5 at once, then two more
    some = npytok.scan(spark, str(tmp_path), 8, indices=[9999, 7])
    assert [r.tokens[1] for r in some.orderBy("record_idx").collect()] == [57, 79_993]
    assert npytok.scan(spark, str(tmp_path), 8, low=9998).count() == 2 and npytok.scan(spark, str(tmp_path), 8, high=2).count() == 3
    every = npytok.scan(spark, str(tmp_path), 8)
    assert every.where("record_idx < 3").count() == 3 and every.count() == 10_000  # one query leaves the next alone


def test_records_of_an_index_table(spark, tmp_path, monkeypatch):
    np.save(tmp_path / "a.npy", np.arange(60_000, dtype="<u4"))
    np.save(tmp_path / "b.npy", np.arange(60_000, 100_000, dtype="<u4"))
    wanted = [1, 2, 60, 2500, 2500, 9_999, 6000, 12_000, -1]
    got = npytok.records(spark, str(tmp_path), spark.createDataFrame([(i,) for i in wanted], "record_idx long"), 10).collect()
    assert {r.record_idx: r.tokens for r in got} == {i: list(range(10 * i, 10 * i + 10)) for i in {1, 2, 60, 2500, 9_999, 6000}}
    assert sum(r.bytes_read for r in got) == 40 * (60 + 1 + 1 + 1)
    assert npytok.records(spark, str(tmp_path), spark.createDataFrame([], "record_idx long"), 10).count() == 0


def test_range_paths():
    assert ranges.canonical("file:/tmp/x") == ranges.canonical("file:///tmp/x") == "file:///tmp/x"
    assert ranges.canonical("/tmp/x") == "/tmp/x"
    assert npytok.near(np.array([1, 2, 66, 131, 200])) == [(1, 66), (131, 131), (200, 200)]
    assert npytok.near(np.array([], np.int64)) == []


def test_bad_headers(tmp_path):
    for bad in (np.arange(3), np.zeros((2, 2, 2), "<u4")):
        np.save(tmp_path / "x.npy", bad)
        with pytest.raises(ValueError):
            npytok.header_of(str(tmp_path / "x.npy"))
    np.save(tmp_path / "x.npy", np.arange(9, dtype="<u4"))
    raw = (tmp_path / "x.npy").read_bytes()
    (tmp_path / "x.npy").write_bytes(raw[:-4])
    with pytest.raises(ValueError, match="truncated"):
        npytok.shards(str(tmp_path))


def test_first_bytes_in_sql(spark, tmp_path):
    stored(tmp_path, {"a.safetensors": {"t": b"hello world"}})
    tensors.scan(spark, str(tmp_path), 5).createOrReplaceTempView("scan_t")
    assert spark.sql("select decode(head, 'utf-8') as h from scan_t").first().h == "hello"
    assert tensors.scan(spark, str(tmp_path)).select(F.sum("bytes_read").alias("n")).first().n == 11
