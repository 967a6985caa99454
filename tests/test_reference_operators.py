"""Balanced samples, packing until there is enough, ownership, versions, dashboards: against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adjudica.operators import balanced, bank, boards, fingerprint, listings, ownership, packing, registry, retention, sampling
from adjudica.operators.balanced import Balance
from adjudica.sources import ranges
from adjudica.sources.versions import Versions
from adjudica.streaming import dashboard


def sequences(spark, sizes, bad=lambda source, shard, i: False):
    rows = [(s, h, i, 99 if bad(s, h, i) else 5) for (s, h), n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "source string, shard string, idx long, largest long")


def plain_balance(spark, rows, balance):
    """The sequential rule over the same orders."""
    import hashlib

    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    rows = rows.collect()
    names = sorted({r.source for r in rows})
    table = spark.createDataFrame(list(enumerate(names)), "idx long, source string")
    quotas = {r.source: r.quota for r in sampling.source_quotas(table, balance.total, list(balance.weights), len(names)).collect()}
    out = set()
    for source in names:
        shards = sorted({r.shard for r in rows if r.source == source}, key=lambda h: (md5(balance.seed, source, h), h))
        shards = shards[: balance.max_shards] if balance.max_shards else shards
        sharing = min(balance.shards_per_source, len(shards)) if balance.shards_per_source else len(shards)
        shares = [quotas[source] // sharing + (i < quotas[source] % sharing) for i in range(sharing)]
        taken = []
        for i, shard in enumerate(shards):
            if len(taken) >= quotas[source]:
                break
            share = shares[i] if i < sharing else quotas[source] - len(taken)
            own = sorted((r for r in rows if (r.source, r.shard) == (source, shard)), key=lambda r: (md5(balance.seed, source, shard, r.idx), r.idx))
            looked = own[: balance.reads(share)]
            taken += [r for r in looked if not balance.vocabulary or r.largest < balance.vocabulary]
        if len(taken) < quotas[source]:
            raise ValueError(source)
        out |= {(r.source, r.shard, r.idx) for r in taken[: quotas[source]]}
    return out


@pytest.mark.parametrize("balance", [
    Balance(60, "a"), Balance(61, "b", 50), Balance(45, "c", 50, shards_per_source=2), Balance(40, "d", 50, 2, max_per_shard=6),
    Balance(50, "e", 0, 1, weights=(0.5, 0.3, 0.2)), Balance(30, "f", 50, 3, 0, 4), Balance(1, "g"),
])
def test_two_level_sample_equals_the_sequential_rule(spark, balance):
    rng = random.Random(1)
    sizes = {(s, f"h{i}"): rng.randint(1, 30) for s in "xyz" for i in range(6)}
    rows = sequences(spark, sizes, lambda s, h, i: s == "y" and i % 3 == 0)
    got = balanced.balanced_sample(rows, balance).collect()
    assert {(r.source, r.shard, r.idx) for r in got} == plain_balance(spark, rows, balance)
    assert sorted(r.place for r in got) == list(range(balance.total))


def test_a_short_source_is_refilled_from_later_shards_or_refused(spark):
    sizes = {("x", "a"): 3, ("x", "b"): 2, ("x", "c"): 40, ("y", "a"): 30}
    for seed in "pqr":
        got = balanced.balanced_sample(sequences(spark, sizes), Balance(40, seed, shards_per_source=1)).collect()
        assert Counter(r.source for r in got) == {"x": 20, "y": 20}
    with pytest.raises(ValueError, match="source y has only 30 of 50"):
        balanced.balanced_sample(sequences(spark, sizes | {("x", "d"): 50}), Balance(100, "p"))
    with pytest.raises(ValueError, match="has only 0 of 2"):
        balanced.balanced_sample(sequences(spark, {("x", "a"): 5}, lambda *_: True), Balance(2, "p", 50))
    assert balanced.balanced_sample(sequences(spark, {}), Balance(0, "p")).collect() == []


def test_packing_stops_when_there_are_enough_windows(spark):
    rng = random.Random(4)
    texts = {k: [[rng.randint(1, 9) for _ in range(rng.randint(0, 12))] for _ in range(20)] for k in range(10)}
    files = spark.createDataFrame([(i, f"f{i}") for i in range(10)], "idx long, key string")
    read_files = []

    def read(group):
        names = [r.idx for r in group.select("idx").collect()]
        read_files.extend(names)
        rows = [(i, j, t) for i in names for j, t in enumerate(texts[i])]
        return group.join(spark.createDataFrame(rows, "idx long, ord long, text array<long>"), "idx")

    def run(n, length, start, limit=8):
        read_files.clear()
        windows, used = packing.pack_until(files, read, lambda r: r.withColumnRenamed("text", "tokens"), n, length, start, limit)
        return [r.tokens for r in windows.orderBy("seq_idx").collect()], [(r.key, r.docs_seen) for r in used.orderBy("turn").collect()]

    def plain(n, length, start, limit=8):
        out, rest, used = [], [], []
        for turn in range(limit):
            i = (start + turn) % 10
            used.append([f"f{i}", 0])
            for t in texts[i]:
                used[-1][1] += 1
                rest = rest + t + [0]
                while len(rest) >= length:
                    out.append(rest[:length])
                    rest = rest[length:]
                    if len(out) >= n:
                        return out, [tuple(u) for u in used]
        return out, None

    for n, length, start in ((3, 16, 0), (20, 16, 8), (2, 200, 5), (40, 16, 9), (7, 3, 4)):
        got, want = run(n, length, start), plain(n, length, start)
        assert got == want
        assert len(read_files) <= 2 * len(want[1])
    got, want = run(500, 16, 3, 2), plain(500, 16, 3, 2)
    assert got[0] == want[0] and sorted(read_files) == [3, 4]
    with pytest.raises(ValueError, match="no window"):
        run(1, 10_000, 0, 1)


def test_offsets_of_crowded_and_sparse_orders(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PIECE", 7)
    rng = random.Random(2)
    for ids in ([0] * 3 + list(range(50)), rng.sample(range(10**15), 60), [5] * 30, [None, 1, 2]):
        rows = spark.createDataFrame([(rng.choice(["a", None]), i, [1] * rng.randint(0, 5)) for i in ids], "s string, o long, tokens array<long>")
        got = packing.token_offsets(rows, ["s"], ["o"]).collect()
        for s in ("a", None):
            own = sorted((r for r in got if r.s == s), key=lambda r: r.end)
            assert [r.start for r in own] == [0, *[r.end for r in own]][: len(own)]
            assert [(r.o is not None, r.o or 0) for r in own] == sorted((r.o is not None, r.o or 0) for r in own)
        places = sampling.placed(rows, "o").collect()
        assert sorted(r.i for r in places) == list(range(len(ids)))
        assert [r.o for r in sorted(places, key=lambda r: r.i)] == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_owner_at_the_head_else_at_the_reveal(spark):
    rng = random.Random(7)
    entries = [(rng.choice("abcd"), rng.randint(1, 300), rng.choice(["o1", "o2", "", None, "o3"])) for _ in range(120)] + [("e", 10, "z"), ("e", 20, None), ("hot", 5, None)]
    entries = list({e[:2]: e for e in entries}.values())
    reveals = [(i, rng.choice("abcdef"), rng.choice([0, 5, 15, 100, 250, 400, None])) for i in range(150)] + [(200, "e", 15), (201, "e", 25), (202, None, 3), (203, "hot", 9)]

    def plain(hotkey, block):
        own = sorted((b, o or None) for h, b, o in entries if h == hotkey)
        if own and own[-1][1]:
            return own[-1][1], "head"
        then = [o for b, o in own if block and b <= block]
        return (then[-1], "reveal_block") if then and then[-1] else (None, None)

    told = spark.createDataFrame(entries, "hotkey string, block long, coldkey string")
    asked = spark.createDataFrame(reveals, "id long, hotkey string, block long")
    for piece in (10, ownership.PIECE):
        ownership_rows = ownership.owners(asked, told) if piece == ownership.PIECE else None
        dated = ownership.as_of(asked, told.withColumn("coldkey", F.nullif("coldkey", F.lit(""))), "hotkey", "block", "coldkey", piece)
        want = {i: [o for b, o in sorted((b, o or None) for h2, b, o in entries if h2 == h) if block is not None and b <= block] for i, h, block in reveals}
        assert {r.id: r.coldkey for r in dated.collect()} == {i: (w[-1] if w else None) for i, w in want.items()}
    got = {r.id: (r.coldkey, r.owner_source) for r in ownership_rows.collect()}
    assert got == {i: plain(h, b) for i, h, b in reveals}


def test_a_failed_flush_leaves_the_old_state(spark, tmp_path):
    folder = str(tmp_path / "state")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "x")
    schema = rows(1).schema
    assert listings.load_state(spark, folder, {"queue": schema})["queue"].count() == 0
    listings.flush_state({"queue": rows(3), "king": rows(1)}, folder)
    broken = rows(5).select(F.raise_error(F.lit("half way")).cast("long").alias("x"))
    with pytest.raises(Exception, match="half way"):
        listings.flush_state({"queue": rows(9), "king": broken}, folder)
    loaded = listings.load_state(spark, folder, {"queue": schema, "king": schema})
    assert (loaded["queue"].count(), loaded["king"].count()) == (3, 1)
    assert len([p for p in (tmp_path / "state" / "versions").iterdir()]) == 1
    listings.flush_state({"queue": rows(7)}, folder)
    assert loaded["queue"].count() == 3  # whoever holds the old version still reads it
    loaded = listings.load_state(spark, folder, {"queue": schema, "king": schema})
    assert (loaded["queue"].count(), loaded["king"].count()) == (7, 1)
    assert listings.reset_champion(spark, folder, schema, dry_run=True).count() == 1
    assert listings.reset_champion(spark, folder, schema, dry_run=False).count() == 1
    assert listings.load_state(spark, folder, {"king": schema})["king"].count() == 0
    with pytest.raises(FileExistsError):
        listings.reset_champion(spark, folder, schema, dry_run=False)
    with pytest.raises(ValueError, match="no such documents"):
        listings.flush_state({"other": rows(1)}, folder)


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    state = Versions(spark, str(tmp_path))
    state.flush({"t": spark.range(1)})

    def late():
        Versions(spark, str(tmp_path)).flush({"t": spark.range(2)})
        return spark.range(5)

    with pytest.raises(RuntimeError, match="another writer"):
        state.flush({"t": late})
    assert state.read("t").count() == 2 and state.current().version == 2


def test_dashboard_is_shown_when_due_or_forced_and_folds_each_batch_once(spark, tmp_path):
    now = [0.0]
    fields = {"phase": F.col("kind"), "score": F.when(F.col("kind") == "progress", F.col("value"))}
    board = dashboard.Dashboard(spark, str(tmp_path), "k", "ord", fields, lambda t: t.select("k", "phase", "score"), forced=F.col("kind") == "verdict", clock=lambda: now[0])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, ord long, kind string, value double")
    shown = lambda: {r.k: (r.phase, r.score) for r in dashboard.document(spark, str(tmp_path), board.table().schema).collect()}
    board(batch(("a", 1, "progress", 0.5), ("b", 2, "started", None)), 0)
    assert shown() == {"a": ("progress", 0.5), "b": ("started", None)}
    now[0] = 2.0
    board(batch(("a", 3, "note", None), ("a", 0, "progress", 9.0)), 1)
    assert shown()["a"] == ("progress", 0.5)  # not due yet
    board(batch(("a", 7, "lost", None)), 1)  # the same batch again
    assert {r.k: r.phase for r in board.table().collect()} == {"a": "note", "b": "started"}
    board(batch(("b", 4, "verdict", None)), 2)
    assert shown() == {"a": ("note", 0.5), "b": ("verdict", None)}
    now[0] = 4.0
    board(batch(("c", 5, "started", None)), 3)
    assert "c" not in shown()
    board.close()
    assert shown()["c"] == ("started", None)
    now[0] = 9.5
    board(batch(("c", 6, "progress", 1.0)), 4)
    assert shown()["c"] == ("progress", 1.0)
    assert ranges.exists(str(tmp_path / dashboard.DOCUMENT)) and not [p for p in tmp_path.iterdir() if p.name.endswith(".new")]


@pytest.mark.parametrize("piece", [5, 500_000])
def test_retention_equals_sorting_the_listing(spark, monkeypatch, piece):
    monkeypatch.setattr(sampling, "PIECE", piece)
    rng = random.Random(3)
    files = [(i, rng.choice("ab") if i % 7 else None, rng.choice([1, 2, 5, None]), rng.randint(1, 20)) for i in range(60)]
    rows = spark.createDataFrame(files, "id long, g string, t long, size long")
    newest = lambda r: (r[2] is None, -(r[2] or 0), r[0])
    for n in (0, 1, 4, 100):
        want = {r[0] for g in ("a", "b", None) for r in sorted((f for f in files if f[1] == g), key=newest)[n:]}
        assert {r.id for r in retention.keep_recent(rows, "g", "t", n).where("evict").collect()} == want
        assert {r.id for r in retention.newest_n(rows, "t", n).where("keep").collect()} == {f[0] for f in sorted(files, key=newest)[:n]}
    oldest = sorted(files, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    for limit, free in ((100, files), (10_000, files), (300, [f for f in files if f[1] != "a"])):
        total, gone, want = sum(f[3] for f in files), 0, set()
        for f in (o for o in oldest if o in free):
            if total > limit and total - gone > 0.7 * limit:
                want.add(f[0])
            gone += f[3]
        protected = None if free is files else F.coalesce(F.col("g") == "a", F.lit(False))
        got = retention.watermark(rows, "size", "t", limit, protected=protected, ties=("id",))
        assert {r.id for r in got.collect()} == want


def test_an_entry_that_is_tried_again_comes_first(spark):
    queue = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "place long, repo string")
    got = registry.requeue_front(queue, spark.createDataFrame([("a",)], "repo string")).orderBy("place").collect()
    assert [r.repo for r in got] == ["a", "b", "c"]


def test_probes_of_their_own(spark):
    import numpy as np

    ids = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    got = {r.id: r for r in sampling.probe_plans(ids, b"s", 50, 2, 8, 3).collect()}
    assert set(got) == {1, 2} and got[1].private_digest != got[2].private_digest
    tokens = np.random.Generator(np.random.PCG64(1)).integers(0, 50, (2, 8), dtype=np.int64)
    assert got[1].public_digest == sampling.array_digest(tokens)
    assert len(got[1].positions) == 3 and sorted(got[1].positions) == got[1].positions


def test_requested_benchmarks(spark):
    rows = [(1, ["MMLU", "mmlu", None, ""], "MMLU=2,mmlu=3"), (2, ["x"], None), (3, None, ""), (4, ["winogrande"], "WinoGrande=-1")]
    requests = spark.createDataFrame(rows, "k long, names array<string>, shots string")
    got = boards.requested(requests, boards.registry(spark), "k", "names", "shots").collect()
    assert sorted((r.k, r.label, r.fewshot, r.known) for r in got if r.known) == [(1, "MMLU", 3, True), (4, "WinoGrande", 5, True)]
    assert [r.k for r in got if not r.known] == [2]


def bank_entry(digest, submission="s", **more):
    return {"version": "v", "key_id": "k", "model_digest": digest, "submission_id": submission, "model_ref": f"r/{digest}", "created_at": 1.0, "compatibility_key": "{}"} | more


def test_bank_store_follows_the_ordered_rule(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    base = [rng.normal(0, 3, (3, 12)).astype(np.float32) for _ in range(3)]
    offers = [("a", base[0]), ("b", base[1]), ("a2", base[0] + 1e-3), ("a", base[0]), ("c", base[2]), ("a3", base[0] + 2e-3), ("a4", base[0] - 1e-3), ("b2", base[1])]
    store, plain = bank.BankStore(spark, str(tmp_path), max_entries=5, max_similar=3), fingerprint.Bank(5, 3)
    for digest, logits in offers:
        half = np.frombuffer(fingerprint.encode(logits)[0], "<f2").reshape(3, 12).astype(np.float32)
        want = plain.offer(digest, "s", half, ("v", "k"))
        got = store.compare_and_store(logits, bank_entry(digest))
        assert (got["detected"], got["stored"], got["compared"]) == (want["detected"], want["stored"], want["compared"]), digest
        assert (got["match"] or {}).get("model_digest") == want["match"]
        stored = store.rows().orderBy("id").collect()
        assert [(r.model_digest, r.similarity_group) for r in stored] == [(r["digest"], r["group"]) for r in plain.rows]
    assert stored[0].id > 1 and [r.id for r in stored] == sorted({r.id for r in stored})
    assert store.compare_and_store(np.zeros((2, 12), np.float32), bank_entry("shape"))["compared"] == 0
    with pytest.raises(ValueError, match="digest"):
        store.compare_and_store(base[0], bank_entry(""))
    broken = store.rows().withColumn("logits_sha256", F.lit("0"))
    store.save(broken)
    with pytest.raises(Exception, match="does not match its digest"):
        store.compare_and_store(base[0], bank_entry("z"))


def test_an_older_bank_gains_its_families(spark, tmp_path):
    store = bank.BankStore(spark, str(tmp_path))
    assert store.rows().count() == 0
    store.save(spark.createDataFrame([(4, "m", "v", "k"), (9, "n", "v", "k")], "id long, model_digest string, version string, key_id string"))
    assert store.rows().columns == bank.COLUMNS.names
    arrivals = spark.createDataFrame([(1, "n", "v", "k"), (2, "o", "v", "k"), (3, "o", "v", "k"), (4, "o", "w", None), (5, "", "v", "k"), (6, None, "v", "k")], "o long, model_digest string, version string, key_id string")
    got = bank.insert(store.rows(), arrivals, "o").orderBy("id").collect()
    assert [(r.id, r.model_digest, r.version, r.similarity_group) for r in got] == [(4, "m", "v", "m"), (9, "n", "v", "n"), (10, "o", "v", "o"), (11, "o", "w", "o")]
    assert [r.id for r in bank.insert(store.rows(), arrivals, "o", 2).collect()] == [11, 10]
