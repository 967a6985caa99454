"""Edge cases of the engine's own operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica import ingest as ingest_cli
from adjudica.functions import hashing, text
from adjudica.operators import boards, duel, evaluation, fingerprint, ingest, packing, registry, sampling
from adjudica.sources import npytok, scans


def sources(spark, weights):
    return spark.createDataFrame([(i, f"s{i}", float(w)) for i, w in enumerate(weights)], "idx int, source string, weight double")


@pytest.mark.parametrize(
    ("total", "weights", "want"), [(10, None, [4, 3, 3]), (10, [0.5, 0.3, 0.2], [5, 3, 2]), (10, [1, 1, 1], [4, 3, 3]), (10, [1, 2], [4, 3, 3]), (0, [1, 1, 1], [0, 0, 0])]
)
def test_quotas(spark, total, weights, want):
    rows = sampling.source_quotas(sources(spark, [1, 1, 1]).drop("weight"), total, weights, 3).orderBy("idx").collect()
    assert [r.quota for r in rows] == want


def test_quotas_sum_to_the_total(spark):
    rng = np.random.default_rng(0)
    for total in (1, 7, 1000):
        rows = sampling.weighted_quotas(sources(spark, rng.random(9) + 0.01), total).collect()
        assert sum(r.quota for r in rows) == total


def losses(spark, d):
    return spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate(d)], "seq_idx long, champion_loss double, challenger_loss double")


def test_equal_losses_are_not_accepted(spark):
    v = duel.verdict(losses(spark, [0.0] * 20), 20, delta=0.0).first()
    assert (v.mu_hat, v.lcb, v.accepted) == (0.0, 0.0, False)
    assert duel.verdict(losses(spark, [1.0] * 20), 20, delta=0.5).first().accepted


def test_exact_bootstrap_is_numpys(spark):
    d = np.random.default_rng(1).normal(0.1, 1, 50)
    got = duel.exact_verdict(losses(spark, d), 200, 0.01, 0.0, 5).first()
    rng = np.random.default_rng(5)
    want = np.quantile([d[rng.integers(0, 50, 50)].mean() for _ in range(200)], 0.01)
    assert got.lcb == pytest.approx(want) and got.n_sequences == 50


def test_early_stop_needs_a_fifth_and_not_all(spark):
    assert duel.early_stop(losses(spark, [-1.0] * 20), 2, 0.0015).first().done == 4
    assert duel.early_stop(losses(spark, [1.0] * 20), 2, 0.0015).count() == 0
    assert duel.early_stop(losses(spark, [-1.0] * 2), 2, 0.0015).count() == 0


def test_overlapping_cohorts_give_no_threshold(spark):
    rows = spark.createDataFrame([(0.1, True), (0.05, False)], "d double, c boolean")
    found = duel.log_midpoint_threshold(rows, "d", F.col("c")).first()
    assert found.overlap and found.threshold is None


def test_packing_keeps_every_token(spark):
    rows = spark.createDataFrame([("a", i, ["t"] * (i % 5)) for i in range(23)], "source string, doc_id int, tokens array<string>")
    packed = packing.pack(rows, ["source"], ["doc_id"], 8).collect()
    assert sum(r.n_tokens for r in packed) == sum(i % 5 + 1 for i in range(23))
    assert all(r.n_tokens == 8 for r in packing.pack(rows, ["source"], ["doc_id"], 8, keep_tail=False).collect())
    with pytest.raises(ValueError):
        packing.effective_length(7, 3, 8)
    assert packing.effective_length(8, 4, 8) == 32


def test_partitions(spark):
    rows = spark.createDataFrame([(i,) for i in range(7)], "f int")
    sizes = lambda df: sorted((r["count"] for r in df.groupBy("part").count().collect()), reverse=True)
    assert sizes(sampling.contiguous(rows, "f", 3)) == sizes(sampling.round_robin(rows, "f", 3)) == [3, 2, 2]
    bins = sampling.greedy_bins(spark.createDataFrame([("a", 9), ("b", 5), ("c", 4), ("d", 1)], "key string, size long"), 2).collect()
    load = {0: 0, 1: 0}
    for r in bins:
        load[r.bin] += r.size
    assert sorted(load.values()) == [9, 10]


def test_bank_rules():
    rng = np.random.default_rng(0)
    bank = fingerprint.Bank(max_entries=3, max_similar=2, limit=1e-3)
    x = rng.normal(size=(1, 16)).astype(np.float32)
    first = bank.offer("d1", "s1", x)
    assert first["stored"] and first["compared"] == 0
    assert bank.offer("d1", "s1", x)["compared"] == 0
    again = bank.offer("d1", "s2", x)  # compared with its own row
    assert again["js"] == pytest.approx(0, abs=1e-9) and again["stored"] and len(bank.rows) == 1
    assert bank.offer("d2", "s3", x + 1e-4)["stored"]
    full = bank.offer("d3", "s4", x)
    assert full["detected"] and not full["stored"] and full["family"] == 2
    for i in range(5):
        bank.offer(f"o{i}", "z", rng.normal(size=(1, 16)).astype(np.float32) * 3)
    assert len(bank.rows) == 3
    # Other keys are not compared, but take room.
    assert bank.offer("d1", "s9", x, ("v2",))["compared"] == 0
    assert len(bank.rows) == 3 and sum(r["key"] == ("v2",) for r in bank.rows) == 1


def test_divergence_of_equal_and_swapped(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 5, 8)).tolist()
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, x array<double>, y array<double>")
    lp = fingerprint.with_log_probabilities(rows, "x").withColumnRenamed("lp", "lp_a")
    lp = fingerprint.with_log_probabilities(lp, "y").withColumnRenamed("lp", "lp_b")
    d = fingerprint.distances(lp).orderBy("i").collect()
    swapped = fingerprint.distances(lp, "lp_b", "lp_a").orderBy("i").collect()
    want = fingerprint.js_rows(np.array(a), np.array(b))
    for r, s, w in zip(d, swapped, want, strict=True):
        assert r.js == pytest.approx(w) == pytest.approx(s.js) and 0 <= r.js <= np.log(2)
    own = fingerprint.distances(lp.withColumn("lp_b", F.col("lp_a"))).collect()
    assert all(r.js < 1e-12 and r.top1 == 1 for r in own)


def test_payload_round_trip_and_checks():
    x = np.random.default_rng(0).normal(size=(3, 7)).astype(np.float16).astype(np.float32)
    raw, digest = fingerprint.encode(x)
    assert (fingerprint.decode(raw, 3, 7, digest) == x).all()
    with pytest.raises(ValueError):
        fingerprint.decode(raw, 3, 8, digest)
    with pytest.raises(ValueError):
        fingerprint.decode(raw, 3, 7, "0" * 64)


def test_token_shards(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", 0, [1, 2, 3]), ("a", 1, [4, 2**32 - 1]), ("b", 0, [7] * 9)], "source string, ord int, tokens array<long>")
    manifest = {r.source_file: r for r in npytok.write_shards(rows, folder).collect()}
    assert (manifest["a"].n_tokens, manifest["b"].n_tokens) == (5, 9)
    assert np.load(f"{folder}/a.npy").tolist() == [1, 2, 3, 4, 2**32 - 1]
    assert npytok.token_count(f"{folder}/b.npy") == 9
    npytok.register(spark)
    back = spark.read.format("npytok").option("width", 2).load(folder)
    assert {r.record_idx: list(r.tokens) for r in back.collect()} == {0: [1, 2], 1: [3, 4], 2: [7, 7], 3: [7, 7], 4: [7, 7], 5: [7, 7]}
    assert [r.record_idx for r in back.where("record_idx = 3").collect()] == [3]
    np.save(tmp_path / "wide.npy", np.zeros((2, 2, 2), "<u4"))
    np.save(tmp_path / "long.npy", np.zeros(4, "<i8"))
    for bad in ("wide", "long"):
        with pytest.raises(ValueError):
            npytok.header_of(str(tmp_path / f"{bad}.npy"))


def test_text_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", "")], "n int, question string, other string, content string")
    assert scans.text_column(df, "text", scans.TEXT_COLUMNS) == "content"
    assert scans.text_column(df, "text") == "question"
    assert scans.texts(df, "content").count() == 0
    with pytest.raises(ValueError):
        scans.text_column(df, "text", strict=True)


def test_strings(spark):
    row = spark.range(1).select(
        text.slug(F.lit("Org/My Model@x!")).alias("a"), text.slug(F.lit("///")).alias("b"), text.human_bytes(F.lit(1536)).alias("c"), text.human_age(F.lit(90_000)).alias("d"),
        text.parse_time(F.lit("Tue, 1 Sep 2026 10:00:00 GMT")).cast("long").alias("e"), text.parse_time(F.lit("2026-09-01T10:00:00Z")).cast("long").alias("f"),
        text.model_ref(F.lit("https://hub.example.org/o/n/tree/main"), "hub.example.org", "mirror.example").alias("g"),
        text.config_name(F.lit("data/fr/x.parquet")).alias("h"), text.config_name(F.lit("x.parquet")).alias("i"),
        hashing.seed_material(F.lit("default"), F.lit("k"), F.lit(4)).alias("j"), text.error_class(F.lit("HTTP 502")).alias("k"), text.plain_digest(F.lit("SHA256:AB")).alias("l"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("Org-My-Model-x", "unknown", "1.5 KiB", "1.0d")
    assert row.e == row.f and row.g == "o/n" and (row.h, row.i) == ("fr", "train")
    assert row.j == "base_seed=4" and (row.k.transient, row.k.label) == (True, "502") and row.l == "ab"


def test_benchmark_names(spark):
    specs = boards.registry(spark)
    assert {r.label for r in boards.select_benchmarks(specs, ["mmlu", "GSM8K"]).collect()} == {"MMLU", "GSM8K"}
    with pytest.raises(ValueError):
        boards.select_benchmarks(specs, ["nope"])
    with pytest.raises(ValueError):
        boards.override_shots(specs, {"nope": 1})


def test_seeds():
    assert hashing.source_seed(1, "a") != hashing.source_seed(1, "b")
    assert hashing.blake_seed("x", "big") == int.from_bytes(hashing.blake_seed("x").to_bytes(8, "little"), "big")
    assert sorted(sampling.exact_choice(5, 9, 0)) == [0, 1, 2, 3, 4]


def test_queue_fold_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"h{rng.integers(12)}", f"d{rng.integers(6)}") for i in range(80)]
    who, what, want = set(), set(), {}
    for i, h, d in rows:
        want[i] = "seen_hotkey" if h in who else "digest_already_completed" if d in what else "queued"
        who.add(h)
        what |= {d} if want[i] == "queued" else set()
    got = registry.fold_queue(spark.createDataFrame(rows, "ord long, hotkey string, digest string"))
    assert {r.ord: r.reason for r in got.collect()} == want


def test_runs_and_offsets_do_not_depend_on_pieces(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = sorted({int(x) for x in rng.integers(0, 3000, 400)})
    want, run = [], [values[0]]
    for v in values[1:]:
        if v - run[-1] > 9:
            want.append((run[0], run[-1], len(run)))
            run = []
        run.append(v)
    want.append((run[0], run[-1], len(run)))
    rows = spark.createDataFrame([("a" if v % 3 else None, v, ["x"] * (v % 5)) for v in values], "s string, id long, tokens array<string>")
    for stretch in (10, 700, 10_000):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        monkeypatch.setattr(sampling, "PIECE", stretch)
        got = packing.merge_ranges(spark.createDataFrame([(v,) for v in values], "i long"), "i", 9).collect()
        assert sorted(tuple(r[c] for c in ("first", "last", "n")) for r in got) == want
        at = {"a": 0, None: 0}
        ends = {(r.s, r.id): (r.start, r.end) for r in packing.token_offsets(rows, ["s"], ["id"]).collect()}
        for v in values:
            s = "a" if v % 3 else None
            assert ends[s, v] == (at[s], at[s] + v % 5 + 1)
            at[s] += v % 5 + 1


def test_requests_are_checked_and_failures_recorded(spark, tmp_path):
    with pytest.raises(ValueError, match="strategy"):
        evaluation.DuelRequest("a", "b", strategy="none").check()
    with pytest.raises(ValueError, match="n must"):
        evaluation.MultiSourceRequest("a", "b", n=0).check()
    rows = spark.createDataFrame([(i, "s", "word " * 60) for i in range(9)], "doc_id long, source string, text string")
    request = evaluation.DuelRequest("a", "b", batch_size=2, n_bootstrap=50)

    def worse(d):
        return d.select(F.col("doc_id").alias("seq_idx"), "source", F.lit(1.0).alias("champion_loss"), F.lit(2.0).alias("challenger_loss"))

    done = evaluation.run_duel(spark, request, rows, worse, str(tmp_path))
    r = evaluation.evaluation(spark, str(tmp_path), done).first()
    assert (r.state, r.accepted, r.stopped_early, r.n_sequences) == ("completed", False, True, 2)
    with pytest.raises(Exception, match="no_such"):
        evaluation.run_duel(spark, request, rows, lambda d: d.select("no_such"), str(tmp_path))
    states = spark.read.parquet(f"{tmp_path}/events").groupBy("eval_id").agg(F.max_by("type", "ord").alias("t"))
    assert sorted(x.t for x in states.collect()) == ["error", "verdict"]
    assert evaluation.evaluation(spark, str(tmp_path), "unknown").count() == 0


def test_ingest_command_line(spark, tmp_path, capsys):
    rows = [(i, "a" if i % 3 else "b", "one two three") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "in"))
    assert ingest_cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--keep-tail", "--part-id", "p1"]) == 0
    assert capsys.readouterr().out == "2 shards, 48 tokens\n"
    assert sorted(p.name for p in (tmp_path / "out").glob("*.npy")) == ["p1-a-000000.npy", "p1-b-000000.npy"]
    assert ingest_cli.main([str(tmp_path / "in"), "", "--dry-run", "--one-shard-per-source"]) == 0
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["total_tokens"] == 48
    (tmp_path / "list.json").write_text('{"files": ["b", "a"]}')
    capsys.readouterr()
    options = ["--ordered-packed-part", "--file-list", str(tmp_path / "list.json"), "--part-id", "p2", "--distributed-run-id", "r", "--part-manifest-only", "--keep-tail", "--tokenizer", "t"]
    assert ingest_cli.main([str(tmp_path / "in"), str(tmp_path / "out"), *options]) == 0
    assert capsys.readouterr().out == "1 shards, 48 tokens\n"
    part = json.loads((tmp_path / "out" / "parts" / "r" / "p2" / "manifest.json").read_text())
    assert (part["tokenization_mode"], part["tokenizer"], part["part_id"], part["total_shards"]) == ("ordered_packed_part", "t", "p2", 1)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["total_shards"] == 2
    assert ingest_cli.main([str(tmp_path / "in"), "", "--dry-run", "--include-prefixes", "b", "--keep-tail"]) == 0
    assert capsys.readouterr().out == "1 shards, 16 tokens\n"
    with pytest.raises(ValueError, match="part_id"):
        ingest_cli.main([str(tmp_path / "in"), "", "--part-manifest-only"])


def test_encoders_of_one_name_are_kept_apart(spark):
    rows = spark.createDataFrame([(0, "a b")], "ord long, text string").coalesce(1)
    for n in (1, 2):
        assert ingest.tokenise(rows, lambda: lambda texts: [[n] for _ in texts]).first().tokens == [n]
    assert ingest.identity(ingest.word_encoder, "x") != ingest.identity(ingest.word_encoder, "y")


def test_an_early_stop_leaves_the_rest_unscored(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s", "word " * 60) for i in range(100)], "doc_id long, source string, text string")
    scored = []

    def worse(d):
        scored.append(d.count())
        return d.select(F.col("doc_id").alias("seq_idx"), "source", F.lit(1.0).alias("champion_loss"), F.lit(2.0).alias("challenger_loss"))

    request = evaluation.DuelRequest("a", "b", batch_size=5, n_bootstrap=20, n=20_000, block_hash="0x1", hotkey="h", seq_len=3, seq_len_multiplier=2)
    r = evaluation.evaluation(spark, str(tmp_path), evaluation.run_duel(spark, request, rows, worse, str(tmp_path))).first()
    assert scored == [20] and (r.n_scored, r.n_sampled, r.n_requested, r.stopped_early, r.done) == (20, 100, 20_000, True, 20)
    assert r.seed_material == "block_hash=0x1|hotkey=h|base_seed=3610" and len(r.sample_digest) == 64 and r.seq_len == 6
    assert all(len(x.text.split()) == 6 for x in evaluation.sequences(rows, request).collect())
    assert evaluation.rounds(100, request) == [20, 30, 40, 50, 60, 70, 80, 90, 100]
    assert evaluation.rounds(3, request) == [3] and evaluation.rounds(0, request) == [0]
    with pytest.raises(ValueError, match="same weights"):
        evaluation.DuelRequest("a", "b", "sha256:1", "sha256:1").check()


def test_places_do_not_depend_on_pieces(spark, monkeypatch):
    values = [None, *range(0, 700, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "id long")
    for piece in (10, 250, 10_000):
        monkeypatch.setattr(sampling, "PIECE", piece)
        assert [r.id for r in sampling.placed(rows, "id").orderBy("i").collect()] == values
        sizes = sampling.contiguous(rows, "id", 7).groupBy("part").count().orderBy("part").collect()
        assert [r["count"] for r in sizes] == [15, 15, 15, 14, 14, 14, 14]
