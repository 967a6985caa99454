"""Queries without a SQL twin, held against plain Python over the same table; switches of join form give equal rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.functions import hashing
from adjudica.operators import duel, fingerprint, sampling
from adjudica.plans.catalogue import ORACLES, QUERIES
from adjudica.plans.duels import pairs_of

from .oracle import same

SF = "/root/testdata/sf0.001"


def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def rows(sql):
    return duckdb.sql(sql.replace("$", f"{SF}/")).fetchall()


def test_seed_integers(spark):
    got = {r.source: (r.seed, r.mixed) for r in QUERIES["seed_integers"](spark, SF).collect()}
    mix = lambda n: ((n * 0x9E3779B9) ^ 0x9E3779B9) & 0xFFFFFFFF
    assert got == {s: (hashing.blake_seed(f"42:{s}") % 2**63, mix(len(s))) for (s,) in rows("SELECT DISTINCT source FROM '$documents.parquet'")}


def test_holdout_sample(spark):
    ids = [i for (i,) in rows("SELECT doc_id FROM '$documents.parquet' ORDER BY doc_id")]
    picked = np.random.default_rng(7).choice(len(ids), 64, replace=False)
    got = QUERIES["holdout_sample"](spark, SF).collect()
    assert {r.k: r.doc_id for r in got} == {k: ids[i] for k, i in enumerate(picked)}
    assert {r.digest for r in got} == {sampling.array_digest(picked)}


def test_copy_families(spark):
    bank, want = fingerprint.Bank(limit=0.05), {}
    for vec, logits, label in rows("SELECT vec_id, embedding, label FROM '$embeddings.parquet' ORDER BY vec_id"):
        d = bank.offer(f"d{vec}", f"s{vec}", np.asarray(logits, np.float32).reshape(1, -1), ("v1", str(label)))
        want[vec] = (d["detected"], d["stored"], d["too_similar"], d["family"], d["compared"], d["match"])
    got = {r.ord: (r.detected, r.stored, r.too_similar, r.family, r.compared, r.match) for r in QUERIES["copy_families"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["bootstrap_exact_numpy", "paired_eval_alt"])
def test_exact_bootstraps(spark, name):
    d = np.array([r.champion_loss - r.challenger_loss for r in pairs_of(table(spark)).orderBy("seq_idx").collect()])
    rng = np.random.default_rng(0 if name == "bootstrap_exact_numpy" else hashing.blake_seed("block|hotkey"))
    lcb = np.quantile([d[rng.integers(0, len(d), len(d))].mean() for _ in range(1000)], 0.001)
    r = QUERIES[name](spark, SF).first()
    assert (r.n_sequences, r.capped, r.accepted) == (len(d), False, bool(lcb > 0.0015))
    assert r.lcb == pytest.approx(lcb, rel=1e-9, abs=1e-12) and r.mu_hat == pytest.approx(d.mean(), rel=1e-9, abs=1e-12)


def test_a_capped_duel_says_so(spark, monkeypatch):
    monkeypatch.setattr(duel, "MAX_SEQUENCES", 50)
    r = QUERIES["bootstrap_exact_numpy"](spark, SF).first()
    assert (r.n_sequences, r.n_requested, r.capped) == (50, table(spark)("documents").count(), True)


def test_draws_meet_values_alike_with_and_without_a_broadcast(spark, monkeypatch):
    values = spark.range(40).select(F.col("id").alias("i"), (F.col("id") * 0.25).alias("d"))
    near = {r.b: r["mean"] for r in duel.bootstrap_means(values, 20, 3).collect()}
    monkeypatch.setattr(duel, "MAX_BROADCAST", 10)
    assert {r.b: r["mean"] for r in duel.bootstrap_means(values, 20, 3).collect()} == near
    want = [np.mean([0.25 * (int(x) % 40) for x in draws(b)]) for b in range(20)]
    assert [near[b] for b in range(20)] == pytest.approx(want)


def draws(b, n=40, seed=3):
    m = duel.MULTIPLIERS
    for k in range(n):
        x = (k * m[0] + b * m[1] + seed) % duel.PRIME * m[2] % duel.PRIME
        y = (x * x + k) % duel.PRIME
        yield (y * y + x) % duel.PRIME


@pytest.mark.parametrize("hot", [1, 3, 100_000])
def test_losses_of_odd_tables(spark, tmp_path, monkeypatch, hot):
    """Repeated and missing ids, sources and labels; tokens that are broadcast and tokens that are not."""
    documents = [(1, "a", "x y x  z"), (1, "a", "y q"), (1, None, "x"), (2, "a", ""), (3, "b", None), (None, "b", "x only"), (4, "b", "z z w"), (5, None, "x y\nz")]
    labels = [(1, 1, 0), (1, 1, 1), (2, 0, 0), (4, 1, 0), (5, None, 1), (None, 1, 0), (9, 1, 0)]
    spark.createDataFrame(documents, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(duel, "HOT_TOKENS", hot)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["duel_pair_losses"](spark, str(tmp_path))
    same(got, con, ORACLES["duel_pair_losses"])
    # The texts are not scored anew by each reader: what is given is a table.
    assert all("/losses-" in f for f in duel.cohort_scores(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).inputFiles())


@pytest.mark.parametrize("held", [7, 1000])
def test_draws_by_group_and_part(spark, monkeypatch, held):
    """Groups of other sizes, null values and null groups; tasks that hold all values and tasks that hold a part."""
    sizes = {"a": 40, "b": 1, "c": 23, None: 5}
    values = {g: [None if g == "c" and i % 4 == 0 else float(i * i) for i in range(n)] for g, n in sizes.items()}
    df = spark.createDataFrame([(g, i, d) for g, ds in values.items() for i, d in enumerate(ds)], "g string, i long, d double")
    monkeypatch.setattr(duel, "MAX_BROADCAST", held)
    monkeypatch.setattr(duel, "DRAWS", 50)
    got = {(r.g, r.b): r["mean"] for r in duel.bootstrap_means(df, 9, 2**31 + 5, "g").collect()}
    want = {}
    for g in ("a", "b", "c"):
        for b in range(9):
            drawn = [values[g][int(x) % sizes[g]] for x in draws(b, sizes[g], 2**31 + 5)]
            want[g, b] = np.mean([x for x in drawn if x is not None])
    assert got == pytest.approx(want)


def test_draws_are_not_shuffled(spark):
    """Values are, once packed; draws, replicates times as many, meet them in a task."""
    values = spark.range(5000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("d"))
    plan = duel.bootstrap_means(values, 50, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join Inner, (i" not in plan


@pytest.mark.parametrize("spread", [3, 1000])
def test_stop_points_equal_brute_force(spark, monkeypatch, spread):
    """Quantiles of each prefix, with crowds of equal values and null ones, whatever the ranges."""
    rng = np.random.default_rng(spread)
    d = [None if rng.random() < 0.05 else float(x) for x in rng.integers(-spread, spread, 500) / 8]
    d[:3] = [None] * 3
    pairs = spark.createDataFrame([(5 * i, x, 0.0) for i, x in enumerate(d)], "seq_idx long, champion_loss double, challenger_loss double")
    monkeypatch.setattr(duel, "RANGE", 60)
    got = {r.batch: (r.done, r.n, r.heuristic_bound, r.stops) for r in duel.stop_points(pairs, 3, 0.05).collect()}
    for batch in range(167):
        done = min(3 * batch + 3, 500)
        seen = [x for x in d[:done] if x is not None]
        if not seen:
            assert got[batch] == (done, 500, None, None if done >= 100 else False)
            continue
        bound = (sum(seen) + (500 - done) * np.quantile(seen, 0.94)) / 500
        assert got[batch][:2] == (done, 500) and got[batch][2] == pytest.approx(bound)
        assert got[batch][3] == (100 <= done < 500 and got[batch][2] < 0.05)
    assert len(got) == 167
