"""The stream's state machine against a replay of all events at once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from adjudica.streaming import events as ev
from adjudica.streaming import watchdog
from adjudica.streaming.watchdog import MICROS, Rules, replay

SCHEMA = "key string, ts timestamp, kind string, place long"


def test_silence_is_warned_about_once_and_fails_later():
    at = lambda *s: [(x * MICROS, "progress") for x in s]
    told = replay(at(0, 100, 300, 700), 800 * MICROS, Rules(retries=0))
    assert told == [(280 * MICROS, "idle_warned", 1), (480 * MICROS, "idle_warned", 1)]
    told = replay(at(0, 500), 600 * MICROS, Rules(retries=0))
    assert [t[:2] for t in told] == [(180 * MICROS, "idle_warned"), (420 * MICROS, "idle_failed")]


def test_errors_are_retried_then_final_and_a_result_forgives():
    events = [(10, "error"), (20, "progress"), (30, "error"), (40, "error"), (50, "verdict"), (60, "error")]
    told = replay([(s * MICROS, k) for s, k in events], 70 * MICROS)
    assert [(at // MICROS, phase, n) for at, phase, n in told] == [(10, "error_retry", 1), (30, "error", 2), (40, "error_retry", 1), (50, "done", 2), (60, "error_retry", 1)]


def test_a_lively_evaluation_meets_its_limit_and_a_retry_is_forgotten():
    told = replay([(s * MICROS, "progress") for s in range(0, 3000, 100)], 3000 * MICROS)
    assert [(at // MICROS, p) for at, p, _ in told] == [(2700, "hard_timeout")]
    rules = Rules(forget=1000)
    assert [t[1] for t in replay([(0, "error"), (2000 * MICROS, "error")], 2001 * MICROS, rules)] == ["error_retry", "error_retry"]
    assert [t[1] for t in replay([(0, "error"), (900 * MICROS, "error")], 901 * MICROS, rules)] == ["error_retry", "error"]


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_in_batches_equals_replay(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows, start = [], datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    now = 0
    for place in range(160):
        now += rng.choice([5, 60, 120, 200, 450])
        rows.append((rng.choice("abc"), start + datetime.timedelta(seconds=now), rng.choice(["progress"] * 6 + ["error", "verdict"]), place))
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withWatermark("ts", "0 seconds")
    found = []
    run = lambda df, _: found.extend(df.withColumn("at", F.unix_micros("at")).collect())
    with watchdog.stateful(spark):
        told = watchdog.watch(stream, "key", "ts", "kind", "place")
        told.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    base = int(start.timestamp()) * MICROS
    for key in "abc":
        events = [(int(r[1].timestamp()) * MICROS, r[2]) for r in rows if r[0] == key]
        want = replay(events, base + now * MICROS)
        got = sorted(((r["at"], r["phase"], r["attempt"]) for r in found if r["key"] == key), key=lambda t: t[0])
        assert got == want, key
    state = spark.read.format("statestore").option("stateVarName", "evaluation").load(str(tmp_path / "state"))
    assert state.count() <= 3


def test_a_replayed_batch_is_not_written_twice(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(5)], "x long")
    sink = ev.Appended(str(tmp_path / "t"))
    for batch in (0, 1, 1):
        sink(rows, batch)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
