"""Progress events, in batch and as streams: folds, gaps, sessions, debouncing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import shared_folder

WARN_SECONDS = 180
FAIL_SECONDS = 420


def in_order(key: str, order: list[str]):
    return W.partitionBy(key).orderBy(*order)


def seconds(ts: str) -> Column:
    """Seconds of a timestamp with or without zone, with fractions."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def idle_gaps(events: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """Events followed by silence of WARN_SECONDS or more, with what it leads to."""
    gap = F.lead(seconds(ts)).over(in_order(key, order)) - seconds(ts)
    state = F.when(F.col("gap") >= FAIL_SECONDS, "fail").otherwise("warn")
    return events.withColumn("gap", gap).where(F.col("gap") >= WARN_SECONDS).withColumn("state", state)


def fold_state(events: DataFrame, key: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """The last non-null value of each field per key."""
    place = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), place)).alias(n) for n, v in fields.items()])


def longest_runs(events: DataFrame, key: str, order: list[str], test: Column) -> DataFrame:
    """Per key: longest run of events that pass, and the run at the end."""
    w = in_order(key, order)
    breaks = F.sum(F.when(test, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    runs = events.withColumn("_run", breaks).withColumn("_hit", test.cast("int")).groupBy(key, "_run").agg(F.sum("_hit").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "_run").alias("at_end"))


def debounce(events: DataFrame, ts: str, width: int, order: list[str]) -> DataFrame:
    """The last event of every ``width`` seconds."""
    bucket = F.floor(seconds(ts) / width)
    w = W.partitionBy("bucket").orderBy(*[F.desc(o) for o in order])
    return events.withColumn("bucket", bucket).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def changed(events: DataFrame, key: str, order: list[str], marker: str) -> DataFrame:
    """Events whose marker differs from the one before."""
    before = F.lag(marker).over(in_order(key, order))
    return events.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(marker))).drop("_b")


def filled(events: DataFrame, ts: str, width: int) -> DataFrame:
    """One row every ``width`` seconds from the first to the last event, with the events since the beat before."""
    slot = F.floor(seconds(ts) / width)
    per = events.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    ends = per.agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    beats = ends.select(F.explode(F.sequence("a", "b")).alias("slot"))
    return beats.join(per, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))


def cool_downs(events: DataFrame, key: str, ts: str, order: list[str], width: float) -> DataFrame:
    """Failures that begin a cool-down: at least ``width`` seconds after the one that began the last.

    Each decision needs the one before, so a key's failures are folded in order.
    """

    def run(pdf):
        last, keep = None, []
        for i, t in zip(pdf.index, pdf["_t"], strict=True):
            if last is None or t - last >= width:
                last = t
                keep.append(i)
        return pdf.loc[keep, ["_k", "_id"]].rename(columns={"_k": key, "_id": order[-1]})

    rows = events.select(F.col(key).alias("_k"), F.col(order[-1]).alias("_id"), seconds(ts).alias("_t"))
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return rows.groupBy("_k").applyInPandas(lambda p: run(p.sort_values(["_t", "_id"])), f"{key} {kinds[key]}, {order[-1]} {kinds[order[-1]]}")


def attempts(events: DataFrame, key: str, order: list[str], failed: Column, limit: int) -> DataFrame:
    """Each failure's number since the last success, and whether it retries or gives up."""
    w = in_order(key, order)
    runs = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = events.withColumn("_run", runs).where(failed)
    attempt = F.row_number().over(W.partitionBy(key, "_run").orderBy(*order))
    return numbered.withColumn("attempt", attempt).withColumn("action", F.when(attempt <= limit, "retry").otherwise("fail")).drop("_run")


def read_stream(spark, folder: str, schema, ts: str, late: str = "1 hour") -> DataFrame:
    """A folder of Parquet files as a stream with a watermark; times without zone are taken as UTC."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_counts(events: DataFrame, ts: str, width: str, kind: str, slide: str | None = None) -> DataFrame:
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(win.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Appended:
    """A batch sink whose rows lie in a folder for each batch, so that a replayed batch replaces its own rows."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/_batch={batch}")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there into a Parquet table in the shared folder, and read it.

    Every batch replaces the table in mode ``complete`` and adds its rows in mode
    ``append``; nothing is held by the driver.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, name)

    def replace(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/table")

    put = replace if mode == "complete" else Appended(f"{folder}/table")
    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(stream.schema)
    if mode != "complete":
        found = found.option("recursiveFileLookup", "true")
    return found.parquet(f"{folder}/table")
