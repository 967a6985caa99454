"""Duels as a service: a request, its run, its result and its progress, all of them tables.

A run samples sequences by a named strategy, scores them with a plug-in, and appends
its pairs, events and verdict to tables in a folder that all executors see. Results are
looked up there and progress is read as a stream, by any session and at any time.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import duel, packing, sampling

# Fixed value: replicates of a bootstrap that a request may ask for.
MAX_REPLICATES = 10_000
#: Rounds after the first look at an early stop: the rest of the sequences is scored in so many parts.
ROUNDS = 8


@dataclass(frozen=True)
class DuelRequest:
    """What a duel is asked for; the defaults are those of the service."""

    champion: str
    challenger: str
    champion_digest: str = ""
    challenger_digest: str = ""
    block_hash: str = ""
    submission_id: str = ""
    submission_block: int = 0
    hotkey: str = ""
    coldkey: str = ""
    text_field: str = "text"
    seq_len: int = 2048
    seq_len_multiplier: int = 4
    n: int = duel.MAX_SEQUENCES
    batch_size: int = 512
    alpha: float = 0.001
    delta_threshold: float = 0.0015
    n_bootstrap: int = 10_000
    seed: int = 0xE1A
    bootstrap_seed: int = 0xB007
    min_chars: int = 128
    max_chars: int = 0
    strategy: str = "hash"
    early_stop: bool = True

    def effective_length(self) -> int:
        """Tokens of a sequence that are scored."""
        return packing.effective_length(self.seq_len, self.seq_len_multiplier)

    def sample_seed(self) -> str:
        """What the sample is drawn by: the base seed, and with it the block and the submitter where the block is known."""
        block = (self.block_hash or "").strip()
        if not block or block == "default":
            return str(self.seed)
        return f"block_hash={block}|hotkey={(self.hotkey or '').strip()}|base_seed={self.seed}"

    def limited(self) -> DuelRequest:
        """The request within the bounds of the service."""
        return replace(self, n=min(self.n, duel.MAX_SEQUENCES), n_bootstrap=min(self.n_bootstrap, MAX_REPLICATES))

    def check(self) -> None:
        for name in ("n", "batch_size", "n_bootstrap", "seq_len", "seq_len_multiplier"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must lie between 0 and 1")
        if self.champion_digest and self.champion_digest == self.challenger_digest:
            raise ValueError("champion and challenger are the same weights")
        if self.strategy not in SAMPLERS:
            raise ValueError(f"no sampling strategy {self.strategy}; there are {', '.join(sorted(SAMPLERS))}")

    @classmethod
    def schema(cls) -> T.StructType:
        kinds = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}
        return T.StructType([T.StructField(f.name, kinds.get(str(f.type), T.ArrayType(T.StringType()))) for f in fields(cls)])


@dataclass(frozen=True)
class MultiSourceRequest(DuelRequest):
    """A duel over several sources; weights by position, equal ones if their number is another."""

    strategy: str = "balanced"
    sources: tuple[str, ...] = ()
    weights: tuple[float, ...] = field(default=())

    @classmethod
    def schema(cls) -> T.StructType:
        base = DuelRequest.schema()
        return T.StructType([*base.fields, T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])


def _hash_sample(rows: DataFrame, request: DuelRequest) -> DataFrame:
    return sampling.sample(rows, request.n, request.sample_seed(), "doc_id").drop("place")


def _balanced_sample(rows: DataFrame, request: DuelRequest) -> DataFrame:
    named, weights = getattr(request, "sources", ()), list(getattr(request, "weights", ()))
    if named:
        table = rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(named)], "idx long, source string")
    else:
        table = rows.select("source").distinct().withColumn("idx", F.row_number().over(W.orderBy("source")) - 1)
    quotas = sampling.source_quotas(table, request.n, weights, len(named) or len(weights)).select("source", "quota")
    return sampling.quota_sample(rows, quotas, request.sample_seed(), "doc_id")


#: Ways to choose a duel's sequences; more can be added by name.
SAMPLERS: dict[str, Callable[[DataFrame, DuelRequest], DataFrame]] = {"hash": _hash_sample, "balanced": _balanced_sample, "all": lambda rows, request: rows}


def load_plugin(name: str) -> Callable:
    """A scorer by ``module:function``; it takes rows (doc_id, source, text) and gives paired losses."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function or "score", None)
    if not callable(found):
        raise ValueError(f"{name} is no scorer")
    return found


EVENT = "eval_id string, ord long, type string, done long, total long, champion_mean double, mu_hat double, message string"


def sequences(rows: DataFrame, request: DuelRequest) -> DataFrame:
    """The sampled rows of a request: texts of the length asked for, cut after ``effective_length`` tokens."""
    field, limit = request.text_field, request.effective_length()
    length = F.length(field)
    fit = rows.where(length >= request.min_chars) if request.min_chars else rows
    if request.max_chars:
        fit = fit.withColumn(field, F.left(field, F.lit(request.max_chars)))
    chosen = SAMPLERS[request.strategy](fit, request)
    words = packing.words(F.col(field))
    return chosen.withColumn(field, F.when(F.size(words) > limit, F.array_join(F.slice(words, 1, limit), " ")).otherwise(F.col(field)))


def rounds(n: int, request: DuelRequest) -> list[int]:
    """Places up to which each round scores: at first what an early stop needs to see, then equal parts; whole batches."""
    if not request.early_stop:
        return [n]
    first = -(-max(1, int(n * duel.EARLY_STOP_FRACTION)) // request.batch_size) * request.batch_size
    step = max(1, -(-(n - first) // (ROUNDS * request.batch_size))) * request.batch_size
    return [*range(first, n, step), n] if first < n else [n]


def run_duel(spark: SparkSession, request: DuelRequest, rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], folder: str) -> str:
    """Run a duel over rows (doc_id, source, text) and give its id; a failure is recorded and raised.

    With early stop the sequences are scored in rounds, and none is scored once what is
    left can't win any more; the scorer then sees a round's rows at a time, so one that
    fits itself to all rows is run without.
    """
    request.check()
    asked_for, request = request, request.limited()
    eval_id = uuid.uuid4().hex[:8]
    asked = spark.createDataFrame([(eval_id, *[list(v) if isinstance(v, tuple) else v for v in asdict(asked_for).values()])], T.StructType([T.StructField("eval_id", T.StringType()), *type(request).schema().fields]))
    asked.write.mode("append").parquet(f"{folder}/requests/{type(request).__name__}")

    def tell(events: DataFrame) -> None:
        events.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in EVENT.split(", ")]).coalesce(1).write.mode("append").parquet(f"{folder}/events")  # a row for each batch

    def say(ord_: int, kind: str, message: str) -> None:
        tell(spark.createDataFrame([(eval_id, ord_, kind, None, None, None, None, message)], EVENT))

    capped = "" if request == asked_for else f"; n {asked_for.n} and n_bootstrap {asked_for.n_bootstrap} are bounded by {duel.MAX_SEQUENCES} and {MAX_REPLICATES}"
    say(0, "started", f"{request.challenger} against {request.champion}{capped}")
    try:
        sequences(rows, request).write.parquet(f"{folder}/sequences/{eval_id}")
        chosen = duel.numbered(spark.read.parquet(f"{folder}/sequences/{eval_id}"), "doc_id")
        n, before, stop, told = chosen.count(), 0, None, 0
        for end in rounds(n, request):
            part = chosen.where((F.col("i") >= before) & (F.col("i") < end)).drop("i")
            scorer(part).write.parquet(f"{folder}/pairs/eval_id={eval_id}/round={before}")
            before = end
            pairs = spark.read.parquet(f"{folder}/pairs/eval_id={eval_id}").drop("round")
            means = duel.running_means(pairs, request.batch_size).where(F.col("batch") >= told)
            tell(means.select(F.lit(eval_id).alias("eval_id"), (F.col("batch") + 1).alias("ord"), F.lit("progress").alias("type"), "done", F.lit(n).alias("total"), "champion_mean", "mu_hat", F.lit(None).alias("message")))
            told = -(-end // request.batch_size)
            stop = duel.early_stop(pairs, request.batch_size, request.delta_threshold, n).first() if request.early_stop else None
            if stop is not None:
                pairs = duel.numbered(pairs, "seq_idx").where(F.col("i") < stop["done"]).drop("i")
                break
        verdict = duel.verdict(pairs, request.n_bootstrap, request.alpha, request.delta_threshold, request.bootstrap_seed % duel.PRIME)
        facts = {"eval_id": eval_id, "champion": request.champion, "challenger": request.challenger, "champion_digest": request.champion_digest, "challenger_digest": request.challenger_digest, "hotkey": request.hotkey, "coldkey": request.coldkey, "seed_material": request.sample_seed()}
        numbers = {"n_requested": asked_for.n, "n_sampled": n, "n_scored": before, "seq_len": request.effective_length()}
        for name, value in facts.items():
            verdict = verdict.withColumn(name, F.lit(value))
        for name, value in numbers.items():
            verdict = verdict.withColumn(name, F.lit(value).cast("long"))
        sample = sampling.ids_digest(chosen.select("doc_id", F.col("i").alias("place")), "doc_id", "place").select(F.col("digest").alias("sample_digest"))
        verdict = verdict.crossJoin(F.broadcast(sample)).withColumn("stopped_early", F.lit(stop is not None))
        verdict.write.mode("append").parquet(f"{folder}/verdicts")
    except Exception as e:
        say(2**31, "error", str(e)[:500])
        raise
    say(2**31, "verdict", "done")
    return eval_id


def evaluation(spark: SparkSession, folder: str, eval_id: str) -> DataFrame:
    """State of one duel with its verdict, if it has one; no row for an id that was never given."""
    events = spark.read.schema(EVENT).parquet(f"{folder}/events").where(F.col("eval_id") == eval_id)
    last = F.max_by("type", "ord")
    state = F.when(last == "verdict", "completed").when(last == "error", "failed").otherwise("running")
    told = events.groupBy("eval_id").agg(state.alias("state"), F.max("done").alias("done"), F.max_by("message", "ord").alias("message"))
    try:
        verdicts = spark.read.parquet(f"{folder}/verdicts")
    except pyspark.errors.AnalysisException:  # no duel has ended yet
        return told
    return told.join(verdicts, "eval_id", "left")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all duels as a stream, in the order they are written."""
    return spark.readStream.schema(EVENT).parquet(f"{folder}/events")


def describe(spark: SparkSession) -> DataFrame:
    """The service's bounds and defaults, one row each."""
    defaults = asdict(replace(DuelRequest("", "")))
    rows = [("spark", spark.version), ("max_sequences", str(duel.MAX_SEQUENCES)), ("strategies", ",".join(sorted(SAMPLERS)))]
    rows += [(k, str(v)) for k, v in defaults.items() if isinstance(v, int | float) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "name string, value string")
