"""Benchmark boards: metrics, totals, upserts, queue, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a benchmark, and those after which nothing more comes.
STATUSES = ["completed", "completed_no_metric", "failed", "missing", "running", "pending"]
TERMINAL = ["completed", "missing"]
# Benchmark label, task, shots and metric names in order of preference.
BENCHMARKS = [
    ("MMLU", "mmlu", 5, ["acc,none", "acc"]),
    ("MMLU-Pro", "mmlu_pro", 5, ["acc,none", "acc"]),
    ("BBH", "leaderboard_bbh", 3, ["acc,none", "exact_match,none", "exact_match", "acc"]),
    ("ARC-C", "arc_challenge", 25, ["acc_norm,none", "acc_norm", "acc,none", "acc"]),
    ("TruthfulQA", "truthfulqa_mc2", 0, ["mc2,none", "mc2", "acc,none", "acc"]),
    ("WinoGrande", "winogrande", 5, ["acc,none", "acc"]),
    ("HellaSwag", "hellaswag", 10, ["acc_norm,none", "acc_norm", "acc,none", "acc"]),
    ("GSM8K", "gsm8k", 4, ["exact_match,strict-match", "exact_match,flexible-extract", "exact_match,none", "exact_match"]),
    ("MATH", "minerva_math", 4, ["exact_match,none", "exact_match", "math_verify,none", "math_verify"]),
    ("HumanEval", "humaneval", 0, ["pass@1,create_test", "pass@1,none", "pass@1", "pass_at_1,create_test", "pass_at_1,none", "pass_at_1"]),
    ("MBPP", "mbpp", 0, ["pass@1,create_test", "pass@1,none", "pass@1", "pass_at_1,create_test", "pass_at_1,none", "pass_at_1"]),
]
# Beginnings of metric names that will do when no preferred one is there.
METRIC_PREFIXES = ["acc", "exact_match", "pass@1", "pass_at_1", "mc2"]


def registry(spark) -> DataFrame:
    rows = [(i, *b) for i, b in enumerate(BENCHMARKS)]
    return spark.createDataFrame(rows, "ord int, label string, task string, fewshot int, metrics array<string>")


def select_benchmarks(specs: DataFrame, wanted: list[str]) -> DataFrame:
    """Registry rows named by label or task, whatever the case; unknown names are an error."""
    names = [w.strip().lower() for w in wanted if w.strip()]
    known = {x.lower() for label, task, *_ in BENCHMARKS for x in (label, task)}
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown benchmarks: {unknown}")
    return specs.where(F.lower("label").isin(names) | F.lower("task").isin(names))


def requested(requests: DataFrame, specs: DataFrame, key: str, wanted: str, shots: str) -> DataFrame:
    """(key, label, task, fewshot, known) for requests with an array of names and a ``label=shots`` list.

    Names are labels or tasks in any case, each once; a name of neither is a row without
    label and known false. Shots that don't parse, are negative or fit no label leave the
    benchmark's own. The registry is the smaller side, a row for each benchmark.
    """
    names = F.array_distinct(F.transform(F.col(wanted), lambda x: F.lower(F.trim(x))))
    asked = requests.select(key, shots, F.explode(F.filter(names, lambda x: x.isNotNull() & (x != ""))).alias("_name"))
    by_name = specs.select(F.lower("label").alias("_name"), "label", "task", "fewshot").unionByName(specs.select(F.lower("task").alias("_name"), "label", "task", "fewshot")).dropDuplicates(["_name", "label"])
    pairs = F.split(F.coalesce(shots, F.lit("")), ",")
    own = F.filter(pairs, lambda p: F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))) == F.lower(F.col("label")))
    number = F.try_to_number(F.trim(F.split_part(F.get(own, F.size(own) - 1), F.lit("="), F.lit(2))), F.lit("999999")).cast("int")
    met = asked.join(F.broadcast(by_name), "_name", "left")
    known = F.col("label").isNotNull()
    rows = met.select(key, "label", "task", F.when(known, F.coalesce(F.when(number >= 0, number), F.col("fewshot"))).alias("fewshot"), known.alias("known"))
    return rows.where("known").distinct().unionByName(rows.where("not known"))


def override_shots(specs: DataFrame, overrides: dict[str, int]) -> DataFrame:
    """specs with the given shots by label; a name that fits none is an error."""
    known = {label for label, *_ in BENCHMARKS}
    if bad := [k for k, v in overrides.items() if k not in known or v < 0]:
        raise ValueError(f"bad overrides: {bad}")
    if not overrides:
        return specs
    table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return specs.withColumn("fewshot", F.coalesce(F.try_element_at(table, F.col("label")), F.col("fewshot")))


def task_node(results: Column, groups: Column, task: Column) -> Column:
    """A task's map of values: among the results, else among the groups."""
    return F.coalesce(F.try_element_at(results, task), F.try_element_at(groups, task))


def metric(node: Column, preferred: Column) -> Column:
    """struct(key, value): the first preferred key with a number, else the first key with a fitting beginning."""
    number = lambda k: F.try_element_at(node, k).try_cast("double") if hasattr(Column, "try_cast") else F.expr("null")
    fits = lambda k: F.exists(F.array(*map(F.lit, METRIC_PREFIXES)), lambda p: F.startswith(k, p))
    order = F.concat(preferred, F.array_sort(F.filter(F.map_keys(node), fits)))
    found = F.filter(F.transform(order, lambda k: F.struct(k.alias("key"), number(k).alias("value"))), lambda s: s["value"].isNotNull())
    return F.get(found, F.lit(0))


def result_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("requested"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def strict_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Completed, completed without metric, and all else as failed."""
    done, bare = F.col("status") == "completed", F.col("status") == "completed_no_metric"
    return rows.groupBy(*keys).agg(F.count("*").alias("requested"), F.count_if(done).alias("completed"), F.count_if(bare).alias("completed_no_metric"), F.count_if(~done & ~bare).alias("failed"))


def overall_status(rows: DataFrame, keys: list[str], current: str) -> DataFrame:
    """failed if any failed; missing or completed if all are terminal; else the current status."""
    end = F.bool_and(F.col("status").isin(*TERMINAL))
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(end, F.when(F.bool_or(F.col("status") == "missing"), "missing").otherwise("completed")).otherwise(current)
    return rows.groupBy(*keys).agg(status.alias("overall"))


def best_result(rows: DataFrame, key: str, quality: list[str], value: str) -> DataFrame:
    """The value with the lexicographically greatest quality; the smallest value among equals."""
    return rows.groupBy(key).agg(F.max(F.struct(*quality, (-F.col(value)).alias("_v"))).alias("m")).select(key, *[F.col(f"m.{q}").alias(q) for q in quality], (-F.col("m._v")).alias(value))


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of both by key, the new field values first."""
    n = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = old.join(n, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def open_benchmarks(champions: DataFrame, results: DataFrame, names: DataFrame) -> DataFrame:
    """(champion, open benchmarks): configured ones without a terminal result. names is the configured list."""
    wanted = champions.select("champion").crossJoin(F.broadcast(names))
    done = results.where(F.col("status").isin(*TERMINAL)).select("champion", "name")
    left = wanted.join(done, ["champion", "name"], "left_anti")
    return left.groupBy("champion").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("o")).select("champion", F.transform("o", lambda x: x["name"]).alias("missing"))


def dispatch(queue: DataFrame, heavy: str, count: int, every: int) -> DataFrame:
    """What to run next: each ``every``-th dispatch the heavy one, else the head's others first."""
    if every and count % every == 0:
        item = queue.where(F.array_contains("missing", heavy)).orderBy("champion").limit(1)
        return item.select("champion", F.array(F.lit(heavy)).alias("benchmarks"), F.lit("periodic").alias("mode"))
    rest = F.when((F.size("missing") > 1) & F.array_contains("missing", heavy), F.array_remove("missing", heavy)).otherwise(F.col("missing"))
    return queue.orderBy("champion").limit(1).select("champion", rest.alias("benchmarks"), F.lit("standard").alias("mode"))
