"""Operator 5, quality rules: failures by host, shrunk by an empirical beta prior.

Counts of every document come from column expressions over its whole text; the
text is read once and only the counts are kept in a scratch table. Rule failures
are aggregated by host (the ``source`` column; null is a host of its own), each
host's failure rate is shrunk to the mean of all hosts by a beta prior fitted to
their rates by moments, and verdicts are joined back to the documents.

A repeated word is one inside an 8-word window that occurs twice or more in the
text: window hashes are made by doubling, sorted within the text, and runs of
neighbouring places are counted; texts without a repeated window skip the sort.

Defined results: null and empty texts have no words and fail the base rules; a
text of any length is counted whole; repeated rows count each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch
from .windows import paired, shifted

#: A host whose shrunk rate of failing documents is above this is rejected.
HOST_RATE = 0.5
MIN_WORDS = 20
WINDOW = 8


def with_repeated_words(df: DataFrame, hashes: str) -> DataFrame:
    """n_repeat_words from a column of hashes of 8-word windows.

    Every step is a column of its own: inside a lambda, an array that is not a
    column would be computed anew for each element.
    """
    h = F.col(hashes)
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    no = F.lit(False)
    as_next = F.zip_with("_placed", shifted(F.col("_placed"), 1), lambda a, b: F.coalesce(a["h"] == b["h"], no))
    twice = lambda p, i: F.when(F.get("_same", i) | F.coalesce(F.get("_same", i - 1), no), p["i"])
    places = F.sort_array(F.filter(F.transform("_placed", twice), lambda x: x.isNotNull()))
    window = F.lit(WINDOW)
    gaps = F.zip_with("_places", shifted(F.col("_places"), 1), lambda a, b: F.coalesce(F.least(b - a, window), window))
    return (
        df.withColumn("_placed", F.when(repeats, placed))
        .drop(hashes)
        .withColumn("_same", as_next)
        .withColumn("_places", places)
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g), F.lit(0)).cast("long"))
        .drop("_placed", "_same", "_places")
    )


def with_counts(documents: DataFrame) -> DataFrame:
    """doc_id, host and the counts of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CLASS}]")))
    base = documents.select(
        "doc_id",
        F.col("source").alias("host"),
        F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "").alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE_CLASS}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        with_word.alias("lines"),
    )
    # Each step is a column of its own, so that no array is computed twice.
    eights = (
        base.select(
            "doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size("lines").cast("long").alias("n_lines"),
            F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        )
        .withColumn("h", paired(F.col("h"), F.col("h"), 1))
        .withColumn("h", paired(F.col("h"), F.col("h"), 2))
        .withColumn("h", paired(F.col("h"), F.col("h"), 4))
    )
    few, many = F.col("n_words") < MIN_WORDS, F.col("n_repeat_words") * 100 > F.col("n_words") * 30
    return with_repeated_words(eights, "h").withColumn("base_failed", few | many)


def failed(counts: DataFrame) -> Column:
    """Whether a document counts as a failure of its host."""
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return (
        F.col("base_failed")
        | (F.col("n_symbols") * 10 > F.col("n_words") * 1)
        | (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)
        | (mean < 2)
        | (mean > 15)
    )


def host_rates(counts: DataFrame) -> DataFrame:
    """host, n, failures and the rate shrunk by a beta prior fitted to all hosts by moments."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed(counts).cast("long")).alias("failures"))
    rates = hosts.withColumn("rate", F.col("failures") / F.col("n"))
    prior = rates.agg(F.avg("rate").alias("m"), F.coalesce(F.var_pop("rate"), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("k"))
    # Spread between hosts, less what binomial noise alone gives; strength within [1, 1000].
    spread = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("k"), F.lit(1e-9))
    strength = F.least(F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(1.0)), F.lit(1000.0))
    prior = prior.select(F.col("m").alias("prior_mean"), strength.alias("prior_strength"))
    shrunk = (F.col("failures") + F.col("prior_mean") * F.col("prior_strength")) / (F.col("n") + F.col("prior_strength"))
    # The prior is one row.
    return hosts.crossJoin(F.broadcast(prior)).withColumn("shrunk_rate", shrunk)


def judge_quality(documents: DataFrame) -> DataFrame:
    """Counts of each document, whether the base rules fail it, its host's rate, and kept."""
    scratch = Scratch(documents.sparkSession, "quality")
    counts = scratch.save(with_counts(documents))
    rates = host_rates(counts).select(F.col("host").alias("_host"), "shrunk_rate")
    return (
        counts.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & (F.col("shrunk_rate") <= HOST_RATE))
        .drop("_host", "n_lines")
    )
