"""Operator 9, benchmark decontamination: a broadcast hash set of test n-grams.

Test items are lower-cased (A-Z), split into words and cut into windows of
``WINDOW`` words (a shorter item is one window). Documents' windows are hashed
in the JVM by doubling and looked up in the broadcast set; the words of every
hit are then compared, so a hash collision adds nothing. Windows longer and
shorter than the item length in hand never meet, as sets are kept by length.

The set is broadcast while it has at most ``MAX_BROADCAST_WINDOWS`` rows (24
bytes each); beyond that, the same join shuffles by hash.

Defined results: a null or empty text has no words and no hit, and an item
without words has no window; items with equal windows are all reported; a null
item_id counts as the text ``null``; repeated rows get equal results; texts are
read whole; extra columns stay in the filters and are ignored in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, ascii_lower
from .windows import paired, steps

WINDOW = 10
MAX_BROADCAST_WINDOWS = 1_000_000
# Characters that are not part of a word, after lower-casing A-Z.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text. Splitting takes a tenth of the time of extracting every match."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), APART), ""), F.array().cast("array<string>"))


def window_hashes(df: DataFrame, words: str, length: int, out: str) -> DataFrame:
    """Hash of every window of ``length`` words, as an array column."""
    df = df.withColumn("_h1", F.transform(F.col(words), lambda w: F.xxhash64(w)))
    for made, left, offset in steps(length):
        df = df.withColumn(f"_h{made}", paired(F.col(f"_h{left}"), F.col(f"_h{made - left}"), offset))
    df = df.withColumn(out, F.col(f"_h{length}"))
    return df.drop("_h1", *[f"_h{m}" for m, _, _ in steps(length)])


def key_columns() -> list[Column]:
    """What tells rows apart: the id and the text itself, by hash."""
    return [F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(length, hash, window words, item) of all items; one row each."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    cut = items.withColumn("length", length).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)))
    return cut.select("length", F.slice("words", F.col("at"), F.col("length")).alias("window"), "item").distinct()


def find_hits(documents: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified hits: (doc_id, text_hash, place, length, item)."""
    windows = scratch.save(benchmark_windows(benchmark))
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]  # ten at most
    small = windows.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    found = None
    for n in lengths:
        # Written first: a join on an unwritten hash would inline all its steps into a null test.
        own = window_hashes(windows.where(F.col("length") == n), "window", n, "hs")
        keys = scratch.save(own.select(F.get("hs", 0).alias("hash")).distinct())
        docs = documents.select(*key_columns(), words_of(F.col("text")).alias("words")).where(F.size("words") >= n)
        # The outer form, since the plain one infers a filter that would inline all steps again.
        scan = window_hashes(docs, "words", n, "hs").select("doc_id", "text_hash", F.posexplode_outer("hs").alias("place", "hash"))
        candidates = scan.join(hint(keys), "hash", "left_semi")
        found = (
            candidates.select("doc_id", "text_hash", "place", "hash", F.lit(n).alias("length"))
            if found is None
            else found.unionByName(candidates.select("doc_id", "text_hash", "place", "hash", F.lit(n).alias("length")))
        )
    if found is None:
        return documents.select(*key_columns(), F.lit(0).alias("place"), F.lit(0).alias("length"), F.lit("").alias("item")).where("false")
    found = scratch.save(found.distinct())
    # Hit places by document; then the words there against the windows' own.
    by_doc = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "length", "hash")).alias("places"))
    hit_docs = documents.select(*key_columns(), "text").join(
        # One plan at every size: a broadcast here would turn into a shuffle of the texts as hits grow.
        by_doc.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "places").hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")),
    )
    at = hit_docs.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"), "places").select(
        "doc_id",
        "text_hash",
        F.explode(
            F.transform("places", lambda p: F.struct(p["place"].alias("place"), p["length"].alias("length"), F.slice("words", p["place"] + 1, p["length"]).alias("window")))
        ).alias("p"),
    )
    at = at.select("doc_id", "text_hash", "p.place", "p.length", F.col("p.window").alias("window")).distinct()
    return at.join(hint(windows.select("window", "item")), "window").drop("window")


def summarise(hits: DataFrame) -> DataFrame:
    """By document: words hit, number of items and their digest."""
    places = hits.select("doc_id", "text_hash", "place", "length").distinct()
    w = W.partitionBy("doc_id", "text_hash").orderBy("place", "length")
    reach = F.max(F.col("place") + F.col("length")).over(w.rowsBetween(W.unboundedPreceding, -1))
    # Words that this window adds to what earlier windows have covered.
    new = F.greatest(F.col("place") + F.col("length") - F.greatest(F.col("place"), F.coalesce(reach, F.lit(0))), F.lit(0))
    covered = places.withColumn("new", new).groupBy("doc_id", "text_hash").agg(F.sum("new").cast("long").alias("n_hit"))
    items = hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return covered.join(
        items.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "items"),
        F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")),
    ).select("doc_id", "text_hash", "n_hit", "items")


def report_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, the items whose windows occur in it, contaminated."""
    scratch = Scratch(documents.sparkSession, "decontaminate")
    by_doc = summarise(find_hits(documents, benchmark, scratch))
    by_doc = by_doc.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "n_hit", "items")
    n_words = F.size(words_of(F.col("text"))).cast("long")
    docs = documents.select(*key_columns(), n_words.alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark window; columns as they came."""
    scratch = Scratch(documents.sparkSession, "decontaminate")
    hits = scratch.save(find_hits(documents, benchmark, scratch).select("doc_id", "text_hash").distinct())
    hits = hits.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    return documents.join(hits, same, "left_anti")


def mask_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents with each run of hit words cut out of ``text`` (words kept, joined by one space, in hit texts only)."""
    scratch = Scratch(documents.sparkSession, "decontaminate")
    hits = find_hits(documents, benchmark, scratch).select("doc_id", "text_hash", "place", "length").distinct()
    spans = hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "length")).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "__spans")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    hit = F.flatten(F.transform("__spans", lambda s: F.sequence(s["place"], s["place"] + s["length"] - 1)))
    joined = documents.join(spans, same, "left").withColumn("__hit", F.array_distinct(hit))
    joined = joined.withColumn("__words", F.when(F.col("__hit").isNotNull(), words_of(F.col("text"))))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__words") - 1), F.col("__hit"))
    cut = F.array_join(F.transform(rest, lambda i: F.get("__words", i)), " ")
    return joined.withColumn("text", F.when(F.col("__hit").isNull(), F.col("text")).otherwise(cut)).select(*documents.columns)
