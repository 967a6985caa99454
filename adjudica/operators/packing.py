"""Token streams cut into fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sampling import rotate, with_pieces

# Fixed value: files that one sample may take.
MAX_FILES = 8


def words(text: Column) -> Column:
    return F.split(text, r"\s+")


def token_offsets(rows: DataFrame, scope: list[str], order: list[str], tokens: str = "tokens") -> DataFrame:
    """rows with n (tokens and one end mark), start and end in their scope's stream.

    The running sum is per stream. A stream is cut into pieces, by ranges of its first
    order column that hold about equally many rows: pieces are summed first and only their
    sums are put in one order, so that a stream of any length, and of any spread of its
    order, is dealt over many tasks. Token arrays move once, to their piece.
    """
    cut = with_pieces(rows.withColumn("n", (F.size(tokens) + 1).cast("long")), order[0])
    cut = cut.withColumn("_scope", F.to_json(F.struct(*scope)))  # never null, so that the join keeps the window's partitions
    sums = cut.groupBy("_scope", "_piece").agg(F.sum("n").alias("_sum"))
    along = W.partitionBy("_scope").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_scope", "_piece", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    within = W.partitionBy("_scope", "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = cut.withColumn("_in", F.sum("n").over(within)).join(before, ["_scope", "_piece"])
    placed = placed.withColumn("end", F.col("_before") + F.col("_in")).withColumn("start", F.col("end") - F.col("n"))
    return placed.select(*rows.columns, "n", "end", "start")


def pack(rows: DataFrame, scope: list[str], order: list[str], length: int, eos: str = "</s>", keep_tail: bool = True) -> DataFrame:
    """(scope, window, n_tokens, tokens): every document's tokens and an end mark, cut every ``length`` tokens."""
    placed = token_offsets(rows, scope, order)
    every = placed.select(*scope, "start", F.posexplode(F.concat("tokens", F.array(F.lit(eos)))).alias("k", "token"))
    at = every.select(*scope, (F.col("start") + F.col("k")).alias("offset"), "token").withColumn("window", F.floor(F.col("offset") / length))
    # A window holds at most ``length`` tokens, so the list is bounded.
    grouped = at.groupBy(*scope, "window").agg(F.count("*").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "token"))).alias("t"))
    out = grouped.select(*scope, "window", "n_tokens", F.transform("t", lambda x: x["token"]).alias("tokens"))
    return out if keep_tail else out.where(F.col("n_tokens") == length)


def window_counts(rows: DataFrame, scope: list[str], length: int, keep_tail: bool = True) -> DataFrame:
    """(scope, n_tokens, n_windows) without building windows."""
    total = rows.groupBy(*scope).agg(F.sum(F.size("tokens") + 1).cast("long").alias("n_tokens"))
    count = F.ceil(F.col("n_tokens") / length) if keep_tail else F.floor(F.col("n_tokens") / length)
    return total.withColumn("n_windows", count.cast("long"))


def merge_records(records: DataFrame, scope: list[str], order: str, k: int, value: str) -> DataFrame:
    """Each record with the k - 1 behind it; frames cut short at the end are dropped."""
    w = W.partitionBy(*scope).orderBy(order).rowsBetween(W.currentRow, k - 1)
    return records.withColumn("frame", F.collect_list(value).over(w)).where(F.size("frame") == k)


def vocabulary_bound(rows: DataFrame, tokens: str, vocabulary: int) -> DataFrame:
    return rows.where((F.size(tokens) > 0) & (F.array_max(tokens) < vocabulary))


def violations(rows: DataFrame, tokens: str, length: int, vocabulary: int) -> DataFrame:
    """Counts of sequences that are empty, of another length, or beyond the vocabulary."""
    return rows.agg(
        F.count_if(F.size(tokens) == 0).alias("n_empty"),
        F.count_if(F.size(tokens) != length).alias("n_wrong_length"),
        F.count_if(F.array_max(tokens) >= vocabulary).alias("n_beyond"),
    )


#: Index values that one task looks at together.
STRETCH = 1_000_000


def merge_ranges(indices: DataFrame, column: str, gap: int) -> DataFrame:
    """Runs of indices no more than ``gap`` apart: (first, last, n).

    Runs are found within stretches of STRETCH values; only the first and the last
    run of a stretch can go on in its neighbours, and only those are put in one order.
    """
    placed = indices.select(F.col(column).alias("_i"), F.floor(F.col(column) / STRETCH).alias("_stretch"))
    w = W.partitionBy("_stretch").orderBy("_i")
    new = F.when(F.col("_i") - F.lag("_i").over(w) <= gap, 0).otherwise(1)
    placed = placed.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = placed.groupBy("_stretch", "_run").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count("*").alias("n"))
    ends = runs.groupBy("_stretch").agg(F.max("_run").alias("_last"))
    runs = runs.join(ends, "_stretch")
    outer = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    along = W.orderBy("first")
    edge = runs.where(outer).withColumn("_new", F.when(F.col("first") - F.lag("last").over(along) <= gap, 0).otherwise(1))
    edge = edge.withColumn("_run", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = edge.groupBy("_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_run")
    return joined.unionByName(runs.where(~outer).select("first", "last", "n"))


def batch_of(index: Column, size: int) -> Column:
    return F.floor(index / size)


def effective_length(length: int, multiplier: int, record: int | None = None) -> int:
    """Sequence length after the multiplier; an error if records do not fill it."""
    total = length * multiplier
    if record and total % record:
        raise ValueError(f"length {total} is no multiple of record length {record}")
    return total


def pack_until(files: DataFrame, read, tokenise, n: int, length: int, start: int, max_files: int = MAX_FILES, save=None) -> tuple[DataFrame, DataFrame]:
    """The first n windows of the files (idx, key) from ``start`` on, round to the front; and the files that they took.

    read(files) gives their documents (idx, ord, text), tokenise those with ``tokens``,
    save keeps a table out of memory. Files are tokenised in groups of one, one, two, four
    and so on, and no further group once there are n windows, so at most twice the files
    that are needed are looked at and never more than ``max_files``. The stream goes on
    over the ends of files; (seq_idx, tokens) are its windows, and the second table
    (turn, key, docs_seen) says up to which document each file was used.
    """
    spark = files.sparkSession
    turns = rotate(files, start, max_files)
    listed = sorted((r["turn"], r["idx"], r["key"]) for r in turns.collect())  # max_files rows
    found, have, at, size = None, 0, 0, 1
    while at < len(listed) and have < n * length:
        group = spark.createDataFrame(listed[at : at + size], "turn long, idx long, key string")
        rows = tokenise(read(group).select("turn", "ord", "text"))
        rows = save(rows) if save is not None else rows
        have += rows.agg(F.coalesce(F.sum(F.size("tokens") + 1), F.lit(0)).alias("n")).first()["n"]
        found = rows if found is None else found.unionByName(rows)
        at, size = at + size, max(1, at + size)
    if found is None or have < length:
        raise ValueError(f"{at} files give no window of {length} tokens")
    made = min(n, have // length)
    placed = token_offsets(found.withColumn("_all", F.lit(0)), ["_all"], ["turn", "ord"]).where(F.col("start") < made * length)
    windows = cut(placed, length).where(F.col("seq_idx") < made)  # the last document may go on beyond them
    used = placed.groupBy("turn").agg(F.count("*").alias("docs_seen"))
    names = spark.createDataFrame([(t, k) for t, _, k in listed], "turn long, key string")
    return windows, used.join(F.broadcast(names), "turn").select("turn", "key", "docs_seen")


def cut(placed: DataFrame, length: int, eos: int = 0) -> DataFrame:
    """(seq_idx, tokens) from rows (tokens, start, n) of one stream, an end mark after each: whole windows and the last one."""
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length)
    each = placed.select("start", "n", F.concat("tokens", F.array(F.lit(eos).cast("long"))).alias("tokens"), F.explode(F.sequence(first, last)).alias("seq_idx"))
    low = F.greatest(F.col("seq_idx") * length - F.col("start"), F.lit(0))
    high = F.least((F.col("seq_idx") + 1) * length - F.col("start"), F.col("n"))
    pieces = each.select("seq_idx", (F.col("start") + low).alias("_at"), F.slice("tokens", (low + 1).cast("int"), (high - low).cast("int")).alias("_t"))
    # At most ``length`` pieces, of ``length`` tokens together.
    joined = pieces.groupBy("seq_idx").agg(F.sort_array(F.collect_list(F.struct("_at", "_t"))).alias("_p"))
    return joined.select("seq_idx", F.flatten(F.transform("_p", lambda p: p["_t"])).alias("tokens"))
