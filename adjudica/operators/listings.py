"""File listings, registry answers, champions from records, reports and state documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.versions import Versions

#: A repository's answer: files with a digest each, and candidate dates.
LISTING = "repo string, lastModified string, createdAt string, siblings array<struct<rfilename: string, blobId: string, lfs: struct<sha256: string>>>"


def with_snapshot(files: DataFrame, path: str = "path") -> DataFrame:
    """files with repo, revision and name from ``.../models--owner--name/snapshots/revision/name``; others are dropped.

    Only the first double dash parts owner and name.
    """
    found = lambda i: F.regexp_extract(path, r"/models--([^/]+)/snapshots/([^/]+)/(.+)$", i)
    rows = files.select("*", found(1).alias("_flat"), found(2).alias("revision"), found(3).alias("name")).where("_flat <> ''")
    return rows.withColumn("repo", F.regexp_replace("_flat", "^(.*?)--", "$1/")).drop("_flat")


def snapshot_sizes(files: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(repo, revision, bytes, n_files, complete) of (path, length); of ``listed`` names alone if given.

    Complete: a configuration, and one weight file or an index with every shard that its names count.
    """
    rows = with_snapshot(files)
    if listed is not None:
        rows = rows.join(listed.select("name").distinct(), "name", "left_semi")
    shard = F.regexp_extract("name", r"^model-(\d+)-of-(\d+)\.safetensors$", 1)
    of = F.regexp_extract("name", r"^model-(\d+)-of-(\d+)\.safetensors$", 2)
    per = rows.groupBy("repo", "revision").agg(
        F.sum("length").alias("bytes"), F.count("*").alias("n_files"), F.bool_or(F.col("name") == "config.json").alias("_config"),
        F.bool_or(F.col("name") == "model.safetensors").alias("_single"), F.bool_or(F.col("name") == "model.safetensors.index.json").alias("_index"),
        F.count_distinct(F.when(shard != "", shard)).alias("_shards"), F.max(F.when(of != "", of.cast("int"))).alias("_of"),
    )
    whole = F.col("_single") | (F.col("_index") & F.coalesce(F.col("_shards") == F.col("_of"), F.lit(False)))
    return per.select("repo", "revision", "bytes", "n_files", (F.col("_config") & whole).alias("complete"))


def registry_answers(raw: DataFrame, column: str = "body") -> DataFrame:
    """Parsed answers: repo, layers (name to digest of weight files at the root), newest date and whether to trust it.

    The large-file digest counts, else the blob's; an answer that doesn't parse gives nulls.
    """
    a = raw.select(F.from_json(column, LISTING).alias("a")).select("a.*")
    weights = F.filter("siblings", lambda s: F.endswith(s["rfilename"], F.lit(".safetensors")) & ~F.contains(s["rfilename"], F.lit("/")))
    entry = lambda s: F.struct(s["rfilename"].alias("name"), F.coalesce(F.regexp_replace(F.lower(s["lfs"]["sha256"]), "^sha256:", ""), s["blobId"]).alias("digest"))
    layers = F.array_sort(F.transform(weights, entry))
    date = F.coalesce(F.try_to_timestamp("lastModified"), F.try_to_timestamp("createdAt"))  # the first that can be read
    source = F.when(F.try_to_timestamp("lastModified").isNotNull(), "untrusted:lastModified").when(date.isNotNull(), "registry:createdAt")
    joined = F.array_join(F.transform(layers, lambda x: F.concat(x["name"], F.lit(":"), x["digest"])), ";")
    return a.select("repo", joined.alias("layers"), F.sha2(joined, 256).alias("digest"), date.alias("dated"), (~F.startswith(source, F.lit("untrusted:"))).alias("trusted"))


def normalised_champions(rows: DataFrame, source: str) -> DataFrame:
    """(repo, digest, hotkey, reign, source) whatever the fields are called; rows without a repository go."""
    def any_of(*names: str) -> Column:
        there = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    out = rows.select(
        any_of("model_repo", "challenger_repo", "repo", "hf_repo").alias("repo"), any_of("king_digest", "challenger_digest", "digest").alias("digest"),
        any_of("hotkey", "challenger_hotkey").alias("hotkey"), any_of("reign_number", "reign").cast("long").alias("reign"), F.lit(source).alias("source"),
    )
    return out.where("repo is not null")


def champion_candidates(current: DataFrame, chain: DataFrame, accepted: DataFrame) -> DataFrame:
    """Current champion, then the chain, then accepted history; the first of each repo@digest counts. Latest reign first in each."""
    parts = [normalised_champions(d, s).withColumn("rank", F.lit(i)) for i, (d, s) in enumerate(((current, "current"), (chain, "chain"), (accepted, "accepted")))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = every.groupBy("repo", "digest").agg(F.min(F.struct("rank", F.expr("-coalesce(reign, 0)").alias("late"), "source", "hotkey")).alias("f"))
    return first.select("repo", "digest", "f.source", "f.hotkey", "f.rank", (-F.col("f.late")).alias("reign"))


def last_records(records: DataFrame, file: str = "file") -> DataFrame:
    """Accepted records (file, repo, digest, accepted): the last by file name for each repo@digest."""
    w = W.partitionBy("repo", "digest").orderBy(F.desc(file))
    return records.where("accepted").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def newest_usable(records: DataFrame, file: str = "file") -> DataFrame:
    """The newest record by file name that names an artifact; no row if none does."""
    usable = records.where("coalesce(trim(artifact), '') <> ''")
    return usable.orderBy(F.desc(file)).limit(1)


def without_failed(history: DataFrame, champion: str) -> DataFrame:
    """History without one champion's failed rows."""
    return history.where(~((F.col("king_id") == champion) & F.col("failed")))


def markdown(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line_no, line) of a table with its head; a report has few rows."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))
    body = rows.select((F.row_number().over(W.orderBy(*order)) + 1).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))]
    return rows.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)


def result_document(rows: DataFrame, model: str, label: str, score: str, status: str) -> DataFrame:
    """(model, document): one JSON document for each model, its benchmarks by label."""
    entry = F.struct(F.col(label).alias("benchmark"), F.col(status).alias("status"), F.col(score).alias("score"))
    grouped = rows.groupBy(model).agg(F.array_sort(F.collect_list(entry)).alias("results"))
    done = F.size(F.filter("results", lambda r: r["status"] == "completed"))
    document = F.struct(F.col(model).cast("string").alias("model"), F.size("results").alias("requested"), done.alias("completed"), F.col("results"))
    return grouped.select(model, F.to_json(document).alias("document"))


#: The documents of a validator's state.
STATE = ["queue", "history", "king", "chain", "seen_hotkeys", "completed_digests", "stats"]


def flush_state(documents: dict[str, DataFrame], folder: str) -> None:
    """These documents as JSON tables below ``folder``, replaced together; a reader sees all old ones or all new ones."""
    if unknown := set(documents) - set(STATE):
        raise ValueError(f"no such documents: {sorted(unknown)}")
    if documents:
        spark = next(iter(documents.values())).sparkSession
        Versions(spark, folder, "json").flush(documents)


def load_state(spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Documents of one version; one that was never written is empty."""
    state = Versions(spark, folder, "json")
    at = state.current()
    return {name: found if (found := state.read(name, schema, at)) is not None else spark.createDataFrame([], schema) for name, schema in schemas.items()}


def reset_champion(spark: SparkSession, folder: str, schema: T.StructType, dry_run: bool = True) -> DataFrame:
    """Backup of the champion's document and an empty one in its place, both at once; a dry run only shows what would go.

    A backup that is already there is an error.
    """
    state = Versions(spark, folder, "json")
    king = load_state(spark, folder, {"king": schema})["king"]
    if dry_run:
        return king
    if "king-backup" in state.current().tables:
        raise FileExistsError(f"{folder} has a backup of the champion")
    state.flush({"king-backup": king, "king": king.where("false")})
    return state.read("king-backup", schema)
