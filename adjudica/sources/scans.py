"""Text, token-list, manifest and listing scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# Columns that may hold the text, in order of preference.
TEXT_COLUMNS = ["content", "text", "markdown", "prompt", "question", "answer", "solution"]
# Fields that may hold a shard's location, in order of preference.
LOCATION_FIELDS = ["url", "href", "uri", "key", "path", "name"]


def text_column(df: DataFrame, wanted: str, preference: list[str] | None = None, strict: bool = False) -> str:
    """The column to read: the wanted one, else the first preferred, else the first string column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for name in [wanted, *([] if strict else preference or [])]:
        if name in strings:
            return name
    if strict or not strings:
        raise ValueError(f"no text column {wanted!r} in {df.columns}")
    return strings[0]


def texts(df: DataFrame, wanted: str = "text", preference: list[str] | None = None, strict: bool = False, minimum: int = 1) -> DataFrame:
    """One column ``text``: not null, at least ``minimum`` characters."""
    c = F.col(text_column(df, wanted, preference, strict))
    return df.select(c.alias("text")).where(c.isNotNull() & (F.length(c) >= max(1, minimum)))


def either_text(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that is there and not null, else empty."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(""))


def token_lists(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), F.col(column).alias("tokens")).where(F.col(column).isNotNull() & (F.size(column) > 0))


def manifest_schema() -> T.StructType:
    entry = T.StructType([T.StructField(n, T.StringType()) for n in LOCATION_FIELDS] + [T.StructField("seq_len", T.IntegerType())])
    return T.StructType([T.StructField("shard_prefix", T.StringType()), T.StructField("seq_len", T.IntegerType()), T.StructField("shards", T.ArrayType(entry))])


def manifest_refs(manifests: DataFrame, limit: int | None = None) -> DataFrame:
    """(source, ref, seq_len) of every .npy shard of parsed manifests (source, manifest), in order."""
    rows = manifests.select("source", "manifest.shard_prefix", F.col("manifest.seq_len").alias("all_len"), F.posexplode("manifest.shards").alias("n", "s"))
    at = F.coalesce(*[F.col(f"s.{f}") for f in LOCATION_FIELDS])
    refs = rows.select("source", "n", text.manifest_ref(at, F.col("shard_prefix")).alias("ref"), F.coalesce("s.seq_len", "all_len").alias("seq_len"))
    refs = refs.where(F.endswith("ref", F.lit(".npy")))
    return refs.where(F.col("n") < limit) if limit else refs


def links(lines: DataFrame) -> DataFrame:
    """First word of every line that is neither blank nor a comment."""
    line = F.trim("value")
    return lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select(F.get(F.split(line, r"\s+"), F.lit(0)).alias("ref"))


def bundle_sources(bundles: DataFrame) -> DataFrame:
    """(name, url, weight, alias) of a bundle's enabled sources."""
    s = bundles.select(F.explode("sources").alias("s")).where(F.coalesce("s.enabled", F.lit(True)))
    return s.select("s.name", F.col("s.manifest_url").alias("url"), F.coalesce("s.weight", F.lit(1.0)).alias("weight"), text.manifest_source(F.col("s.manifest_url")).alias("alias"))


def bundle_or_default(bundles: DataFrame, default: DataFrame) -> DataFrame:
    """The bundle's sources, or the default ones where it has none."""
    found = bundle_sources(bundles)
    return default if found.isEmpty() else found


def file_list(explicit: list[str] | None, manifest: DataFrame | None, listing: DataFrame, limit: int = 10_000) -> DataFrame:
    """Keys to read: the explicit ones, else the manifest's, else the listing's first ``limit``; sorted."""
    spark = listing.sparkSession
    if explicit:
        return spark.createDataFrame([(k,) for k in explicit], "key string").orderBy("key")
    if manifest is not None:
        return manifest.select(F.coalesce("dest_key", "key").alias("key")).where("key is not null").orderBy("key")
    return listing.select("key").orderBy("key").limit(limit)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime and length of files below a folder of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length")


def shard_keys(listing: DataFrame, contains: str = "", suffix: str = ".npy", exclude: list[str] | None = None) -> DataFrame:
    kept = listing.where(F.contains("key", F.lit(contains)) & F.endswith("key", F.lit(suffix)))
    return kept.where(~F.col("key").isin(*exclude)).select("key").distinct() if exclude else kept.select("key").distinct()


def listing_counters(listing: DataFrame, contains: str, suffix: str, exclude: list[str]) -> DataFrame:
    """Six counters of one listing: seen, other place, other suffix, excluded, kept, distinct."""
    here, fits, out = F.contains("key", F.lit(contains)), F.endswith("key", F.lit(suffix)), F.col("key").isin(*exclude)
    kept = here & fits & ~out
    return listing.agg(
        F.count("*").alias("seen"), F.count_if(~here).alias("elsewhere"), F.count_if(here & ~fits).alias("other_suffix"),
        F.count_if(here & fits & out).alias("excluded"), F.count_if(kept).alias("kept"), F.countDistinct(F.when(kept, F.col("key"))).alias("n_distinct"),
    )


def discover(files: DataFrame, prefixes: list[str], priority: list[str]) -> DataFrame:
    """Parquet files under allowed prefixes, by configuration: those of the priority list first, then by name."""
    allowed = F.lit(not prefixes)
    for p in prefixes:
        allowed = allowed | F.startswith("path", F.lit(p))
    rank = F.array_position(F.array(*map(F.lit, priority)) if priority else F.array().cast("array<string>"), F.col("config"))
    found = files.where(F.endswith("path", F.lit(".parquet")) & allowed).withColumn("config", text.config_name(F.col("path")))
    return found.withColumn("rank", F.when(rank > 0, rank).otherwise(10**6)).orderBy("rank", "config", "path")


def latest_by(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    from pyspark.sql import Window as W

    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def decode_commitment(payload: Column) -> Column:
    """Text of a commitment: hex with a length prefix of 1, 2 or 4 bytes, or the text itself."""
    raw = F.when(F.startswith(payload, F.lit("0x")), F.unhex(F.substring(payload, F.lit(3), F.length(payload)))).otherwise(F.encode(payload, "ISO-8859-1"))
    mode = F.conv(F.hex(F.substring(raw, F.lit(1), F.lit(1))), 16, 10).cast("int") % 4
    skip = F.when(mode == 0, 1).when(mode == 1, 2).when(mode == 2, 4).otherwise(0)
    bare = F.rlike(F.decode(raw, "ISO-8859-1"), F.lit("^v[0-9]"))
    body = F.when(bare, raw).otherwise(F.substring(raw, skip + 1, F.length(raw)))
    return F.decode(body, "UTF-8")


def objects(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(key, size, modified) of a folder's files at any depth: a listing that tasks share, of which no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        files = files.option("pathGlobFilter", f"*{suffix}")
    base = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/+", "/")
    there = F.regexp_replace("path", "^file:/+", "/")
    key = F.when(F.startswith(there, base), F.substring(there, F.length(base) + 2, F.length(there))).otherwise(there)
    return files.load(folder).select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
