"""The fingerprint bank as a stored table: unique models, insertion order, families, the newest entries only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Versions
from . import fingerprint, sampling

# The table's columns, in their order.
COLUMNS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("created_at", T.DoubleType()), T.StructField("model_ref", T.StringType()),
    T.StructField("model_digest", T.StringType()), T.StructField("submission_id", T.StringType()), T.StructField("submission_order", T.StringType()),
    T.StructField("hotkey", T.StringType()), T.StructField("version", T.StringType()), T.StructField("key_id", T.StringType()),
    T.StructField("compatibility_key", T.StringType()), T.StructField("similarity_group", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("vocab_size", T.LongType()), T.StructField("logits_sha256", T.StringType()), T.StructField("logits", T.BinaryType()),
])
UNIQUE = ["version", "key_id", "model_digest"]
TABLE = "fingerprints"


def migrated(rows: DataFrame) -> DataFrame:
    """Rows of this or an older table with all columns; a model without a family is its own."""
    have = {f.name for f in rows.schema.fields}
    column = lambda f: F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    out = rows.select(*[column(f).alias(f.name) for f in COLUMNS.fields])
    return out.withColumn("similarity_group", F.coalesce(F.nullif("similarity_group", F.lit("")), "model_digest")).select(*COLUMNS.names)


def insert(bank: DataFrame, arrivals: DataFrame, order: str, max_entries: int = fingerprint.MAX_ENTRIES) -> DataFrame:
    """The bank with arrivals that have a digest and are new by ``UNIQUE``, numbered on in their order; the newest ``max_entries`` rows.

    What is there stays, of arrivals alike the first counts; ``order`` is a number and unique.
    """
    old = migrated(bank)
    named = arrivals.where("coalesce(model_digest, '') <> ''")
    first = named.groupBy(*UNIQUE).agg(F.min(order).alias("_first"))
    met = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in UNIQUE]
    seen = old.select(*[F.col(c).alias(f"_{c}") for c in UNIQUE]).distinct()
    new = named.join(first.select("_first").withColumnRenamed("_first", order), order).join(F.broadcast(seen), met[0] & met[1] & met[2], "left_anti")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = sampling.placed(new, order, "_place").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_place") + 1)
    return old.unionByName(migrated(numbered)).orderBy(F.desc("id")).limit(max_entries)


def distances(peers: DataFrame, logits: np.ndarray) -> DataFrame:
    """(id, js_p95) of stored fingerprints against one of the same shape; a payload that doesn't fit its digest is an error."""
    shipped = peers.sparkSession.sparkContext.broadcast(fingerprint.encode(logits)[0])
    rows, vocabulary = logits.shape

    def run(batches):
        mine = np.frombuffer(shipped.value, "<f2").reshape(rows, vocabulary).astype(np.float32)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                stored = fingerprint.decode(bytes(r.logits), r.rows, r.vocab_size, r.logits_sha256)
                out.append((r.id, float(np.quantile(fingerprint.js_rows(stored, mine), 0.95))))
            yield pd.DataFrame(out, columns=["id", "js_p95"]).astype({"id": "int64", "js_p95": "float64"})

    return peers.select("id", "rows", "vocab_size", "logits_sha256", "logits").mapInPandas(run, "id long, js_p95 double")


class BankStore:
    """The bank in a folder. Payloads stay in the table and in tasks; the driver decides by one small row for each entry."""

    def __init__(self, spark: SparkSession, folder: str, max_entries: int = fingerprint.MAX_ENTRIES, max_similar: int = fingerprint.MAX_SIMILAR):
        self.spark, self.store = spark, Versions(spark, folder)
        self.max_entries, self.max_similar = max_entries, max_similar

    def rows(self) -> DataFrame:
        found = self.store.read(TABLE)
        return self.spark.createDataFrame([], COLUMNS) if found is None else migrated(found)

    def save(self, rows: DataFrame) -> None:
        """Replace the table, for one that comes from elsewhere; it may be of an older form."""
        self.store.flush({TABLE: rows})

    def compare_and_store(self, logits: np.ndarray, entry: dict, limit: float = fingerprint.JS_LIMIT) -> dict:
        """Hold a candidate against entries of its version, key and shape, and store it unless its family is full.

        entry: the other columns of its row. Families that the candidate links become one,
        even if it is turned away.
        """
        if not entry.get("model_digest"):
            raise ValueError("a bank entry needs its model's digest")
        bank = self.rows()
        same_key = bank.where(F.col("version").eqNullSafe(F.lit(entry["version"])) & F.col("key_id").eqNullSafe(F.lit(entry["key_id"])))
        known = same_key.select("id", "model_ref", "model_digest", "submission_id", "similarity_group", "rows", "vocab_size").collect()  # max_entries rows
        own = next((r for r in known if r["model_digest"] == entry["model_digest"]), None)
        size = bank.select("id").count()
        if own is not None and own["submission_id"] == entry["submission_id"]:
            family = sum(r["similarity_group"] == own["similarity_group"] for r in known)
            return {"detected": False, "stored": True, "already_stored": True, "too_similar": family > 1, "similar_family_size": family, "compared": 0, "bank_size": size, "match": None}
        rows, vocabulary = logits.shape
        peers = same_key.where((F.col("rows") == rows) & (F.col("vocab_size") == vocabulary))
        js = {r["id"]: r["js_p95"] for r in distances(peers, logits).collect()}
        by_id = {r["id"]: r for r in known}
        closest = min(js, key=lambda i: (js[i], -i), default=None)  # the newest of equals
        groups = {by_id[i]["similarity_group"] for i in js if js[i] <= limit}
        family = sum(r["similarity_group"] in groups for r in known)
        group = by_id[closest]["similarity_group"] if groups else entry["model_digest"]
        detected = bool(groups) and family >= self.max_similar
        merged = bank
        if len(groups) > 1:
            mine = F.col("version").eqNullSafe(F.lit(entry["version"])) & F.col("key_id").eqNullSafe(F.lit(entry["key_id"]))
            merged = bank.withColumn("similarity_group", F.when(mine & F.col("similarity_group").isin(sorted(groups)), F.lit(group)).otherwise(F.col("similarity_group")))
        if not detected:
            payload, digest = fingerprint.encode(logits)
            row = {n: entry.get(n) for n in COLUMNS.names} | {"similarity_group": group, "rows": rows, "vocab_size": vocabulary, "logits_sha256": digest, "logits": bytearray(payload)}
            arrival = self.spark.createDataFrame([tuple(row[n] for n in COLUMNS.names)], COLUMNS).withColumn("_ord", F.lit(0))
            merged = insert(merged, arrival, "_ord", self.max_entries)
        if not detected or len(groups) > 1:
            self.store.flush({TABLE: merged})
            known = self.rows().where(F.col("version").eqNullSafe(F.lit(entry["version"])) & F.col("key_id").eqNullSafe(F.lit(entry["key_id"]))).select("similarity_group").collect()
            size = self.rows().select("id").count()
        if not detected:
            family = sum(r["similarity_group"] == group for r in known)
        match = None if closest is None else {"model_ref": by_id[closest]["model_ref"], "model_digest": by_id[closest]["model_digest"], "js_p95": js[closest]}
        return {"detected": detected, "stored": not detected, "already_stored": False, "too_similar": bool(groups), "similar_family_size": family, "compared": len(js), "bank_size": size, "match": match}
