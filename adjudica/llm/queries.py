"""Queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, kdmeans, linededup, mixing, neardup, packing, pii, quality, suffixdedup, tokens, toxicity, urls
from .oracles import ORACLE_SQL

VOCABULARY = os.environ.get("ADJUDICA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
PIECES = os.environ.get("ADJUDICA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(toxicity.training_rows(documents, labels))
    scored = toxicity.score_toxicity(documents.select("doc_id", "text"), lexicon)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.report_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, PIECES)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdmeans.report_clusters(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_url_filter, op3_token_counts, op4_near_duplicates, op5_quality,
        op6_mixing, op7_toxicity, op8_line_dedup, op9_decontamination, op10_suffix_dedup,
        op11_packing, op12_alignment, op13_clustering,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
