"""Command line of the ingest: ``python -m adjudica.ingest INPUT OUTPUT``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.ingest import Plan, ingest
from .sources import ranges


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="adjudica.ingest", description="Token shards and a manifest from Parquet texts.")
    p.add_argument("input", help="Parquet file, folder or glob")
    p.add_argument("output", help="folder in any store that driver and executors reach")
    p.add_argument("--source-column", default="source", help="column that names a row's source; 'file': the path of its file")
    p.add_argument("--order-column", default="doc_id")
    # Option names that scripts pass.
    p.add_argument("--dataset", default="")
    p.add_argument("--langs", default="")
    p.add_argument("--tokenizer", default="")
    p.add_argument("--text-column", default="text")
    p.add_argument("--tokens-column", default="")
    p.add_argument("--include-prefixes", default="")
    p.add_argument("--shard-size-gb", type=float, default=2.0)
    p.add_argument("--file-list", default="", help="JSON list of sources, or an object with it as 'files'; they come in this order")
    p.add_argument("--one-npy-per-parquet", "--one-shard-per-source", action="store_true", dest="one_shard_per_source")
    p.add_argument("--ordered-packed-part", action="store_true")
    p.add_argument("--part-id", default="")
    p.add_argument("--distributed-run-id", default="")
    p.add_argument("--part-manifest-only", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--keep-tail", action="store_true")
    return p


def listed(path: str) -> tuple[str, ...] | None:
    if not path:
        return None
    found = json.loads(ranges.get(path))
    return tuple(found["files"] if isinstance(found, dict) else found)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rows = spark.read.parquet(a.input)
    source = F.input_file_name() if a.source_column == "file" else F.col(a.source_column).cast("string")
    rows = rows.select(source.alias("source"), F.col(a.order_column).cast("long").alias("ord"), *[c for c in dict.fromkeys((a.text_column, a.tokens_column)) if c in rows.columns])
    names = lambda value: tuple(filter(None, value.split(",")))
    plan = Plan(
        max(1, int(a.shard_size_gb * 2**30) // 4), a.text_column, a.tokens_column, a.tokenizer, a.dataset, prefixes=names(a.include_prefixes), langs=names(a.langs),
        files=listed(a.file_list), one_shard_per_source=a.one_shard_per_source, ordered_part=a.ordered_packed_part, keep_tail=a.keep_tail,
        part_id=a.part_id, run_id=a.distributed_run_id, part_manifest_only=a.part_manifest_only, dry_run=a.dry_run,
    )
    total = ingest(spark, rows, a.output, plan).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    print(f"{total['n']} shards, {total['t']} tokens")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
