"""Tables of a folder as temporary views, for users who write SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def register_views(spark: SparkSession, tables: Iterable[tuple[str, DataFrame]], prefix: str = "") -> list[str]:
    """Each (name, table) as a temporary view ``prefix`` + name; gives the names."""
    made = []
    for name, rows in tables:
        if not name.isidentifier():
            raise ValueError(f"{name} is no name for a view")
        rows.createOrReplaceTempView(prefix + name)
        made.append(prefix + name)
    return made
