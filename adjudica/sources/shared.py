"""A new folder that the driver and all executors see, and tables kept there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are removed as it ends; a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """Below spark.checkpoint.dir; with no such setting, a temporary folder on a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows written to a new folder and read again: made once, whatever executors are lost; it goes when the driver ends.

    Shuffle files of the write go when it has ended.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, name)
    atexit.register(_remove, spark, folder)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(rows.schema).parquet(folder)
    out._kept_folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove kept tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._kept_folder)
