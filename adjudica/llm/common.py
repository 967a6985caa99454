"""Shared pieces: scratch tables, word rules, by-value shipping of Python code."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a regex class body.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Whether a query's shuffle files are removed as it ends; a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(col, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, else one made for local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = checkpoint.get() if checkpoint.isDefined() else None
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Parquet tables in the shared folder, written to cut lineage.

    A table outlives the executors that wrote it, so a lost executor costs a task
    retry and not the chain before it. ``free`` removes tables that nothing reads
    any more and ``close`` all of them; what is left goes when the driver ends.
    """

    #: Scratch folders that still hold tables.
    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        Scratch.opened.append(self)
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """Write a table and read it; the shuffle files of the write go when it has ended."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def free(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and hasattr(t, "_scratch_path"):
                self._remove(t._scratch_path)

    def close(self) -> None:
        self._remove(self.root)
        if self in Scratch.opened:
            Scratch.opened.remove(self)

    def _remove(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


def sweep(docs: DataFrame, *keep: Scratch) -> None:
    """Close the scratch folders that ``docs`` doesn't read, and let finished shuffles go."""
    read = docs.inputFiles()
    for s in list(Scratch.opened):
        folder = s.root.rsplit("/", 1)[-1]
        if s not in keep and not any(f"/{folder}/" in f for f in read):
            s.close()
    release_shuffles(docs.sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished jobs now.

    Shuffle files live until the driver's JVM collects the objects that name
    them; after a scratch table is written they only take up disk.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()



