"""A dashboard kept by a stream: state folded batch by batch, a JSON document at most every few seconds.

Every batch merges its events into a table of the last value of each field by key; the
table is replaced as one with the number of the batch, so a batch that Spark repeats is
not folded twice. The document is made from that table when ``every`` seconds have gone
by since the last one, or at once when the batch holds a forced event; what a batch left
unshown is shown by the next one that is due, or by ``close``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import ranges
from ..sources.versions import Versions

# Fixed value: seconds between two documents.
EVERY = 5.0
DOCUMENT = "dashboard.json"


class Dashboard:
    """``fields``: the value of an event for each field, null where it says nothing; ``place``: the column that orders events.

    ``view``: from the table (key and fields) to the rows of the document, few of them and
    ordered by their first columns. ``forced``: events after which the document can't wait.
    """

    def __init__(
        self, spark: SparkSession, folder: str, key: str, place: str, fields: dict[str, Column], view: Callable[[DataFrame], DataFrame],
        every: float = EVERY, forced: Column | None = None, clock: Callable[[], float] = time.monotonic,
    ):
        self.state, self.folder = Versions(spark, folder), folder
        self.key, self.place, self.fields, self.view = key, place, fields, view
        self.every, self.forced, self.clock = every, forced, clock
        self.shown: float | None = None

    def _told(self, events: DataFrame) -> DataFrame:
        """(key, field structs of place and value) of events."""
        last = lambda v: F.max(F.when(v.isNotNull(), F.struct(F.col(self.place).alias("place"), v.alias("value"))))
        return events.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*[last(v).alias(n) for n, v in self.fields.items()])

    def table(self) -> DataFrame:
        """The table as it stands: key and fields."""
        return self.state.read("table").select(self.key, *[F.col(n)["value"].alias(n) for n in self.fields])

    def __call__(self, events: DataFrame, batch: int) -> None:
        at = self.state.current()
        if batch <= at.notes.get("batch", -1):
            return
        # Partial maxima of a key's old and new values meet in one aggregate.
        both, old = self._told(events), self.state.read("table", at=at)
        if old is not None:
            both = old.unionByName(both).groupBy(self.key).agg(*[F.max(n).alias(n) for n in self.fields])
        urgent = self.forced is not None and not events.where(self.forced).isEmpty()
        now = self.clock()
        due = urgent or self.shown is None or now - self.shown >= self.every
        self.state.flush({"table": both}, {"batch": batch, "unshown": not due})
        if due:
            self.show(now)

    def show(self, now: float) -> None:
        rows = self.view(self.table())
        entries = F.array_sort(F.collect_list(F.struct(*rows.columns)))
        document = rows.agg(F.to_json(F.struct(F.count("*").alias("n"), entries.alias("entries"))).alias("d")).first()["d"]
        ranges.put(ranges.join(self.folder, DOCUMENT), document.encode())
        self.shown = now

    def close(self) -> None:
        """Show what is still unshown."""
        at = self.state.current()
        if at.notes.get("unshown"):
            self.show(self.clock())
            self.state.flush({}, at.notes | {"unshown": False})


def document(spark: SparkSession, folder: str, entry: T.StructType) -> DataFrame:
    """The entries of the document as rows."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("entries", T.ArrayType(entry))])
    return spark.read.schema(schema).json(ranges.join(folder, DOCUMENT)).select(F.explode("entries").alias("e")).select("e.*")


def keep(stream: DataFrame, board: Dashboard, checkpoint: str) -> None:
    """Run a stream over all that is there into a dashboard."""
    stream.writeStream.foreachBatch(board).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    board.close()
