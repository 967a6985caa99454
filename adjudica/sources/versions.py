"""Tables that are replaced as one: versions in folders of their own, and one small file that says which count.

A flush writes new folders first and then renames one pointer over the last, so readers
see all of the old tables or all of the new ones, and a flush that fails or whose driver is
lost on the way leaves the old ones as they were. Tables that a flush doesn't name stay.
One writer at a time; a writer that finds the pointer changed since it began gives up.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import ranges

POINTER = "CURRENT"


@dataclass(frozen=True)
class Current:
    """What a pointer says: the version, the folder of each table below the root, and the writer's own notes."""

    version: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, folder: str, kind: str = "parquet"):
        self.spark, self.folder, self.kind = spark, folder, kind

    def current(self) -> Current:
        path = ranges.join(self.folder, POINTER)
        return Current(**json.loads(ranges.get(path))) if ranges.exists(path) else Current()

    def read(self, name: str, schema: T.StructType | str | None = None, at: Current | None = None) -> DataFrame | None:
        """A table of the current version; none if there is no such table. ``at``: of this version, for several alike."""
        found = (at or self.current()).tables.get(name)
        if found is None:
            return None
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.format(self.kind).load(ranges.join(self.folder, found))

    def flush(self, tables: dict[str, DataFrame | Callable[[], DataFrame]], notes: dict | None = None, keep: int = 1, drop: tuple[str, ...] = ()) -> Current:
        """Replace these tables and the notes; ``keep``: earlier versions whose folders stay for readers that hold them."""
        before = self.current()
        mine = f"versions/{before.version + 1:08d}-{uuid.uuid4().hex[:8]}"
        try:
            for name, rows in tables.items():
                (rows if isinstance(rows, DataFrame) else rows()).write.format(self.kind).save(ranges.join(self.folder, mine, name))
            if self.current().version != before.version:
                raise RuntimeError(f"{self.folder} was changed by another writer")
        except BaseException:
            ranges.remove(ranges.join(self.folder, mine))
            raise
        kept = {k: v for k, v in before.tables.items() if k not in drop}
        after = Current(before.version + 1, kept | {name: f"{mine}/{name}" for name in tables}, before.notes if notes is None else notes)
        ranges.put(ranges.join(self.folder, POINTER), json.dumps(after.__dict__).encode())
        self._clean(after, keep)
        return after

    def _clean(self, after: Current, keep: int) -> None:
        """Remove version folders that nothing points to, but for the newest ones."""
        system, inner, before = ranges.at(ranges.join(self.folder, "versions"))
        used = {p.split("/")[1] for p in after.tables.values()}
        names = sorted(i.base_name for i in system.get_file_info(ranges.fs.FileSelector(inner, allow_not_found=True)))
        for name in names:
            number = int(name.split("-")[0])
            if name not in used and (number < after.version - keep or number == after.version):
                ranges.remove(ranges.join(before + inner, name))
