"""The state of evaluations on a stream: silence, retries, time limits.

One state for each key, held by Spark's state store and driven by events and by timers
of event time. An evaluation that is silent for ``warn`` seconds is warned about once; any
event ends the silence; after ``fail`` seconds of it the evaluation has failed in a way
that may pass, as it has on an event that reports such an error. Such a failure is
retried up to ``retries`` times and is final after that. An evaluation that takes more
than ``limit`` seconds from its first event has failed for good, however lively it is.
Final failures and results end the state; so does a retry that nothing follows for
``forget`` seconds.

``Machine`` is the whole rule, free of Spark: the stream runs it with the watermark as its
clock, and a test or a batch with any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Seconds of silence before a warning and a failure, of one evaluation, and how often it is tried again.
WARN, FAIL, LIMIT, RETRIES = 180, 420, 2700, 1


@dataclass(frozen=True)
class Rules:
    warn: float = WARN
    fail: float = FAIL
    limit: float | None = LIMIT
    retries: int = RETRIES
    forget: float = 86_400
    errors: tuple[str, ...] = ("error",)
    results: tuple[str, ...] = ("verdict",)


@dataclass(frozen=True)
class State:
    """started: -1 while the evaluation waits for a retry. Times are microseconds."""

    started: int = -1
    last: int = 0
    warned: bool = False
    tried: int = 0


@dataclass
class Machine:
    """Transitions (at, phase, attempt) come out in order; ``state`` is None when nothing is known of the key."""

    rules: Rules
    state: State | None = None
    told: list[tuple[int, str, int]] = field(default_factory=list)

    def _tell(self, at: int, phase: str) -> None:
        self.told.append((at, phase, self.state.tried + 1))

    def due(self) -> tuple[int, str] | None:
        """The next thing that time alone brings about."""
        if (s := self.state) is None:
            return None
        if s.started < 0:
            return s.last + int(self.rules.forget * MICROS), "forget"
        at = [(s.last + int(self.rules.fail * MICROS), "idle_failed")]
        if not s.warned:
            at.append((s.last + int(self.rules.warn * MICROS), "idle_warned"))
        if self.rules.limit is not None:
            at.append((s.started + int(self.rules.limit * MICROS), "hard_timeout"))
        return min(at)

    def advance(self, now: int) -> None:
        """Everything that time alone brings about up to and at ``now``."""
        while (found := self.due()) is not None and found[0] <= now:
            at, what = found
            if what == "forget":
                self.state = None
            elif what == "idle_warned":
                self._tell(at, what)
                self.state = replace(self.state, warned=True)
            elif what == "hard_timeout":
                self._tell(at, what)
                self.state = None
            else:
                self._failed(at, what)

    def _failed(self, at: int, why: str) -> None:
        again = self.state.tried < self.rules.retries
        self._tell(at, f"{why}_retry" if again else why)
        self.state = State(-1, at, False, self.state.tried + 1) if again else None

    def event(self, at: int, kind: str) -> None:
        """One event; one that is older than the last counts as coming with it."""
        self.advance(at)
        s = self.state or State()
        at = max(at, s.last)
        self.state = replace(s, started=at if s.started < 0 else s.started, last=at, warned=False)
        if kind in self.rules.errors:
            self._failed(at, "error")
        elif kind in self.rules.results:
            self._tell(at, "done")
            self.state = None


STORED = T.StructType([T.StructField("started", T.LongType()), T.StructField("last", T.LongType()), T.StructField("warned", T.BooleanType()), T.StructField("tried", T.IntegerType())])


class Watchdog(StatefulProcessor):
    def __init__(self, rules: Rules, key: str):
        self.rules, self.key = rules, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.stored = handle, handle.getValueState("evaluation", STORED)

    def _machine(self) -> Machine:
        row = self.stored.get() if self.stored.exists() else None
        return Machine(self.rules, State(*row) if row else None)

    def _keep(self, key: tuple, machine: Machine) -> Iterator[pd.DataFrame]:
        """The state and one timer for what time brings about next; a timer for each key at most."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if machine.state is None:
            self.stored.clear()
        else:
            s = machine.state
            self.stored.update((s.started, s.last, s.warned, s.tried))
            self.handle.registerTimer(-(-machine.due()[0] // 1000))  # whole milliseconds, not before it is due
        if machine.told:
            frame = pd.DataFrame(machine.told, columns=["at", "phase", "attempt"])
            frame.insert(0, self.key, key[0])
            frame["at"] = pd.to_datetime(frame["at"], unit="us")
            yield frame

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self._machine()
        new = pd.concat([r[["at_us", "place_no", "kind_of"]] for r in rows]).sort_values(["at_us", "place_no"], kind="stable")  # a key's rows of one batch
        for at, kind in zip(new["at_us"].tolist(), new["kind_of"].tolist(), strict=True):
            machine.event(at, kind)
        yield from self._keep(key, machine)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._machine()
        machine.advance(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000)
        yield from self._keep(key, machine)


def watch(events: DataFrame, key: str, ts: str, kind: str, place: str, rules: Rules | None = None) -> DataFrame:
    """(key, at, phase, attempt) of a stream that has a watermark on ``ts``; ``place`` orders events of one time.

    The session's state store must keep timers; see ``stateful``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(F.col(key), F.col(ts), F.unix_micros(F.col(ts)).alias("at_us"), F.col(place).alias("place_no"), F.coalesce(F.col(kind), F.lit("")).alias("kind_of"))
    schema = f"`{key}` {kinds[key]}, at timestamp, phase string, attempt int"
    return rows.groupBy(key).transformWithStateInPandas(Watchdog(rules or Rules(), key), schema, "Append", "EventTime")


class stateful:  # noqa: N801 - used as a statement
    """``with stateful(spark):`` streams started inside keep their state where timers can be kept."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(STORE, None)
        self.spark.conf.set(STORE, ROCKS)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(STORE)
        else:
            self.spark.conf.set(STORE, self.before)


def replay(events: list[tuple[int, str]], until: int, rules: Rules | None = None) -> list[tuple[int, str, int]]:
    """The transitions of one key's events (micros, kind), in order, up to ``until``."""
    machine = Machine(rules or Rules())
    for at, kind in events:
        machine.event(at, kind)
    machine.advance(until)
    return machine.told
