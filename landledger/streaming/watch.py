"""Running calls watched as a stream: told while they run, paired with their results, forgotten afterwards.

State holds a few numbers for each call that is open, not its marks. They are dropped when the call has its result, and after
`FORGET` without one. A timer tells every `pulse` how long an open call has been running, whether or not new records come.
A run's calls are dealt to `SHARES` groups, and a group's open calls are one state value: each read of state, write and timer
is a message between Python and Spark, which takes longer than all else that a call needs. For the same reason marks enter
the stateful step, and events leave it, as rows of lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from landledger.operators.usage import HEARTBEAT_SECONDS

#: How long a call may stay without a result, in milliseconds.
FORGET = 7 * 24 * 3600 * 1000
_EVENT = {"call_id": "string", "event": "string", "tool": "string", "started": "double", "ended": "double", "failed": "boolean", "seconds": "double"}
_MARK = {"arrival": "bigint", "call_id": "string", "kind": "string", "tool": "string", "at": "double", "elapsed": "double", "failed": "boolean"}
_TOLD = "run string, " + ", ".join(f"{name} array<{kind}>" for name, kind in _EVENT.items())
_MARKS = "run string, share bigint, " + ", ".join(f"{name} array<{kind}>" for name, kind in _MARK.items())
_STATE = "calls array<struct<call_id string, tool string, started double, shown double, ended double, failed boolean, seen bigint, due bigint>>"
#: Groups that a run's calls are dealt to. A task holds the marks that a batch brings for one group. Part of the state's key: fixed for a checkpoint.
SHARES = 64
#: Needed by the query that runs this: state with timers lives in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class _Call:
    """An open call: `seen` is when its last mark came, `due` when its running time is told next, both in milliseconds."""

    tool: str | None = None
    started: float | None = None
    shown: float = 0.0
    ended: float | None = None
    failed: bool | None = None
    seen: int = 0
    due: int | None = None


class CallWatch(StatefulProcessor):
    """Events of a call: `started`, `beat` (a mark at least HEARTBEAT_SECONDS after the last one told), `running` (by the timer), `ended`.

    A group has one timer, at the earliest `due` of its calls, as long as any of them has started.
    """

    def __init__(self, pulse: float, forget: int):
        self.pulse, self.forget = int(pulse * 1000), forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("calls", _STATE, self.forget)

    @staticmethod
    def _told(key: tuple, events: list[tuple]) -> Iterator[Row]:
        if events:
            yield Row(run=key[0], **{name: list(c) for name, c in zip(_EVENT, zip(*events, strict=True), strict=True)})

    def _held(self) -> dict[str, _Call]:
        held = self.state.get()
        return {c[0]: _Call(*c[1:]) for c in held[0]} if held is not None else {}

    def _remembered(self, held: dict[str, _Call], now: int) -> dict[str, _Call]:
        return {call_id: c for call_id, c in held.items() if c.seen + self.forget > now}

    def _hold(self, calls: dict[str, _Call]) -> None:
        if calls:
            self.state.update(([(call_id, *astuple(c)) for call_id, c in calls.items()],))
        else:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._held()
        timed = any(c.started is not None for c in held.values())
        calls = self._remembered(held, now)
        marked, told = {}, []
        marks = [m for r in rows for m in zip(*(r[name] for name in _MARK), strict=True)]  # a batch's marks of one group
        for _, call_id, kind, tool, at, elapsed, failed in sorted(marks, key=itemgetter(0)):
            c = marked[call_id] = calls.get(call_id) or calls.setdefault(call_id, _Call())
            if kind == "call" and c.started is None:
                c.tool, c.started, c.due = tool, at, now + self.pulse
                told.append((call_id, "started", c.tool, c.started, None, None, None))
            elif kind == "beat" and elapsed - c.shown >= HEARTBEAT_SECONDS:
                c.shown = elapsed
                told.append((call_id, "beat", c.tool or tool, c.started, None, None, c.shown))
            elif kind == "result" and c.ended is None:
                c.ended, c.failed = at, bool(failed)
        for call_id, c in marked.items():
            c.seen = now
            if c.started is not None and c.ended is not None:
                told.append((call_id, "ended", c.tool, c.started, c.ended, c.failed, c.ended - c.started))
                del calls[call_id]
        yield from self._told(key, told)
        if calls or held:
            self._hold(calls)
        due = [c.due for c in calls.values() if c.started is not None]
        if due and not timed:
            self.handle.registerTimer(min(due))
        elif timed and not due:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._held()
        calls = self._remembered(held, now)
        running = {call_id: c for call_id, c in calls.items() if c.started is not None}
        told = []
        for call_id, c in running.items():
            if c.due <= now:
                c.due = now + self.pulse
                told.append((call_id, "running", c.tool, c.started, None, None, now / 1000 - c.started))
        yield from self._told(key, told)
        if told or len(calls) < len(held):
            self._hold(calls)
        if running:
            self.handle.registerTimer(min(c.due for c in running.values()))

    def close(self) -> None: ...


def call_marks(records: DataFrame) -> DataFrame:
    """Calls, their beats (under the parent's id where a call began them) and their results, as rows of one kind."""
    blocks = records.where("message.content IS NOT NULL").select("run", "arrival", "ts", F.posexplode("message.content").alias("place", "b"))
    none = F.lit(None).cast("double")
    sides = blocks.where(F.col("b.type").isin("tool_use", "tool_result")).select(
        "run", F.when(F.col("b.type") == "tool_use", F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("call_id"),
        F.when(F.col("b.type") == "tool_use", "call").otherwise("result").alias("kind"), F.coalesce("b.name", F.lit("?")).alias("tool"),
        F.col("ts").cast("double").alias("at"), "arrival", none.alias("elapsed"), F.coalesce("b.is_error", F.lit(False)).alias("failed"),
    )
    beats = records.where("type = 'tool_progress'").select(
        "run", F.coalesce("parent_tool_use_id", "tool_use_id").alias("call_id"), F.lit("beat").alias("kind"), F.coalesce("tool_name", F.lit("?")).alias("tool"),
        F.col("ts").cast("double").alias("at"), "arrival", F.coalesce("elapsed_time_seconds", F.lit(0.0)).alias("elapsed"), F.lit(False).alias("failed"),
    )
    return sides.unionByName(beats).where("call_id IS NOT NULL")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of a batch, one row of lists for each group."""
    for batch in batches:
        grouped = pa.Table.from_batches([batch]).group_by(["run", "share"], use_threads=False).aggregate([(name, "list") for name in _MARK])
        yield from grouped.select(["run", "share", *[f"{name}_list" for name in _MARK]]).rename_columns(["run", "share", *_MARK]).to_batches()


def watch_calls(records: DataFrame, pulse: float = HEARTBEAT_SECONDS, forget: int = FORGET) -> DataFrame:
    """What happens to each call, as it happens."""
    marks = call_marks(records).withColumn("share", F.pmod(F.xxhash64("call_id"), F.lit(SHARES)))
    told = marks.mapInArrow(_packed, _MARKS).groupBy("run", "share").transformWithState(
        CallWatch(pulse, forget), outputStructType=_TOLD, outputMode="update", timeMode="processingTime"
    )
    return told.select("run", F.inline(F.arrays_zip(*_EVENT)))
