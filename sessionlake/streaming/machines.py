"""Stateful streams: the step functions of the batch folds, run in event time with timers.

Rows wait in the state of their session until the watermark has passed them, then they are folded in order, so that rows that come late
but within the watermark give the batch result. Timers wake a session when its next row is due, when something the machine waits for is
over, and when the session has been silent for so long that it counts as ended: then its machine is finished and its state dropped.
Rows behind the watermark are never folded and never change what was published; `LateRows` counts them. Spark itself refuses those behind
the watermark of the batch before; those between the two watermarks are refused by the machine.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from sessionlake.operators import counters, detections, machines
from sessionlake.streaming.windows import ORIGIN_MS, with_event_time

STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 600_000
REFUSED = "_refused"

Step = Callable[[Any, tuple], tuple[Any, Iterable[tuple]]]


@dataclass(frozen=True)
class Machine:
    """A step over rows, what it publishes when its session ends, and what it forgets in time.

    ``columns`` are the fields of a row that the step takes; ``fields`` the DDL of what it publishes. ``deadline`` gives the time from which
    ``forget(state, now)`` is to be called, if any; it returns a state and rows to publish. States must survive JSON.
    """

    step: Step
    columns: tuple[str, ...]
    fields: str
    finish: Callable[[Any], Iterable[tuple]] = lambda state: ()
    deadline: Callable[[Any], int | None] = lambda state: None
    forget: Callable[[Any, int], tuple[Any, Iterable[tuple]]] = lambda state, now: (state, ())


def _place(values: Sequence[Any]) -> list[tuple]:
    return [(v is not None, v if v is not None else 0) for v in values]


class SessionMachine(StatefulProcessor):
    """One machine per key. State: `core` (machine state, last row's time, next timer) and `waiting` (rows the watermark has not passed)."""

    def __init__(self, machine: Machine, keys: Sequence[str], order: Sequence[str], time: str, idle_ms: int) -> None:
        self.machine, self.keys, self.order, self.time, self.idle_ms = machine, list(keys), list(order), time, idle_ms
        self.names = [*keys, *(field.name for field in T._parse_datatype_string(machine.fields).fields), REFUSED]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", "body string")
        self.waiting = handle.getListState("waiting", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, new, late = timerValues.getCurrentWatermarkInMs() - ORIGIN_MS, [], 0
        for row in rows:
            if row[self.time] > now:
                new.append((json.dumps([row[self.time], [row[name] for name in self.order], [row[name] for name in self.machine.columns]]),))
            else:
                late += 1
        if late:
            yield Row(**{**dict.fromkeys(self.names), **dict(zip(self.names, key)), REFUSED: late})
        if new:
            self.waiting.appendList(new)
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, timers) -> Iterator[Row]:
        now = timers.getCurrentWatermarkInMs() - ORIGIN_MS
        rows = sorted((json.loads(body) for body, in self.waiting.get()), key=lambda row: (row[0], _place(row[1]))) if self.waiting.exists() else []
        if not rows and not self.core.exists():
            return
        core = json.loads(self.core.get()[0]) if self.core.exists() else {"state": None, "last": None, "timer": None}
        due = sum(row[0] <= now for row in rows)
        state, out = core["state"], []
        for time, _, values in rows[:due]:
            state, made = self.machine.step(state, tuple(values))
            out.extend(made)
            core["last"] = time
        rest = rows[due:]
        limit = self.machine.deadline(state)
        if limit is not None and limit <= now:
            state, made = self.machine.forget(state, now)
            out.extend(made)
            limit = self.machine.deadline(state)
        ended = not rest and core["last"] is not None and core["last"] + self.idle_ms <= now
        if core["timer"] is not None:
            self.handle.deleteTimer(core["timer"])
        if ended:
            out.extend(self.machine.finish(state))
            self.core.clear()
            self.waiting.clear()
        else:
            if due and rest:
                self.waiting.put([(json.dumps(row),) for row in rest])
            elif due:
                self.waiting.clear()
            wake = [rest[0][0]] if rest else [core["last"] + self.idle_ms]
            core["timer"] = min([*wake, *([limit] if limit is not None else [])]) + ORIGIN_MS
            core["state"] = state
            self.core.update((json.dumps(core),))
            self.handle.registerTimer(core["timer"])
        for row in out:
            yield Row(**dict(zip(self.names, (*key, *row, None))))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that machines need, for streams built and started inside; later ones have the session's own again."""
    before = spark.conf.get(STATE_STORE_CONF, None)
    spark.conf.set(STATE_STORE_CONF, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE_CONF)
        else:
            spark.conf.set(STATE_STORE_CONF, before)


def run_machine(stream: DataFrame, machine: Machine, keys: Sequence[str], order: Sequence[str], *, time: str = "t_ms", watermark: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """The machine's rows for every key of the stream, equal to those of the batch fold.

    ``time`` is in session milliseconds, ``order`` sorts rows of one time. A key that is silent for ``idle_ms`` has ended: a row that comes later starts
    it anew. Needs the RocksDB state store, which `build_session` and `state_store` name."""
    spark = stream.sparkSession
    if spark.conf.get(STATE_STORE_CONF, None) != ROCKSDB:
        raise ValueError(f"set {STATE_STORE_CONF} to {ROCKSDB}")
    schema = T.StructType([stream.schema[name] for name in keys] + T._parse_datatype_string(machine.fields).fields)
    needed = list(dict.fromkeys([*keys, time, *order, *machine.columns]))
    rows = with_event_time(stream.select(*needed), time).withWatermark("event_time", watermark)
    out = rows.groupBy(*keys).transformWithState(SessionMachine(machine, keys, order, time, idle_ms), schema.add(REFUSED, T.LongType()), "Append", "EventTime")
    counted = out.observe(f"{REFUSED}{uuid.uuid4().hex}", F.sum(REFUSED).alias("rows"))
    return counted.filter(F.col(REFUSED).isNull()).drop(REFUSED)


def stream_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], step: Step, out_fields: str, **options: Any) -> DataFrame:
    """Run a batch step function over a stream; ``order`` begins with the time."""
    return run_machine(stream, Machine(step, tuple(columns), out_fields), keys, list(order)[1:], time=order[0], **options)


COIN = Machine(machines.coin_step, tuple(machines.COIN_COLUMNS), machines.COIN_FIELDS, deadline=machines.coin_deadline, forget=machines.coin_forget)
_READING = ("second", *machines.READING_COLUMNS)
SELECT = Machine(machines.select_reading, _READING, machines.SECOND_FIELDS, finish=machines.select_finish)
SEQUENCE = Machine(machines.sequence_reading, _READING, machines.SECOND_FIELDS, finish=machines.sequence_reading_finish)
PLAUSIBLE = Machine(counters.plausible_step, ("second", "value", "times", "confidence"), "second long, kill_value long, confidence double, source string", finish=counters.plausible_finish)


def reading_stream(stream: DataFrame, *, second: str, sample: str, text: str, confidence: str, excluded: str, tie: str) -> DataFrame:
    """Single readings in the form that `SELECT` and `SEQUENCE` take; repeated readings meet in their state."""
    digits = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^0-9]", "")
    return stream.withColumns({"second": F.col(second), "first": F.col(tie), "sample": F.col(sample), "digits": digits, "confidence": F.col(confidence), "excluded": F.col(excluded)})


def candidate_stream(stream: DataFrame, *, second: str, value: str, confidence: str) -> DataFrame:
    """Single candidates in the form that `PLAUSIBLE` takes: a blank is seen no times."""
    seen = F.col(value).isNotNull().cast("long")
    return stream.withColumns({"second": F.col(second), "value": F.coalesce(F.col(value), F.lit(-1)).cast("long"), "times": seen, "confidence": F.when(seen == 1, F.col(confidence)).otherwise(0.0)})


def track_machine(reach: float = 100.0, gap_ms: int = 1_250) -> Machine:
    """Detections and interruptions (`stop`) of one session and any codes, to tracks. State: the time of the last stop, and the open tracks by code."""

    def step(state, row):
        stop, code, ident, t, x, y, score = row
        last, open_tracks = state or (None, {})
        if stop:
            return [t, {}], []
        if last == t:
            return [last, open_tracks], []
        name = json.dumps(code)  # no code is a name, too
        open_tracks[name], out = detections.nearest_track(open_tracks.get(name, []), (ident, t, x, y, score), reach, gap_ms)
        return [last, open_tracks], [(code, *made) for made in out]

    def deadline(state):
        times = [k[3] for mine in state[1].values() for k in mine] if state else []
        return min(times) + gap_ms + 1 if times else None

    def forget(state, now):
        kept = {name: [k for k in mine if now - k[3] <= gap_ms] for name, mine in state[1].items()}
        return [state[0], {name: mine for name, mine in kept.items() if mine}], []

    return Machine(step, ("stop", "code", "det_id", "t_ms", "x", "y", "score"), f"code string, {detections.TRACK_FIELDS}", deadline=deadline, forget=forget)


def track_stream(found: DataFrame, stops: DataFrame, codes: Sequence[Any] | None = None, *, key: str = "session_id", reach: float = 100.0, gap_ms: int = 1_250, slots: int = 16, **options: Any) -> DataFrame:
    """Tracks over a stream of detections (`key`, code, det_id, t_ms, x, y, score) and one of interruptions (`key`, t_ms), which end the tracks of all codes,
    or of those in ``codes`` only.

    Keyed by session and slot: a code belongs to one of ``slots`` by its hash, and an interruption goes to all of them, so that it meets any number of codes
    without a list of them, before the detections of its time. A track that nothing may join any more leaves the state by its timer."""
    code, kind = F.col("code"), found.schema["code"].dataType
    slot = F.pmod(F.xxhash64(code), F.lit(slots)).cast("int")
    if codes is not None:  # the other codes have slots below zero, where no interruption goes
        listed = F.when(code.isNull(), F.lit(None in codes)).otherwise(code.isin([c for c in codes if c is not None]))
        slot = F.when(listed, slot).otherwise(-1 - slot)
    rank = (-F.round(F.col("score") * 1e9)).cast("long")
    d = found.select(key, slot.alias("slot"), code.cast("string").alias("code"), "t_ms", "det_id", "x", "y", "score", F.lit(False).alias("stop"), rank.alias("rank"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    ends = stops.select(key, every, F.lit(None).cast("string").alias("code"), "t_ms", F.lit(None).cast(found.schema["det_id"].dataType).alias("det_id"), *(F.lit(None).cast("double").alias(c) for c in ("x", "y", "score")), F.lit(True).alias("stop"), F.lit(None).cast("long").alias("rank"))
    out = run_machine(d.unionByName(ends), track_machine(reach, gap_ms), [key, "slot"], ["rank", "det_id"], **options)
    return out.select(key, code.cast(kind).alias("code"), *(c for c in out.columns if c not in (key, "slot", "code")))


class LateRows(StreamingQueryListener):
    """Counts what arrived and what came behind the watermark, by query name.

    ``watch`` marks a stream whose rows are to be counted; ``late`` is what stateful operators and machines refused. Add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        super().__init__()
        self.arrived: dict[str, int] = defaultdict(int)
        self.late: dict[str, int] = defaultdict(int)
        self.ended: set[str] = set()

    @staticmethod
    def watch(stream: DataFrame) -> DataFrame:
        return stream.observe("arrived", F.count(F.lit(1)).alias("rows"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        name = progress.name or str(progress.id)
        if "arrived" in progress.observedMetrics:
            self.arrived[name] += progress.observedMetrics["arrived"].rows or 0
        self.late[name] += sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        self.late[name] += sum(row.rows or 0 for metric, row in progress.observedMetrics.items() if metric.startswith(REFUSED))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
