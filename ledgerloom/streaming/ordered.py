"""Keyed folds in order of event time, over streams whose rows come in any order.

``Ordered`` is a stateful processor: rows wait in a list state until the clock has passed them, then a fold takes those of
a key in order and the key's state goes on. The clock stands ``late`` behind the newest row of the whole stream, so rows
that come in time are always folded in order, and those behind the clock are returned as late and never folded. A timer
releases them, and drops the states of keys that have been idle, so state is bounded by the keys that are alive and the
rows within ``late``.

A call to the state store costs more than folding a row, so keys share lanes, by a hash: what a lane's keys wait for and
keep is read and written together, as an array a column. Calls grow with lanes times batches, not with keys. The number of
lanes is fixed for the life of a checkpoint; a task holds one lane at a time, its keys' states and waiting rows.

Spark itself drops rows behind its watermark before a processor sees them. Its watermark is therefore set ``KEPT``
behind the newest row, and the clock is that watermark plus ``KEPT - late``: nothing within ``KEPT`` is dropped unseen.

Everything lives in Spark's state store, so a query that is started again on its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType, _parse_datatype_string

#: Rows further behind the newest one are dropped by Spark, and counted in its metrics only.
KEPT_MS = 365 * 86_400_000
#: Lanes that all keys of a stream are dealt to. About a thousand keys a lane are well paid; small batches over many more want more lanes.
LANES = 8192
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Fold:
    """What ``Ordered`` does with rows in order.

    ``step(key, state, rows)`` gets a key's state (None at first) and its next rows, in order, and returns the output
    rows and the new state (None: nothing to keep). A state is dropped when its key has been idle for the given time, if
    ``droppable``, or when the clock passes the microsecond that ``wake(state)`` names; ``ended(key, state)`` gives the
    output then. States and output rows are tuples of the given schemas.
    """

    step: Callable[[tuple, tuple | None, list[tuple]], tuple[list[tuple], tuple | None]]
    state: str
    output: str
    ended: Callable[[tuple, tuple], list[tuple]] = field(default=lambda key, state: [])
    wake: Callable[[tuple], int] | None = None
    droppable: Callable[[tuple], bool] = field(default=lambda state: True)


class Ordered(StatefulProcessor):
    """Rows of each key of a lane in order of (``us``, the other columns): see the module. ``columns``: ``us`` first; ``names``: of the output."""

    def __init__(self, fold: Fold, keys: StructType, columns: StructType, names: list[str], late_ms: int, idle_ms: int | None):
        self.fold, self.keys, self.columns, self.names = fold, keys, columns, names
        self.late_ms, self.idle_ms = late_ms, idle_ms
        self.chunk = _arrays([*keys.fields, *columns.fields])
        self.state = _arrays([*[StructField(f"key_{f.name}", f.dataType) for f in keys.fields], *_parse_datatype_string("last_us long, " + fold.state).fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.chunk)
        self.kept = handle.getValueState("kept", self.state)
        self.row = Row(*self.names)
        self.width = len(self.keys.names)
        self.absent = (None,) * len(self.columns.names)
        self.nothing = (None,) * (len(self.names) - len(self.absent) - self.width - 1)
        self.passed: set[tuple] = set()  # lanes that this task has brought up to the clock

    def _clock(self, timers: Any) -> int:
        mark = timers.getCurrentWatermarkInMs()
        return mark + KEPT_MS - self.late_ms if mark > 0 else 0

    def _wake_at(self, us: int) -> None:
        """A timer for when the clock has passed ``us``."""
        self.handle.registerTimer(us // 1000 + 1 + self.late_ms - KEPT_MS)

    def _parts(self, last: int | None, due: list[tuple]) -> Iterator[list[tuple] | None]:
        """Rows without an idle time between them; None stands for one, so that what is dropped depends on event time, not on batches."""
        part: list[tuple] = []
        for r in due:
            if self.idle_ms is not None and last is not None and r[0] - last > self.idle_ms * 1000:
                if part:
                    yield part
                yield None
                part = []
            part.append(r)
            last = r[0]
        yield part

    def _folded(self, key: tuple, held: tuple | None, due: list[tuple]) -> tuple[list[tuple], tuple | None]:
        """Output rows of a key's next rows, and what is kept of it."""
        state, made = tuple(held[1:]) if held else None, []
        for part in self._parts(held[0] if held else None, due):
            if part is None:
                if state is not None and self.fold.droppable(state):
                    made, state = made + self.fold.ended(key, state), None
            else:
                out, state = self.fold.step(key, state, part)
                made = made + out
        return made, None if state is None else (due[-1][0], *state)

    def _over(self, held: tuple, clock: int) -> bool:
        """Whether a state goes: its key is idle, or its time has come."""
        idle = self.idle_ms is not None and held[0] // 1000 + self.idle_ms < clock and self.fold.droppable(held[1:])
        return idle or (self.fold.wake is not None and self.fold.wake(held[1:]) // 1000 < clock)

    def _ends(self, held: tuple) -> Iterator[int]:
        if self.fold.wake:
            yield self.fold.wake(held[1:])
        if self.idle_ms is not None and self.fold.droppable(held[1:]):
            yield held[0] + self.idle_ms * 1000

    def _rows(self, key: tuple, made: list[tuple]) -> Iterator[Row]:
        for out in made:
            yield self.row(*key, False, *out, *self.absent)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        clock, fresh, pick = self._clock(timerValues), [], None
        for r in rows:
            if pick is None:
                pick = itemgetter(*[r.__fields__.index(n) for n in (*self.keys.names, *self.columns.names)])
            r = pick(r)
            if None in r[: self.width]:
                continue
            if r[self.width] // 1000 >= clock:
                fresh.append(r)
            else:
                yield self.row(*r[: self.width], True, *self.nothing, *r[self.width :])
        if fresh:
            self.waiting.appendValue(_columns(fresh))
            self._wake_at(min(r[self.width] for r in fresh))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        clock, lane = self._clock(timerValues), tuple(key)
        if lane in self.passed:
            return
        self.passed.add(lane)
        due: dict[tuple, list[tuple]] = {}
        left = []
        for chunk in self.waiting.get():
            for r in zip(*chunk):
                if r[self.width] // 1000 < clock:
                    due.setdefault(r[: self.width], []).append(r[self.width :])
                else:
                    left.append(r)
        stored = self.kept.get()
        kept = {r[: self.width]: r[self.width :] for r in zip(*stored)} if stored else {}
        busy = {r[: self.width] for r in left}  # what they wait for may go on before their state is over
        for k, mine in due.items():
            made, held = self._folded(k, kept.pop(k, None), sorted(mine, key=_order))
            yield from self._rows(k, made)
            if held is not None:
                kept[k] = held
        over = [k for k, held in kept.items() if k not in busy and self._over(held, clock)]
        for k in over:
            yield from self._rows(k, self.fold.ended(k, kept.pop(k)[1:]))
        if due:
            self.waiting.put([_columns(left)]) if left else self.waiting.clear()
        if due or over:
            self.kept.update(_columns([(*k, *held) for k, held in kept.items()])) if kept else self.kept.clear()
        ends = [us for k, held in kept.items() if k not in busy for us in self._ends(held)] + [r[self.width] for r in left]
        if ends:
            self._wake_at(min(ends))

    def close(self) -> None:
        pass


class InTurn(StatefulProcessor):
    """A fold over rows that come in order, as the finished windows of a watermarked aggregate do: (``us``, ...) of each batch are sorted, batches follow one another."""

    def __init__(self, fold: Fold, columns: StructType, names: list[str], idle_ms: int):
        self.fold, self.columns, self.names, self.idle_ms = fold, columns, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "last_us long, " + self.fold.state)
        self.row = Row(*self.names)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        key, held = tuple(key), self.kept.get()
        due = sorted((tuple(r[n] for n in self.columns.names) for r in rows), key=_order)
        made, state = self.fold.step(key, tuple(held[1:]) if held else None, due)
        self.kept.update((due[-1][0], *state))
        self.handle.registerTimer(due[-1][0] // 1000 + self.idle_ms)
        for out in made:
            yield self.row(*key, *out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.kept.get()
        if held and held[0] // 1000 + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def _arrays(fields: list[StructField]) -> StructType:
    return StructType([StructField(f.name, ArrayType(f.dataType)) for f in fields])


def _columns(rows: list[tuple]) -> tuple:
    return tuple(map(list, zip(*rows)))


def _order(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)


def in_order(stream: DataFrame, keys: list[str], columns: list[str], fold: Fold, late_ms: int, idle_ms: int | None = None, lanes: int = LANES) -> DataFrame:
    """The fold's rows of each key, and the late rows (``late`` true; their columns as ``late_*``) of a stream with ``ts`` and ``us``.

    ``columns`` order rows of one ``us``; the first ones must tell rows apart. Rows with a null key only move the clock.
    Keys share ``lanes``: see the module.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = StructType([stream.schema[c] for c in ["us", *columns]])
    late = [StructField(f"late_{f.name}", f.dataType) for f in own.fields]
    schema = StructType([*[stream.schema[k] for k in keys], StructField("late", BooleanType()), *_parse_datatype_string(fold.output).fields, *late])
    marked = stream.withWatermark("ts", f"{KEPT_MS} milliseconds")  # a filter on keys here would be pushed below the watermark
    work = Ordered(fold, StructType([stream.schema[k] for k in keys]), own, schema.names, late_ms, idle_ms)
    dealt = marked.select(F.pmod(F.xxhash64(*keys), F.lit(lanes)).alias("_lane"), *keys, "ts", *own.names)
    return dealt.groupBy("_lane").transformWithState(work, schema, "append", "eventTime")


def in_turn(finished: DataFrame, keys: list[str], columns: list[str], fold: Fold, idle_ms: int) -> DataFrame:
    """The fold's rows over the finished windows (``w``) of a streaming aggregate, each key's in order of ``us``."""
    finished.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = StructType([finished.schema[c] for c in ["us", *columns]])
    schema = StructType([*[finished.schema[k] for k in keys], *_parse_datatype_string(fold.output).fields])
    work = InTurn(fold, own, schema.names, idle_ms)
    return finished.select(*keys, "w", *own.names).groupBy(*keys).transformWithState(work, schema, "append", "eventTime")


def on_time(df: DataFrame) -> DataFrame:
    """The fold's rows of what ``in_order`` wrote."""
    return df.filter("not late").select([c for c in df.columns if c != "late" and not c.startswith("late_")])


def late_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that came behind the clock."""
    return df.filter("late").select(*keys, *[F.col(c).alias(c[5:]) for c in df.columns if c.startswith("late_")])

