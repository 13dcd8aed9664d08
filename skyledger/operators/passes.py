"""Frame-clocked state machines over keyed rows: one pass over sorted partitions in batch, event-time timers over a stream. Both drive the same machine, so they give the same rows.

A machine has
- step(frame, rows): a frame's rows, as a dict of columns, in their order; gives what comes out,
- wake(frame): the clock has passed `frame` without further rows; gives what that brings about,
- due(): the frame at which it has to be woken if nothing comes, or None,
- state() and restore(state): its state as plain values (numbers, strings, lists, dicts).
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: Event time of frame 0 and of each further one, in milliseconds; 0 would count as late before any row has come.
FIRST_MS = FRAME_MS = 1000
#: Frames whose rows are stepped at once, rows of several such blocks that lie together in state, and rows that come out at once.
BLOCK, LOT, OUT = 64, 256, 20_000


@dataclass(frozen=True)
class Pass:
    """make: a new machine; columns: what it reads besides key and frame; order: a frame's rows are sorted by these; out: DDL of what it gives, without the key."""

    make: Callable[[], object]
    columns: tuple[str, ...]
    order: tuple[str, ...]
    out: str
    key: str
    frame: str = "frame"


def _values(column: pa.ChunkedArray):
    """A column without nulls as an array of numbers, any other as a list."""
    kind = column.type
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy()
    if not column.null_count and pa.types.is_list(kind) and pa.types.is_floating(kind.value_type):
        return [v for chunk in column.chunks for v in _vectors(chunk)]
    return column.to_pylist()


def _vectors(chunk: pa.ListArray) -> list[list]:
    """Lists of numbers, cut out of all of them; each to_pylist() makes a scalar of every number."""
    flat, ends = chunk.flatten(), (chunk.offsets.to_numpy() - chunk.offsets[0].as_py()).tolist()
    flat = flat.to_pylist() if flat.null_count else flat.to_numpy().tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _in_order(batches: Iterator[pa.RecordBatch], p: Pass) -> Iterator[tuple[object, int, dict, bool]]:
    """(key, frame, rows, whether an Arrow batch ends here) of batches sorted by key and frame. Only the last frame of a batch waits for the next one."""
    names, rest = [p.key, p.frame, *p.columns], None
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(names)
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys, frames = table.column(p.key).to_pylist(), table.column(p.frame).to_numpy()
        new = np.flatnonzero(np.r_[True, np.diff(frames) != 0] | np.array([True, *(a != b for a, b in zip(keys, keys[1:]))]))
        rest = table.slice(int(new[-1]))
        columns = {c: _values(table.column(c)) for c in p.columns}
        for i, (a, b) in enumerate(zip(new[:-1].tolist(), new[1:].tolist())):
            yield keys[a], int(frames[a]), {c: v[a:b] for c, v in columns.items()}, i == len(new) - 2
    if rest is not None and rest.num_rows:
        yield rest.column(p.key)[0].as_py(), rest.column(p.frame)[0].as_py(), {c: _values(rest.column(c)) for c in p.columns}, True


def run_batch(rows: DataFrame, p: Pass, until: int | None = None, spread: int | None = None) -> DataFrame:
    """Every key's rows through a machine of its own, in order of frame; a key's rows need not fit into memory, as only the machine and one Arrow batch are held.

    until: where the clock stands at the end; what falls due by then still comes out. Rows without frame
    are left out; rows without key make one key. spread: keys are dealt to tasks by ranges, so that a task
    has one key or some 1/spread of all rows, at the cost of a look at the keys beforehand; without it by
    hash, where heavy keys that are few come together in a task by chance, and the rest of the tasks are idle.
    """
    kind = rows.schema[p.key].dataType.simpleString()
    out = f"{p.key} {kind}, {p.out}"
    schema = to_arrow_schema(StructType.fromDDL(out))
    rows = rows.where(F.col(p.frame).isNotNull()).select(p.key, F.col(p.frame).cast("long").alias(p.frame), *p.columns)

    def table(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, done = None, None, []
        for key, frame, some, last in _in_order(batches, p):
            if machine is None or now != key:
                if machine is not None and until is not None:
                    done += [(now, *r) for r in machine.wake(until)]
                now, machine = key, p.make()
            done += [(key, *r) for r in machine.wake(frame - 1)]
            done += [(key, *r) for r in machine.step(frame, some)]
            if done and (last or len(done) >= 20_000):
                yield table(done)
                done = []
        if machine is not None and until is not None:
            done += [(now, *r) for r in machine.wake(until)]
        if done:
            yield table(done)

    dealt = rows.repartition(p.key) if spread is None else rows.repartitionByRange(spread, p.key)
    return dealt.sortWithinPartitions(p.key, p.frame, *p.order).mapInArrow(run, out)


# --- streams ----------------------------------------------------------------------------------


def frame_time(frame) -> F.Column:
    """Event time of a frame."""
    return F.timestamp_millis(frame.cast("long") * FRAME_MS + FIRST_MS)


def _plain(v):
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v.tolist()]
    v = v.item() if isinstance(v, np.generic) else v
    return None if v is None or v is pd.NaT or isinstance(v, float) and v != v else v


def _plains(column: pd.Series) -> list:
    """A column's values, each as _plain has it."""
    if column.dtype.kind in "iub":
        return column.tolist()
    if column.dtype.kind == "f":
        return [None if v != v else v for v in column.tolist()]
    return [_plain(v) for v in column]


def _lots(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows in order of frame, as they lie in state: a block's rows together, and blocks of few rows up to LOT of them, as each lot costs the same few calls however small it is."""
    lot = []
    for _, some in groupby(rows, lambda r: r[0] // BLOCK):
        some = list(some)
        if lot and len(lot) + len(some) > LOT:
            yield lot
            lot = []
        lot += some
    if lot:
        yield lot


class _Clock(StatefulProcessor):
    """A key's open frames wait in lots until the watermark has passed them; then they are stepped in order, a block at a time, so that a task holds the rows of one block and, of each part, those read with it (fewer than LOT), however many a micro-batch brings. One timer stands for the earliest of what is open and what the machine is due for."""

    def __init__(self, p: Pass, names: list[str]):
        self.p, self.names = p, names

    def init(self, handle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string")
        # rows lie in parts, one for each Arrow batch that had some, and a part's lots by their first block
        self.open = handle.getMapState("open", "block long, part long", "rows string")
        self.parts = handle.getValueState("parts", "n long")

    def close(self) -> None:
        pass

    def _call(self, frame: int | None, standing: Iterable[int]) -> None:
        """One timer at the frame, and none of those standing."""
        want = None if frame is None else frame * FRAME_MS + FIRST_MS
        for t in standing:
            if t == want:
                want = None
            else:
                self.handle.deleteTimer(t)
        if want is not None:
            self.handle.registerTimer(want)

    def _load(self):
        machine, state = self.p.make(), self.machine.get()
        if state is not None:
            machine.restore(json.loads(state[0]))
        return machine

    def _put(self, part: int, rows: list[tuple]) -> None:
        for lot in _lots(rows):
            self.open.updateValue((lot[0][0] // BLOCK, part), (json.dumps(lot),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, part = None, (self.parts.get() or (0,))[0]
        for some in rows:
            found = sorted(zip(some[self.p.frame].tolist(), zip(*[_plains(some[c]) for c in self.p.columns], strict=True), strict=True), key=lambda r: r[0])
            if found:
                self._put(part, found)
                first = found[0][0] if first is None else min(first, found[0][0])
                part += 1
        if first is None:
            return
        self.parts.update((part,))
        standing = list(self.handle.listTimers())
        if not standing or first < (min(standing) - FIRST_MS) // FRAME_MS:
            self._call(first, standing)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p, now = self.p, (timerValues.getCurrentWatermarkInMs() - FIRST_MS) // FRAME_MS
        machine, lots, read, out = self._load(), {}, {}, []
        order = [p.columns.index(c) for c in p.order]
        for block, part in list(self.open.keys()):
            lots.setdefault(block, []).append(part)
        # a lot isn't looked at before its first frame could be closed
        blocks = sorted(lots)
        unread = bisect_right(blocks, now // BLOCK)
        for block, next_block in zip(blocks[:unread], [*blocks[1:], None]):
            for part in lots[block]:
                read.setdefault(part, []).extend(json.loads(self.open.getValue((block, part))[0]))
                self.open.removeKey((block, part))
            # up to the next lot, all rows have been read
            end = now + 1 if next_block is None else min(now + 1, next_block * BLOCK)
            closed = []
            for part in sorted(read):
                some = read.pop(part)
                n = bisect_left(some, end, key=lambda r: r[0])
                closed += some[:n]
                if n < len(some):
                    read[part] = some[n:]
            closed.sort(key=lambda r: (r[0], [(r[1][i] is not None, r[1][i]) for i in order]))
            columns = {c: _column(v) for c, v in zip(p.columns, zip(*[r for _, r in closed], strict=True))}
            starts = [i for i, r in enumerate(closed) if not i or r[0] != closed[i - 1][0]]
            for i, j in zip(starts, [*starts[1:], len(closed)]):
                frame = closed[i][0]
                if len(out) >= OUT and frame // BLOCK != closed[i - 1][0] // BLOCK:
                    yield self._table(key, out)
                    out = []
                out += machine.wake(frame - 1)
                out += machine.step(frame, {c: v[i:j] for c, v in columns.items()})
            if len(out) >= OUT:
                yield self._table(key, out)
                out = []
        for part, some in read.items():
            self._put(part, some)
        next_frame = min([some[0][0] for some in read.values()] + [block * BLOCK for block in blocks[unread:]], default=None)
        due = machine.due()
        if due is not None and due <= now:
            out += machine.wake(now)
            due = machine.due()
        state = machine.state()
        if state is None:
            self.machine.clear()
        else:
            self.machine.update((json.dumps(state, default=_plain),))
        if next_frame is None:
            self.parts.clear()
        self._call(min([f for f in (next_frame, due) if f is not None], default=None), list(self.handle.listTimers()))
        if out:
            yield self._table(key, out)

    def _table(self, key, out: list[tuple]) -> pd.DataFrame:
        cells = np.empty((len(self.names) - 1, len(out)), object)
        for i, column in enumerate(zip(*out, strict=True)):
            cells[i] = np.fromiter(column, object, len(out))
        table = pd.DataFrame(cells.T, columns=self.names[1:], copy=False)
        table.insert(0, self.p.key, key[0])
        return table


def _column(values: tuple):
    """A column as run_batch hands it over."""
    kinds = set(map(type, values))
    if kinds and kinds <= {int, float}:
        return np.array(values, float if float in kinds else np.int64)
    return list(values)


def run_stream(rows: DataFrame, p: Pass, lateness: int = 0) -> DataFrame:
    """run_batch over a stream. A frame is stepped once the watermark has passed it, `lateness` frames behind the latest frame that any key has shown; until then its rows may come in any order and any micro-batch. Later rows are dropped, and counted by the query's progress (numRowsDroppedByWatermark).

    A key's state is its machine and the rows of its open frames; a machine that is idle says so by its
    due frame and keeps only what it must. The query needs the RocksDB state store (see stateful).
    """
    kind = rows.schema[p.key].dataType.simpleString()
    out = StructType.fromDDL(f"{p.key} {kind}, {p.out}")
    rows = rows.where(F.col(p.frame).isNotNull()).select(p.key, F.col(p.frame).cast("long").alias(p.frame), *p.columns, frame_time(F.col(p.frame)).alias("_at"))
    timed = rows.withWatermark("_at", f"{lateness * FRAME_MS} milliseconds")
    return timed.groupBy(p.key).transformWithStateInPandas(_Clock(p, out.names), out, "append", "eventTime")


def stateful(spark: SparkSession) -> None:
    """The session's streams that start from now on keep their state in RocksDB, as timers and lists of state want it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
