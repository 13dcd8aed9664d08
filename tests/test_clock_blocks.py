"""A micro-batch of many frames is stepped block by block: no more than a block's rows are read at a time, and what comes out is handed on as it comes."""

from types import SimpleNamespace

import pandas as pd

from skyledger.operators import passes


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Handle:
    def __init__(self):
        self.timers, self.rows = set(), {}
        self.map = SimpleNamespace(keys=lambda: iter(self.rows), getValue=self.rows.get, updateValue=self.rows.__setitem__, removeKey=self.rows.pop)

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return self.map

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Echo:
    wake = staticmethod(lambda frame: [])
    due = staticmethod(lambda: None)
    state = staticmethod(lambda: None)

    def step(self, frame, rows):
        return [(frame, int(n)) for n in rows["n"]]


def test_block_by_block(monkeypatch):
    monkeypatch.setattr(passes, "OUT", 1)
    clock, handle = passes._Clock(passes.Pass(Echo, ("n",), ("n",), "frame long, n long", "key"), ["key", "frame", "n"]), Handle()
    clock.init(handle)
    rows = [(f, n) for n in (2, 1) for f in range(5 * passes.BLOCK)]
    assert not list(clock.handleInputRows(("k",), iter([pd.DataFrame(rows[i:i + 100], columns=["frame", "n"]) for i in range(0, len(rows), 100)]), None))
    at = lambda frame: SimpleNamespace(getCurrentWatermarkInMs=lambda: frame * passes.FRAME_MS + passes.FIRST_MS)
    early = list(clock.handleExpiredTimer(("k",), at(3 * passes.BLOCK + 9), None))
    assert [len(t) for t in early] == [2 * passes.BLOCK] * 3 + [20]
    assert handle.timers == {(3 * passes.BLOCK + 10) * passes.FRAME_MS + passes.FIRST_MS}
    handle.timers.clear()
    late = list(clock.handleExpiredTimer(("k",), at(9 * passes.BLOCK), None))
    assert [(r.frame, r.n) for t in early + late for r in t.itertuples()] == sorted(rows)
    assert not handle.rows and not handle.timers
