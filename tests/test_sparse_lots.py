"""A key of few rows in many blocks lies in a few lots, and is stepped as its rows come, however the watermark cuts them."""

from types import SimpleNamespace

import pandas as pd
import pytest

from skyledger.operators import passes
from test_clock_blocks import Echo, Handle


@pytest.mark.parametrize("stops", [[4000], [100, 101, 130, 2000, 4000], list(range(0, 4001, 37))])
def test_few_calls_and_all_rows(stops):
    clock, handle, calls = passes._Clock(passes.Pass(Echo, ("n",), ("n",), "frame long, n long", "key"), ["key", "frame", "n"]), Handle(), []
    put = handle.map.updateValue
    handle.map.updateValue = lambda k, v: (calls.append(k), put(k, v))
    clock.init(handle)
    rows = [(f * 57 % 4000, n) for n, f in enumerate(range(70))] + [(128, n) for n in range(400, 100, -1)]
    assert not list(clock.handleInputRows(("k",), iter([pd.DataFrame(rows[:70], columns=["frame", "n"])]), None))
    # 70 rows in some sixty blocks
    assert len(calls) == 1
    assert not list(clock.handleInputRows(("k",), iter([pd.DataFrame(rows[70:], columns=["frame", "n"])]), None))
    assert len(calls) == 2
    got = []
    for stop in stops:
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda stop=stop: stop * passes.FRAME_MS + passes.FIRST_MS)
        if min(handle.timers, default=1e18) > at.getCurrentWatermarkInMs():
            continue
        handle.timers.clear()
        got += [(r.frame, r.n) for t in clock.handleExpiredTimer(("k",), at, None) for r in t.itertuples()]
        assert got == [r for r in sorted(rows) if r[0] <= stop]
        assert min(handle.timers, default=1e18) > at.getCurrentWatermarkInMs()
    assert got == sorted(rows) and not handle.rows and not handle.timers
