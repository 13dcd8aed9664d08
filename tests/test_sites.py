"""Cameras of a site against places worked out one by one."""

import math

import pytest

from skyledger.operators import sites


def along(width, depth, n, of):
    left = 2 * (width + depth) * (n + 0.5) / of
    for (ax, ay), (bx, by) in (((0, 0), (width, 0)), ((width, 0), (width, depth)), ((width, depth), (0, depth)), ((0, depth), (0, 0))):
        side = abs(bx - ax) + abs(by - ay)
        if left <= side:
            return ax + (bx - ax) * left / side, ay + (by - ay) * left / side
        left -= side


def test_places(spark):
    width, depth = 1200.0, 700.0
    rows = [(r, n, of, width, depth) for r, of in (("perimeter", 40), ("interior", 44), ("moving", 16), ("perimeter", 1)) for n in range(of)] + [(None, 0, 1, None, None)]
    got = sites.place(spark.createDataFrame(rows, "role string, n long, of long, width double, depth double")).collect()
    assert sum(r.width is not None for r in got) == 101
    for r in (r for r in got if r.width):
        if r.role == "perimeter":
            assert (r.x, r.y) == pytest.approx(along(width, depth, r.n, r.of))
        elif r.role == "interior":
            columns = math.ceil(math.sqrt(44 * width / depth))
            lines = math.ceil(44 / columns)
            assert (r.x, r.y) == pytest.approx((150 + 900 * (r.n % columns + 0.5) / columns, 150 + 400 * (r.n // columns + 0.5) / lines))
        else:
            assert math.hypot((r.x - 600) / 408, (r.y - 350) / 238) == pytest.approx(1)
        assert r.yaw == pytest.approx(math.degrees(math.atan2(600 - r.x, 350 - r.y)) % 360, abs=0.006) and r.pitch == sites.PITCH[r.role]
    assert [r.x for r in got if r.width is None] == [None]


def test_nodes_are_even(spark):
    rows = sites.site_cameras(spark, "/root/testdata/sf0.01").collect()
    for site in {r.site for r in rows}:
        load = {}
        for r in rows:
            if r.site == site:
                load[r.node] = load.get(r.node, 0) + 1
        assert max(load.values()) - min(load.values()) <= 1
