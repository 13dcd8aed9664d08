"""Points met with views by cells against each point tested with each polygon; exits against probes one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import coverage


def star(r, x, y, corners, reach):
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + r.uniform(0.2, 1) * reach * math.cos(t), y + r.uniform(0.2, 1) * reach * math.sin(t)) for t in turns]


def holds(polygon, x, y):
    out = False
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            out = not out
    return out


@pytest.fixture(scope="module")
def scene(spark):
    r = random.Random(12)
    views = {c: star(r, r.uniform(-200, 200), r.uniform(-200, 200), r.choice([3, 4, 7, 30]), r.choice([5, 60, 150])) for c in range(12)}
    views[12] = [(-40.0, -40.0), (40.0, -40.0), (40.0, 40.0), (-40.0, 40.0)]  # edges along those of cells
    views[13] = [(0.0, 0.0), (1.0, 1.0)]  # no polygon
    points = [(i, r.uniform(-350, 350), r.uniform(-350, 350), float(r.randint(-2, 2)), float(r.randint(-2, 2))) for i in range(400)] + [(400, 10.0, 10.0, 1.0, 0.0), (400, 10.0, 10.0, 1.0, 0.0)]
    v = spark.createDataFrame([(c, 0.0, [{"x": x, "y": y} for x, y in p]) for c, p in views.items()], "camera long, yaw double, polygon array<struct<x:double,y:double>>")
    return views, points, v, spark.createDataFrame(points, "target long, tx double, ty double, vx double, vy double")


def test_cells_equal_every_test(scene):
    views, points, v, p = scene
    got = sorted((r.target, r.camera) for r in coverage._seen(p, v, "tx", "ty").collect())
    assert got == sorted((i, c) for i, x, y, _, _ in points for c, poly in views.items() if len(poly) > 2 and holds(poly, x, y))


def test_few_cells_are_tested(scene):
    """Whole cells lie inside, and cells beyond the border aren't there."""
    views, _, v, _ = scene
    for r in coverage.view_cells(v).collect():
        x, y = (r.gx + 0.5) * coverage.CELL, (r.gy + 0.5) * coverage.CELL
        assert not r.whole or holds(views[r.camera], x, y)
    big = coverage.view_cells(v.where("camera = 12")).groupBy().agg(F.count_if("whole").alias("whole"), F.count(F.lit(1)).alias("n")).first()
    assert big.whole == 4 and big.n <= 4 + 32


def test_within(scene):
    _, points, v, p = scene
    cams = v.select("camera", F.expr("polygon[0].x").alias("x"), F.expr("polygon[0].y").alias("y"))
    want = sorted((i, c.camera) for i, x, y, _, _ in points for c in cams.collect() if math.hypot(x - c.x, y - c.y) <= 90)
    assert sorted((r.target, r.camera) for r in coverage._within(p, cams, "tx", "ty", 90.0).collect()) == want


def test_kept(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k long, ok boolean")
    assert [r.k for r in coverage.kept(df, "ok").collect()] == [1]
