"""Lenses and roll against matrix algebra."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from skyledger.functions import cameras as c
from skyledger.operators import lenses


def rotation(yaw, pitch, roll):
    a, t, o = math.radians(yaw), math.radians(pitch - 90), math.radians(roll)
    turn = np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]])
    tip = np.array([[1, 0, 0], [0, math.cos(t), -math.sin(t)], [0, math.sin(t), math.cos(t)]])
    tilt = np.array([[math.cos(o), 0, math.sin(o)], [0, 1, 0], [-math.sin(o), 0, math.cos(o)]])
    return turn @ tip @ tilt


def test_round_trip_and_matrices(spark):
    r = random.Random(9)
    rows = [(r.uniform(0, 1920), r.uniform(0, 1080), r.uniform(-5, 5), 3.0, r.uniform(5, 9), r.uniform(-180, 360), r.uniform(-40, 10), r.uniform(-30, 30), -0.03 * r.random(), 0.005 * r.random(), 0.001 * r.random(), -0.001 * r.random(), 0.0005 * r.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "px double, py double, x double, y double, z double, yaw double, pitch double, roll double, k1 double, k2 double, p1 double, p2 double, k3 double")
    down = 0
    for g in lenses.on_ground(df).collect():
        ray, m = np.array([g.ray_x, g.ray_y, g.ray_z]), rotation(g.yaw, g.pitch, g.roll)
        own = m.T @ ray
        u, v = own[:2] / own[2]
        q = u * u + v * v
        bend = 1 + g.k1 * q + g.k2 * q**2 + g.k3 * q**3
        shown = (u * bend + 2 * g.p1 * u * v + g.p2 * (q + 2 * u * u)) * lenses.FX + lenses.CX, (v * bend + g.p1 * (q + 2 * v * v) + 2 * g.p2 * u * v) * lenses.FY + lenses.CY
        assert np.allclose(shown, (g.px, g.py), atol=1e-5) and abs(np.linalg.norm(ray) - 1) < 1e-12
        if g.ground_x is not None:
            down += 1
            assert ray[2] < 0 and np.allclose([g.x, g.y] + ray[:2] * (-g.z / ray[2]), [g.ground_x, g.ground_y]) and np.allclose((g.back_px, g.back_py), (g.px, g.py), atol=1e-4)
        else:
            assert ray[2] > -1e-6
    assert 100 < down < 300


def test_a_lens_without_bend(spark):
    none = ("0", "0", "0", "0", "0")
    row = spark.createDataFrame([(0.3, -0.2), (None, 1.0)], "x double, y double").select(c.undistort("x", "y", none).alias("u"), c.distort("x", "y", none).alias("d")).collect()
    assert tuple(row[0].u) == tuple(row[0].d) == (0.3, -0.2) and row[1].u.x is None
    flat = spark.range(1).select(*c.turned(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(90.0), F.lit(0.0), F.lit(0.0))).first()
    assert np.allclose(tuple(flat), (1, 0, 0))


def test_query_comes_back_to_its_pixels(spark):
    rows = lenses.lens_positions(spark, "/root/testdata/sf0.001").collect()
    assert {r.off for r in rows} == {0, None}
