"""Core queries against DuckDB, and greedy matching against a plain loop."""

import glob
import os

import duckdb
import pytest

from skyledger.plans import catalog

SF = "/root/testdata/sf0.001"


def normal(rows):
    return sorted(tuple("" if v is None else repr(round(float(v), 6)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert normal([tuple(r[c] for c in cols) for r in got]) == normal(want.select(*cols).fetchall())


def test_greedy_match(spark):
    pairs = catalog.QUERIES["iou_pairs"](spark, SF).collect()
    want, used = [], set()
    for r in sorted(pairs, key=lambda r: (r.l_orderkey, -r.iou, r.gt_id, r.pred_id)):
        if not {(r.l_orderkey, "g", r.gt_id), (r.l_orderkey, "p", r.pred_id)} & used:
            used |= {(r.l_orderkey, "g", r.gt_id), (r.l_orderkey, "p", r.pred_id)}
            want.append((r.l_orderkey, r.gt_id, r.pred_id))
    got = catalog.QUERIES["greedy_match"](spark, SF).collect()
    assert sorted(want) == sorted((r.l_orderkey, r.gt_id, r.pred_id) for r in got)


def test_camera_round_trip(spark):
    """A pixel below the horizon goes to the ground and back; one above has no ground point."""
    from pyspark.sql import functions as F

    from skyledger.functions import cameras

    k = [F.lit(v) for v in (900.0, 500.0, 400.0, 75.0, -15.0)]
    df = spark.createDataFrame([(640.0, 700.0), (10.0, 390.0), (500.0, 20.0)], "x double, y double")
    gx, gy = cameras.on_plane(cameras.ray(F.col("x"), F.col("y"), *k), (F.lit(3.0), F.lit(-2.0), F.lit(25.0)), F.lit(0.0))
    px, py = cameras.to_pixel(gx - 3, gy + 2, F.lit(-25.0), *k)
    got = df.select(gx.alias("gx"), px.alias("px"), py.alias("py"), cameras.bearing(F.lit(0.0), F.lit(-1.0)).alias("south"), cameras.field_of_view(F.lit(1800.0), F.lit(900.0)).alias("fov")).collect()
    assert [round(v, 6) for v in (got[0].px, got[0].py, got[1].px, got[1].py)] == [640, 700, 10, 390]
    assert got[2].gx is None and got[0].south == -180 and abs(got[0].fov - 90) < 1e-9
