"""Cameras of one pose and targets of one place as lots: the same rows as SQL gives, and nothing that generators make is broadcast."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skyledger.operators import coverage

SF = "/root/testdata/sf0.001"
NAMES = ("cameras_seeing", "restore_tasks", "turn_schedule", "zone_shares", "view_exits", "camera_overlaps", "handover_candidates", "search_order", "preposition_tasks", "zone_watch", "camera_views")
BY_CELLS = ("cameras_seeing", "turn_schedule", "zone_shares", "view_exits", "handover_candidates", "search_order", "preposition_tasks", "camera_overlaps")


def normal(rows):
    return sorted(tuple("" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Suppliers of equal poses and customers of equal places, three of each."""
    d, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for table, key, period in (("supplier", "s_suppkey", 9000), ("customer", "c_custkey", 21000)):
        con.execute(f"copy (select * replace ({key} + i * {period} as {key}) from '{SF}/{table}.parquet', range(3) t(i) where {key} < 60) to '{d}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{d}/{table}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", NAMES)
def test_lots_equal_sql(spark, copies, monkeypatch, name):
    """Lots of two, so that equal rows are spread over several."""
    monkeypatch.setattr(coverage, "LOT", 2)
    path, con = copies
    df = next(f for f in coverage.QUERIES if f.__name__ == name)(spark, path)
    cols = sorted(df.columns)
    want = con.sql(coverage.oracles("")[name]).select(*cols).fetchall()
    assert normal([tuple(r[c] for c in cols) for r in df.collect()]) == normal(want)


@pytest.mark.parametrize("name", BY_CELLS)
def test_no_cells_broadcast(spark, name):
    """Broadcasts are of a few rows named here: the zones' totals and the cameras that watch a zone alone."""
    df = next(f for f in coverage.QUERIES if f.__name__ == name)(spark, SF)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    most = {"zone_shares": 1, "turn_schedule": 1}.get(name, 0)
    assert plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin") <= most


def test_alike(spark):
    rows = spark.range(7).select("id", (F.col("id") % 2).alias("k")).unionByName(spark.createDataFrame([(9, None)], "id long, k long"))
    lots = {r.id: (r.k, r.ids) for r in coverage.alike(rows, "id", "k").collect()}
    assert lots == {0: (0, [0, 2, 4, 6]), 1: (1, [1, 3, 5]), 9: (None, [9])}
    assert sorted(r.id for r in coverage.each(coverage.alike(rows, "id", "k"), "id").collect()) == [0, 1, 2, 3, 4, 5, 6, 9]
