"""A stream's run by a tracker is a task of its own however few partitions there are; what a comparison needs comes out of the machine without a join; plain numbers give what arrays do."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyledger.operators import assignment, passes, trackers
from skyledger.sources import views

SF = "/root/testdata/sf0.001"


def test_each_stream_has_its_task(spark):
    """By hash, eight streams meet in at most the four partitions of this session."""
    found = trackers.track_all(views.detections(spark, SF)).withColumn("task", F.spark_partition_id())
    runs = found.select("tracker", "stream", "task").distinct().collect()
    assert len(runs) == 8 * len(trackers.KINDS) and len({r.task for r in runs}) == len(runs)


def test_many_streams_share_tasks(spark):
    d = views.detections(spark, SF).withColumn("stream", F.col("detection") % 300).where("frame < 3")
    found = trackers.track(d).withColumn("task", F.spark_partition_id())
    assert found.select("stream").distinct().count() > trackers.SPREAD >= found.select("task").distinct().count()
    assert found.groupBy("stream").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0


def test_comparison_without_join(spark):
    plan = trackers.tracker_comparison(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == len(trackers.KINDS)


@pytest.mark.parametrize("kind", trackers.KINDS)
def test_matches_are_those_of_tracks(spark, kind):
    d = views.detections(spark, SF)
    some, p = d.where("frame % 7 <> 2"), trackers.TrackerParams(kind)
    of = {r.detection: (r.object, r.confidence) for r in d.collect()}
    want = sorted((r.stream, r.track_id, *of[r.detection]) for r in trackers.track(some, p).where("detection is not null").collect())
    found = trackers.matches(some, ("object", "confidence"), p)
    assert found.columns == ["stream", "track_id", "object", "confidence"]
    assert want and sorted(map(tuple, found.collect())) == want


def test_costs_are_those_of_arrays():
    rng = np.random.default_rng(5)
    odd = [(0.0, 0.0, 0.0, 0.0), (5.0, 5.0, 1.0, 1.0), (3.0, 0.0, 1.0, 9.0), (0.0, float("nan"), 4.0, 4.0), (0.0, 0.0, float("inf"), 4.0), (-1e200, -1e200, 1e200, 1e200), (1.0, 1.0, 1.0 + 1e-6, 1.0 + 1e-6)]
    for _ in range(20):
        low = rng.integers(0, 20, (9, 2)).astype(float)
        some = [tuple(map(float, b)) for b in np.hstack([low, low + rng.random((9, 2)) * 12])] + odd
        with np.errstate(all="ignore"):
            assert assignment.costs(some, some[3:]) == (1 - assignment.overlaps(some, some[3:])).tolist()
    assert assignment.costs([], some) == [] and assignment.costs(some[:2], []) == [[], []]


def test_many_costs(monkeypatch):
    some = [(float(i), 0.0, i + 40.0, 30.0) for i in range(40)]
    many = assignment.costs(some, some)
    monkeypatch.setattr(assignment, "FEW_PAIRS", 10**6)
    assert assignment.costs(some, some) == many


@pytest.mark.parametrize("kind", [pa.float64(), pa.float32()])
def test_lists_of_numbers(kind):
    rows = [[1.0, 0.1], [], [3.0, None], [4.0]]
    for values in (rows, [*rows, None], []):
        one = pa.array([[9.0], *values], pa.list_(kind))
        column = pa.chunked_array([one, one.slice(1), one.slice(2, 2)])
        assert passes._values(column) == column.to_pylist() and passes._values(column.slice(3)) == column.slice(3).to_pylist()
