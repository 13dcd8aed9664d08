"""Trackers over one stream are tasks of their own over one exchange, and a frame's few boxes are assigned as many are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import assignment, trackers
from skyledger.sources import views


def test_each_tracker_has_its_task(spark):
    d = views.detections(spark, "/root/testdata/sf0.001").where("stream = 3")
    found = trackers.track_all(d).withColumn("task", F.spark_partition_id())
    rows = found.collect()
    assert {r.tracker for r in rows} == set(trackers.KINDS) and len({r.task for r in rows}) == len(trackers.KINDS)
    # detections are exchanged once
    assert found._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= len(trackers.KINDS) - 1
    one = trackers.track(d, trackers.TrackerParams("botsort")).collect()
    key = lambda r: (r.frame, r.track_id)
    mine = [r for r in rows if r.tracker == "botsort"]
    assert [r[2:-1] for r in sorted(mine, key=key)] == [r[1:] for r in sorted(one, key=key)]


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (4, 4), (5, 9), (12, 48)])
def test_few_boxes_as_many(shape):
    rng = np.random.default_rng(shape[1])
    for trial in range(40):
        c = rng.random(shape) if trial % 2 else rng.integers(0, 3, shape) / 2
        assert assignment._few_holders(c.tolist()) == assignment._holders(c).tolist()


def test_many_boxes(monkeypatch):
    c = np.random.default_rng(1).integers(0, 4, (30, 70)) / 3
    many = assignment.assign(c)
    monkeypatch.setattr(assignment, "FEW", 100)
    assert len(many) == 30 and assignment.assign(c) == many
