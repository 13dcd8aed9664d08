"""Overlaps are computed for boxes that meet alone, with the same pairs; scores of sequences read and match the boxes once."""

import itertools
import random

from pyspark.sql import functions as F

from skyledger.operators import scores, tracks

BOXES = "array<struct<box_ord:int,x1:double,y1:double,w:double,h:double>>"


def plain(gt, pred, threshold):
    def overlap(a, b):
        both = max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0) * max(min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), 0)
        union = a[3] * a[4] + b[3] * b[4] - both
        return both / union if union > 0 else 0.0

    out = []
    for k, g, p in sorted((-overlap(a, b), a[0], b[0]) for a, b in itertools.product(gt, pred)):
        if k <= -threshold and not any(g == x[1] or p == x[2] for x in out):
            out.append((k, g, p))
    return out


def test_same_pairs(spark):
    rng = random.Random(3)
    side = lambda n: [(i, float(rng.randrange(20)), float(rng.randrange(20)), float(rng.randrange(-1, 12)), float(rng.randrange(0, 12))) for i in range(n)]
    rows = [(i, side(rng.randrange(7)), side(rng.randrange(7))) for i in range(60)]
    frames = spark.createDataFrame(rows, f"id int, gt {BOXES}, pred {BOXES}")
    for threshold in (0.5, 0.05, 0.0):
        got = {r.id: [tuple(x) for x in r.pairs] for r in tracks.matched_frames(frames, threshold).collect()}
        assert got == {i: plain(gt, pred, threshold) for i, gt, pred in rows}


def test_boxes_are_read_once(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    plan = scores.corpus_scores(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    # as in the SQL, rows without a frame are in no sequence
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.unionByName(lines.limit(5).withColumn("l_orderkey", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = lambda d: sorted(map(tuple, scores.tracking_scores(spark, d).collect()))
    assert rows(str(tmp_path)) == rows(sf)
