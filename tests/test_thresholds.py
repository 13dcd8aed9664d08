"""Matches and switches at every threshold from matches ordered once, against a loop over each threshold."""

import random

from skyledger.operators import scores


def test_each_threshold(spark):
    r = random.Random(5)
    rows = [(s, "ir", f, g, r.randrange(3), r.choice([0.5, 0.62, 0.75, 0.8, 0.95, 1.0])) for s in ("a", "b") for f in range(40) for g in range(3) if r.random() < 0.8]
    want = {}
    for t in scores.THRESHOLDS:
        last = {}
        for s, _, f, g, p, iou in sorted(rows):
            if iou >= t:
                tp, sw = want.get((s, t), (0, 0))
                was = last.get((s, g))
                want[s, t] = tp + 1, sw + (was is not None and was[0] == f - 1 and was[1] != p)
                last[s, g] = f, p
    m = spark.createDataFrame(rows, "sequence_id string, modality string, frame_index int, gt_id int, pred_id int, iou double")
    got = {(x.sequence_id, x.threshold): (x.tp, x.idsw) for x in scores.threshold_counts(m).collect()}
    assert got == want and any(sw for _, sw in want.values())


def test_matches_ordered_once(spark):
    """The exchange that orders matches has no column of thresholds."""
    plan = scores.hota(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x and "threshold" in x]
