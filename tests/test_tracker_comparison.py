"""The comparison of trackers counts what each gives alone, with a run over the streams of its own each."""

from collections import defaultdict

from skyledger.operators import trackers
from skyledger.sources import views


def test_against_each_alone(spark):
    sf = "/root/testdata/sf0.001"
    d = views.detections(spark, sf).select("stream", "detection", "object").collect()
    of = {(r.stream, r.detection): r.object for r in d}
    found = trackers.tracker_comparison(spark, sf)
    got = {r.tracker: (r.tracks, r.matched, r.pure) for r in found.collect()}
    for kind in trackers.KINDS:
        seen = defaultdict(list)
        for r in trackers.track(views.detections(spark, sf), trackers.TrackerParams(kind)).where("detection is not null").collect():
            seen[r.stream, r.track_id].append(of[r.stream, r.detection])
        assert got[kind] == (len(seen), sum(map(len, seen.values())), sum(len(set(v)) == 1 for v in seen.values()))
    assert set(got) == set(trackers.KINDS)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == len(trackers.KINDS)
