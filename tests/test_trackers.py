"""Assignment against all permutations; trackers on scenes whose outcome is known; the stream against the batch."""

import itertools

import numpy as np
import pytest

from skyledger.operators import trackers
from skyledger.operators.assignment import assign, carried, cosines, fused, overlaps


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (5, 2), (4, 4), (6, 5)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for trial in range(30):
        c = rng.random(shape) if trial % 2 else rng.integers(0, 3, shape) / 2
        small, large = min(shape), max(shape)
        m = c if shape[0] <= shape[1] else c.T
        best = min(sum(m[i, k] for i, k in enumerate(p)) for p in itertools.permutations(range(large), small))
        got = assign(c, 9)
        assert len(got) == small and sum(x for _, _, x in got) == pytest.approx(best)
        assert len({r for r, _, _ in got}) == len({k for _, k, _ in got}) == small
        assert [x for _, _, x in got] == sorted(x for _, _, x in got)
    assert assign(np.zeros((0, 3))) == [] and assign(np.array([[0.9]]), 0.8) == []


def test_costs():
    assert overlaps([[0, 0, 10, 10]], [[5, 0, 15, 10], [20, 20, 20, 20]]).tolist() == [[pytest.approx(1 / 3), 0]]
    assert cosines([None, [1, 0]], [[0, 2], None, [3, 0]]).tolist() == [[1, 1, 1], [0, 1, 1]]
    assert fused(np.array([0.4]), None).tolist() == [0.4] and fused(np.array([0.4]), np.array([0.8])).tolist() == [pytest.approx(0.5)]
    assert carried([[0, 0, 2, 2]], [[1, 0, 5], [0, 1, 7], [0, 0, 1]]).tolist() == [[5, 7, 7, 9]]
    assert carried([[0, 0, 2, 2]], [[1, 0, 0], [0, 1, 0], [0, 0, 0]]).tolist() == [[0, 0, 0, 0]]


def run(kind, frames, **how):
    t = trackers.FrameTracker(trackers.TrackerParams(kind, **how))
    out = []
    for i, f in enumerate(frames):
        box, conf, vec = zip(*[(*x, None)[:3] for x in f], strict=True) if f else ([], [], [])
        t.step(i, box, conf, None, vec)
        out.append([(x.id, x.state, x.hits, x.misses) for x in t.tracks])
    return out


def at(x, y=0.0):
    return (x, y, x + 40.0, y + 30.0)


def test_lifecycle():
    out = run("sort", [[(at(0), 0.9)], [(at(14), 0.9)], [(at(28), 0.9)], [], [(at(56), 0.9)]])
    assert out[0] == [(1, "tentative", 1, 0)] and out[2] == [(1, "confirmed", 3, 0)]
    assert out[3] == [(1, "lost", 3, 1)]
    assert run("sort", [[(at(0), 0.9)]] + [[]] * 5, max_age=3)[-1] == []
    assert run("sort", [[(at(0), 0.5)]]) == [[]]


def test_prediction_keeps_a_fast_target():
    fast = [[(at(30.0 * i), 0.9)] for i in range(8)]
    assert {x[0] for f in run("sort", fast, match=0.9)[2:] for x in f} == {1}
    jumps = [[(at(0), 0.9)], [(at(20.0), 0.9)], [(at(20.0 + 35), 0.9)], [(at(20.0 + 35 + 39), 0.9)]]
    assert run("sort", jumps)[-1][0][2] == 4 and len(run("iou", jumps)[-1]) > 1


def test_low_scores_rescue_but_start_nothing():
    frames = [[(at(0), 0.9)], [(at(2), 0.9)], [(at(4), 0.9)], [(at(6), 0.3)], [(at(300), 0.3)]]
    assert run("bytetrack", frames)[3] == [(1, "confirmed", 4, 0)] and run("sort", frames)[3] == [(1, "lost", 3, 1)]
    assert len(run("bytetrack", frames)[4]) == 1
    # a track of one hit is not rescued
    assert run("bytetrack", [[(at(0), 0.9)], [(at(0), 0.3)]])[1] == [(1, "tentative", 1, 1)]


def test_contradicting_looks_are_refused():
    frames = [[(at(0), 0.9, [1, 0])], [(at(1), 0.9, [0, 1])]]
    assert [x[0] for x in run("botsort", frames)[1]] == [1, 2] and [x[0] for x in run("bytetrack", frames)[1]] == [1]
    assert [x[0] for x in run("botsort", [[(at(0), 0.9)], [(at(1), 0.9)]])[1]] == [1]


def test_camera_motion_is_no_velocity():
    t = trackers.FrameTracker(trackers.TrackerParams())
    pan = [[1, 0, 200], [0, 1, 0], [0, 0, 1]]
    t.step(0, [at(0)], [0.9])
    t.step(1, [at(203)], [0.9], motion=pan)
    assert len(t.tracks) == 1 and t.tracks[0].velocity.tolist() == [3, 0]


def test_unknown_tracker():
    with pytest.raises(ValueError):
        trackers.TrackerParams("nvdcf")


def test_batch_and_stream_agree(spark):
    sf = "/root/testdata/sf0.001"
    batch = {tuple(r) for r in trackers.bytetrack_tracks(spark, sf).select("stream", "frame", "track_id", "detection", "state", "hits").collect()}
    assert batch and {tuple(r) for r in trackers.stream_tracks(spark, sf).collect()} == batch


def test_gaps_are_misses(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 40.0, 30.0, 0.9), (1, 3, 1, 1.0, 0.0, 41.0, 30.0, 0.9), (2, 10**9, 2, 0.0, 0.0, 9.0, 9.0, 0.9), (2, 0, 3, 0.0, 0.0, 9.0, 9.0, 0.9)]
    df = spark.createDataFrame(rows, "stream long, frame long, detection long, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = trackers.track(df).collect()
    assert [(r.frame, r.track_id, r.misses, r.detection) for r in sorted(got, key=lambda r: r.frame) if r.stream == 1] == [(0, 1, 0, 0), (1, 1, 1, None), (2, 1, 2, None), (3, 1, 0, 1)]
    assert {r.track_id for r in got if r.stream == 2} == {1, 2}
    assert trackers.track(df.limit(0)).count() == 0


def test_replay_against_a_plain_loop(spark):
    """A switch after a miss is none; frames of one side alone count."""
    box = lambda x: (float(x), 0.0, x + 10.0, 10.0)
    truth = [(1, f, 0, *box(0)) for f in range(6)] + [(1, f, 1, *box(50)) for f in range(3)]
    found = [(1, 0, 7, *box(0)), (1, 1, 8, *box(1)), (1, 3, 9, *box(0)), (1, 4, 9, *box(0)), (1, 9, 9, *box(0)), (1, 0, 5, *box(50)), (1, 1, 5, *box(90)), (2, 0, 1, *box(0))]
    schema = "stream long, frame long, {} long, x1 double, y1 double, x2 double, y2 double"
    got = {r.stream: r for r in trackers.replayed(spark.createDataFrame(truth, schema.format("object")), spark.createDataFrame(found, schema.format("track_id"))).collect()}
    r = got[1]
    # object 0: 7, 8, -, 9, 9, -; object 1: 5, -, -
    assert (r.gt, r.pred, r.tp, r.idsw, r.fragments) == (9, 7, 5, 1, 3)
    assert r.mota == pytest.approx(1 - (4 + 2 + 1) / 9) and r.idf1 == pytest.approx(10 / 16)
    assert (got[2].gt, got[2].pred, got[2].mota, got[2].idsw) == (0, 1, 0.0, 0)


def test_replay_scores(spark):
    got = {r.tracker: r for r in trackers.replay_scores(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(trackers.KINDS) and len({r.gt for r in got.values()}) == 1 and all(r.mota <= 1 for r in got.values())
    assert got["bytetrack"].tp >= got["sort"].tp > 0
