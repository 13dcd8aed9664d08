"""Streams whose frames are split over micro-batches, come out of order, too late or not at all, against the batch; machines restored from their state; a filter bank against single filters."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import fusion, passes, trackers
from skyledger.sources import views
from skyledger.streaming.edge import drain

SCHEMA = "stream long, frame long, detection long, x1 double, y1 double, x2 double, y2 double, confidence double"


def detections(streams=2, frames=14, objects=4):
    r = random.Random(11)
    out = []
    for s in range(streams):
        for f in range(frames):
            for o in range(objects):
                if r.random() < 0.85:
                    x, y = 100.0 * o + 3 * f + r.random(), 50.0 * s + r.random()
                    out.append((s, f, 1000 * s + 10 * f + o, x, y, x + 40, y + 30, round(0.3 + 0.7 * r.random(), 3)))
    return out


def fed(spark, path, parts, schema):
    """A stream that reads one part a micro-batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_frames_split_over_files(spark, tmp_path):
    """The second file begins inside a frame, the third holds earlier frames again and one stream alone: what the watermark has passed equals the batch."""
    rows = detections()
    early, late = [r for r in rows if r[1] < 7], [r for r in rows if r[1] >= 7]
    held = [r for r in early if r[1] in (5, 6) and r[2] % 10 == 2]
    parts = [[r for r in early if r not in held and not (r[1] == 6 and r[2] % 10 == 3)], held + [r for r in early if r[1] == 6 and r[2] % 10 == 3] + [r for r in late if r[1] < 9], [r for r in late if r[1] >= 9]]
    random.Random(3).shuffle(parts[2])
    assert sorted(sum(parts, [])) == sorted(rows)
    got = drain(trackers.track_stream(fed(spark, f"{tmp_path}/in", parts, SCHEMA), lateness=3), "append").collect()
    want = trackers.track(spark.createDataFrame(rows, SCHEMA)).collect()
    top = max(r[1] for r in rows) - 3
    assert same(got) == same(r for r in want if r.frame <= top) and {r.frame for r in got} >= set(range(top))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    box = lambda f, d: (1, f, d, 0.0, 0.0, 40.0, 30.0, 0.9)
    parts = [[box(0, 1), box(1, 2)], [box(2, 3), box(9, 4)], [box(1, 5), box(10, 6)], [box(2, 7), box(11, 8)]]
    stream = trackers.track_stream(fed(spark, f"{tmp_path}/in", parts, SCHEMA), lateness=2)
    passes.stateful(spark)
    seen = []
    q = stream.writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    # the third file's row of frame 1 comes in time, as that frame had not been stepped yet
    assert dropped == 1
    kept = [box(0, 1), box(1, 2), box(2, 3), box(9, 4), box(1, 5), box(10, 6), box(11, 8)]
    want = [r for r in trackers.track(spark.createDataFrame(kept, SCHEMA)).collect() if r.frame <= 9]
    assert same(seen) == same(want)


def test_idle_streams_lose_their_state(spark, tmp_path):
    """A stream that shows nothing more is carried on until its tracks die; then only a number is left, and later tracks go on from it."""
    box = lambda s, f, d: (s, f, d, 0.0, 0.0, 40.0, 30.0, 0.9)
    p = trackers.TrackerParams(max_age=4)
    parts = [[box(1, 0, 1), box(2, 0, 2)], [box(2, 20, 3)], [box(1, 30, 4), box(2, 31, 5)]]
    rows = sum(parts, [])
    got = drain(trackers.track_stream(fed(spark, f"{tmp_path}/in", parts, SCHEMA), p), "append").collect()
    # what is carried on comes with the next frame or the end of the last track
    want = [r for r in trackers.track(spark.createDataFrame(rows, SCHEMA), p, until=31).collect() if (r.stream, r.frame) != (1, 31)]
    assert same(got) == same(want) and {(r.frame, r.track_id) for r in got if r.stream == 1} == {*((f, 1) for f in range(5)), (30, 2)}
    m = trackers.StreamTracker(p)
    m.step(0, {"detection": np.array([1]), "confidence": np.array([0.9]), **{c: np.array([v]) for c, v in zip(("x1", "y1", "x2", "y2"), (0.0, 0.0, 4.0, 3.0))}})
    assert m.due() == 5 and len(m.wake(5)) == 4 and m.due() is None and m.state() == {"next": 2}


def test_restored_machines_go_on(spark):
    """A machine that is put away after each frame gives the same rows."""
    import json

    rows = detections(1, 20)
    def frames(make):
        out, state = [], None
        for f in sorted({r[1] for r in rows}):
            m = make()
            if state is not None:
                m.restore(json.loads(state))
            own = [r for r in rows if r[1] == f]
            columns = dict(zip(("detection", "x1", "y1", "x2", "y2", "confidence"), (np.array(c) for c in list(zip(*own))[2:])))
            columns["embedding"] = [np.array([1.0, r[2] % 3]) for r in own]
            columns |= {"observation": columns["detection"], "camera": columns["detection"] % 3, "node": columns["detection"] % 2, "x": columns["x1"] / 10, "y": columns["y1"] / 10}
            out += m.wake(f - 1) + m.step(f, columns)
            state = json.dumps(m.state(), default=passes._plain) if make.keep else None
            if not make.keep:
                m_ = m
                make.m = m_
        return out

    class Fresh:
        keep = True

        def __init__(self, make):
            self.make = make

        def __call__(self):
            return self.make()

    class Same:
        keep, m = False, None

        def __init__(self, make):
            self.m = make()

        def __call__(self):
            return self.m

    for make in (lambda: trackers.StreamTracker(trackers.TrackerParams("botsort"), ("embedding",)), lambda: fusion.SiteFusion(fusion.FusionParams(), True)):
        a, b = frames(Fresh(make)), frames(Same(make))
        assert a and same(a) == same(b)


def test_fusion_in_batch_and_stream(spark, tmp_path):
    d = views.ground_sightings(spark, "/root/testdata/sf0.001").where("frame < 9")
    rows = [tuple(r) for r in d.collect()]
    random.Random(2).shuffle(rows)
    parts = [[r for r in rows if r[1] < 6 and i == r[2] % 2] + [r for r in rows if r[1] >= 6 and i == 1] for i in (0, 1)]
    got = drain(fusion.fuse_stream(fed(spark, f"{tmp_path}/in", parts, d.schema), lateness=8), "append").collect()
    want = fusion.fuse(d).collect()
    assert got == [] or same(got) == same(r for r in want if r.frame <= 0)
    assert same(drain(fusion.fuse_stream(fed(spark, f"{tmp_path}/one", [rows], d.schema)), "append").collect()) == same(want)


def test_bank_equals_single_filters():
    p, r = fusion.FusionParams(), np.random.default_rng(4)
    bank, one = fusion.Bank(p), []
    for n in range(5):
        at = r.normal(size=2) * 9
        bank.add(n + 1, at)
        one.append(fusion.Filter(at, p))
    for step in range(30):
        bank.predict(1 + step % 3)
        for f in one:
            for _ in range(1 + step % 3):
                f.predict()
        k, seen = step % 5, r.normal(size=2) * 9
        bank.update(k, seen)
        one[k].update(seen)
        assert np.allclose(bank.at, [f.at for f in one]) and np.allclose(bank.velocity, [f.velocity for f in one]) and np.allclose(bank.pcv, [[f.p, f.c, f.v] for f in one])
    assert np.allclose(bank.radii(), [f.radius() for f in one]) and bank.time_to_radius(2, 50.0) == pytest.approx(one[2].time_to_radius(50.0))


def test_near_finds_all_within_reach():
    bank, r = fusion.Bank(fusion.FusionParams()), np.random.default_rng(8)
    for n in range(60):
        bank.add(n + 1, r.uniform(-300, 300, 2))
    points = r.uniform(-300, 300, (20, 2))
    rows, ks = bank.near(points, 40.0)
    met = set(zip(rows.tolist(), ks.tolist()))
    assert {(i, k) for i in range(60) for k in range(20) if np.hypot(*(bank.at[i] - points[k])) <= 40} <= met and len(met) < 60 * 20 / 3


def test_keys_and_frames_over_arrow_batches(spark):
    """Frames that end within a batch, keys of one row, null keys and frames."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = detections(3, 6) + [(None, 0, 7, 0.0, 0.0, 9.0, 9.0, 0.9), (5, None, 8, 0.0, 0.0, 9.0, 9.0, 0.9), (6, 4, 9, 0.0, 0.0, 9.0, 9.0, 0.9)]
        got = trackers.track(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = trackers.track(spark.createDataFrame(rows, SCHEMA)).collect()
    assert same(got) == same(want) and {r.stream for r in got} == {0, 1, 2, 6, None}


def test_all_trackers_in_one_pass(spark):
    df = spark.createDataFrame(detections(), SCHEMA).withColumn("embedding", F.array(F.lit(1.0), (F.col("detection") % 10).cast("double")))
    got = trackers.track_all(df).collect()
    for kind in trackers.KINDS:
        assert same(tuple(v for n, v in r.asDict().items() if n != "tracker") for r in got if r.tracker == kind) == same(trackers.track(df, trackers.TrackerParams(kind)).collect())
