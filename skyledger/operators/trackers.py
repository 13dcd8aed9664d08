"""Frame-by-frame trackers. A stream of frames is one key: its detections pass one state machine in frame order, so streams spread over the cluster, and one stream's state is its live tracks alone."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.operators.assignment import assign, assign_batch, carried, costs, fused, unit, unit_cosines
from skyledger.operators.passes import Pass, run_batch, run_stream
from skyledger.operators.tracks import matched_frames
from skyledger.sources import views

TENTATIVE, CONFIRMED, LOST, DEAD = "tentative", "confirmed", "lost", "dead"
#: A tracker's task has one stream, or some such part of all detections in streams of few.
SPREAD = 64
#: Sides in pixels of the images whose centre the camera's shift is read at.
CENTRE = (640.0, 360.0)


@dataclass(frozen=True)
class TrackerParams:
    """kind: sort (predicted boxes), iou (measured boxes), bytetrack (sort, then low scores once more) or botsort (bytetrack with appearance). Detections of `high` or more start tracks and match first."""

    kind: str = "sort"
    high: float = 0.6
    low: float = 0.1
    match: float = 0.8
    low_scale: float = 0.5
    max_age: int = 30
    min_hits: int = 3
    class_id: int = 0
    appearance: float = 0.25
    reid: float = 0.55

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no tracker {self.kind!r}; there are {', '.join(KINDS)}")


KINDS = ("sort", "iou", "bytetrack", "botsort")


class Track:
    """A track's state: the last measured box, the velocity between the last two, and its counts. Boxes and velocities are plain numbers, as one box is too little for an array."""

    __slots__ = ("id", "box", "moved", "shown", "hits", "misses", "first", "last", "state", "confidence", "mean", "vector", "unit", "gallery", "detection", "ahead")

    def __init__(self, number: int, frame: int, box, confidence: float, vector, detection, look=None):
        self.id, self.box, self.moved, self.shown = number, box, (0.0, 0.0), box
        self.hits, self.misses, self.first, self.last, self.state = 1, 0, frame, frame, TENTATIVE
        self.confidence = self.mean = confidence
        self.vector, self.gallery, self.detection = vector, [] if vector is None else [vector], detection
        self.unit, self.ahead = look, None

    @property
    def velocity(self) -> np.ndarray:
        return np.array(self.moved)

    def plain(self) -> list:
        """The track as plain values."""
        vector = lambda v: None if v is None else list(map(float, v))
        return [self.id, list(self.box), list(self.moved), list(self.shown), self.hits, self.misses, self.first, self.last, self.state, self.confidence, self.mean, vector(self.vector), [vector(g) for g in self.gallery], self.detection]

    @classmethod
    def of(cls, values: list) -> Track:
        t = cls.__new__(cls)
        t.id, box, moved, shown, t.hits, t.misses, t.first, t.last, t.state, t.confidence, t.mean, t.vector, t.gallery, t.detection = values
        t.box, t.moved, t.shown = (tuple(map(float, v)) for v in (box, moved, shown))
        t.unit, t.ahead = unit(t.vector), None
        return t

    def expect(self, at) -> tuple:
        """The box by its own velocity from where the camera's motion has brought it; without motion it stays the same until the track is seen again."""
        (x1, y1, x2, y2), (x, y), (p1, q1, p2, q2) = self.box, self.moved, at
        out = (p1 + (x1 + x - x1), q1 + (y1 + y - y1), p2 + (x2 + x - x2), q2 + (y2 + y - y2))
        if at is self.box:
            self.ahead = out
        return out

    def see(self, frame: int, box, confidence: float, vector, detection, shift, min_hits: int, look=None) -> None:
        """Fold in a matched detection; shift is how far the camera moved the image, look the vector's unit(), where looks count."""
        x1, y1, x2, y2 = box
        a1, b1, a2, b2 = self.box
        x, y = (x1 + x2) / 2, (y1 + y2) / 2
        self.moved = (x - (a1 + a2) / 2 - float(shift[0]), y - (b1 + b2) / 2 - float(shift[1]))
        # what is drawn: the centre follows by a half, the size by a quarter
        a1, b1, a2, b2 = self.shown if self.hits > 1 else box
        a, b, w, h = (a1 + a2) / 2, (b1 + b2) / 2, a2 - a1, b2 - b1
        a, b, w, h = a + 0.5 * (x - a), b + 0.5 * (y - b), w + 0.25 * ((x2 - x1) - w), h + 0.25 * ((y2 - y1) - h)
        self.shown = (a - w / 2, b - h / 2, a + w / 2, b + h / 2)
        self.mean = confidence if self.mean == 0 else 0.7 * self.mean + 0.3 * confidence
        self.box, self.confidence, self.last, self.detection, self.ahead = box, confidence, frame, detection, None
        self.hits, self.misses = self.hits + 1, 0
        self.state = CONFIRMED if self.hits >= min_hits else TENTATIVE
        if vector is not None:
            self.vector, self.unit = vector, look
            self.gallery = [*self.gallery, vector][-16:]


class FrameTracker:
    """All tracks of one stream. step() takes a frame's detections and gives the tracks that live after it."""

    def __init__(self, params: TrackerParams):
        self.p, self.tracks, self.next = params, [], 1
        self.found = {"matched": 0, "rescued": 0, "started": 0, "missed": 0}

    def _boxes(self, tracks: list[Track], motion) -> list:
        """Where tracks are expected: measured boxes under the camera's motion, then their own velocity on top."""
        if self.p.kind == "iou":
            return [t.box for t in tracks]
        if motion is None:
            return [t.ahead or t.expect(t.box) for t in tracks]
        return [t.expect(at) for t, at in zip(tracks, carried([t.box for t in tracks], motion).tolist())]

    def _pairs(self, tracks, boxes, looks, motion):
        cost, similar = costs(self._boxes(tracks, motion), boxes), None
        if self.p.kind == "botsort":
            own = [t.unit for t in tracks]
            if any(v is not None for v in own) and any(v is not None for v in looks):
                similar = unit_cosines(own, looks)
                cost = fused(np.array(cost), np.minimum(np.maximum((1 - similar) / 2, 0), 1), self.p.appearance).tolist()
        pairs = assign(cost, self.p.match)
        # a pair whose looks contradict each other is refused after the fact
        return [x for x in pairs if similar is None or tracks[x[0]].vector is None or looks[x[1]] is None or similar[x[0], x[1]] >= self.p.reid]

    def step(self, frame: int, boxes, confidences, classes=None, vectors=None, detections=None, motion=None) -> list[Track]:
        p = self.p
        n = len(confidences)
        boxes, confidences = [tuple(map(float, b)) for b in boxes], list(map(float, confidences))
        vectors = [None] * n if vectors is None else vectors
        detections = range(n) if detections is None else detections
        mine = [i for i in range(n) if classes is None or classes[i] == p.class_id]
        high = [i for i in mine if confidences[i] >= p.high]
        low = [i for i in mine if p.low <= confidences[i] < p.high]
        # the vector of a detection that may match is made a unit once, for all that compare it
        looks = [None] * n
        if p.kind == "botsort":
            for i in high + low:
                looks[i] = unit(vectors[i])
        shift = (0.0, 0.0)
        if motion is not None:
            x, y, w = np.asarray(motion, float) @ np.array([*CENTRE, 1.0])
            shift = np.nan_to_num(np.array([x, y]) / w - CENTRE).tolist() if w else shift
        self.tracks = [t for t in self.tracks if frame - t.last <= p.max_age and t.state != DEAD]
        live, see = list(self.tracks), lambda t, i: t.see(frame, boxes[i], confidences[i], vectors[i], detections[i], shift, p.min_hits, looks[i])
        self.found = {"matched": 0, "rescued": 0, "started": 0, "missed": 0}
        pairs = self._pairs(live, [boxes[i] for i in high], [looks[i] for i in high], motion) if live and high else []
        for t, d, _ in pairs:
            see(live[t], high[d])
        hit = {t for t, _, _ in pairs}
        for k, t in enumerate(live):
            if k not in hit:
                t.misses += 1
                t.state = DEAD if t.misses > p.max_age else LOST if t.state == CONFIRMED else t.state
        rescued = 0
        if p.kind in ("bytetrack", "botsort") and low:
            # any track that has matched before takes part, whether it has matched in this frame or not
            some = [t for t in live if t.hits > 1 or t.state == CONFIRMED]
            if some:
                for t, d, _ in assign(costs(self._boxes(some, motion), [boxes[i] for i in low]), p.match * p.low_scale):
                    see(some[t], low[d])
                    rescued += 1
        taken = {d for _, d, _ in pairs}
        started = [high[d] for d in range(len(high)) if d not in taken]
        for i in started:
            self.tracks.append(Track(self.next, frame, boxes[i], confidences[i], vectors[i], detections[i], looks[i]))
            self.next += 1
        self.tracks = [t for t in self.tracks if t.state != DEAD]
        self.found = {"matched": len(pairs), "rescued": rescued, "started": len(started), "missed": len(live) - len(pairs)}
        return self.tracks

    def rows(self, frame: int) -> list[tuple]:
        return [(frame, t.id, t.detection if t.last == frame else None, *t.box, *t.shown, t.state, t.hits, t.misses, max(1, frame - t.first + 1), t.confidence, t.mean) for t in self.tracks]


COLUMNS = "frame long, track_id long, detection long, x1 double, y1 double, x2 double, y2 double, shown_x1 double, shown_y1 double, shown_x2 double, shown_y2 double, state string, hits int, misses int, age int, confidence double, mean_confidence double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _list(column) -> list:
    return column.tolist() if isinstance(column, np.ndarray) else list(column)


class StreamTracker:
    """A FrameTracker as a frame-clocked machine: frames without detections in between count as misses, until no track is left alive. An idle stream keeps the number of its next track alone."""

    def __init__(self, params: TrackerParams, has: tuple[str, ...] = ()):
        self.tracker, self.last, self.has = FrameTracker(params), None, has

    def step(self, frame: int, rows: dict) -> list[tuple]:
        motion = next((m for m in rows["motion"] if m is not None), None) if "motion" in self.has else None
        self.tracker.step(
            frame, list(zip(*[_list(rows[c]) for c in ("x1", "y1", "x2", "y2")])), _list(rows["confidence"]), _list(rows["class_id"]) if "class_id" in self.has else None, rows["embedding"] if "embedding" in self.has else None, self._detections(rows),
            None if motion is None else np.asarray(list(motion), float).reshape(3, 3),
        )
        self.last = frame
        return self._rows()

    def _detections(self, rows: dict) -> list:
        """What a track keeps of the detection it has matched."""
        return _list(rows["detection"])

    def _rows(self) -> list[tuple]:
        return self.tracker.rows(self.last)

    def wake(self, frame: int) -> list[tuple]:
        out = []
        while self.tracker.tracks and self.last < frame:
            self.last += 1
            self.tracker.step(self.last, [], [])
            out += self._rows()
        return out

    def due(self) -> int | None:
        return max(t.last for t in self.tracker.tracks) + self.tracker.p.max_age + 1 if self.tracker.tracks else None

    def state(self) -> dict:
        if not self.tracker.tracks:
            return {"next": self.tracker.next}
        return {"next": self.tracker.next, "last": self.last, "tracks": [t.plain() for t in self.tracker.tracks]}

    def restore(self, state: dict) -> None:
        self.tracker.next, self.last = state["next"], state.get("last")
        self.tracker.tracks = [Track.of(t) for t in state.get("tracks", [])]


class StreamMatches(StreamTracker):
    """A StreamTracker of which only matches come out: the track's number and the detection's own columns."""

    def __init__(self, params: TrackerParams, has: tuple[str, ...], own: tuple[str, ...]):
        super().__init__(params, has)
        self.own = own

    def _detections(self, rows: dict) -> list:
        return list(zip(*[_list(rows[c]) for c in self.own]))

    def _rows(self) -> list[tuple]:
        return [(t.id, *t.detection) for t in self.tracker.tracks if t.last == self.last]


def _pass(detections: DataFrame, key: str, make, out: str) -> Pass:
    has = tuple(c for c in ("class_id", "embedding", "motion") if c in detections.columns)
    return Pass(lambda: make(has), ("detection", "x1", "y1", "x2", "y2", "confidence", *has), ("detection",), out, key)


def track(detections: DataFrame, params: TrackerParams = TrackerParams(), key: str = "stream", until: int | None = None) -> DataFrame:
    """detections (key, frame, detection, x1, y1, x2, y2, confidence[, class_id, embedding, motion]) -> the tracks that live after each frame (see COLUMNS), box as last measured, shown_* smoothed, detection null where carried on without one.

    motion: nine numbers, the homography from the frame before, on any row of a frame. Nulls in the other
    columns are not allowed, but for rows without frame, which are left out. A stream without detections
    has no rows. until: the frame where the clock stands at the end; without it tracks are carried on only
    up to the last frame with detections. A task holds its stream's live tracks and one Arrow batch of
    detections, whatever the stream's length.
    """
    return run_batch(detections, _pass(detections, key, lambda has: StreamTracker(params, has), COLUMNS), until, SPREAD)


def track_stream(detections: DataFrame, params: TrackerParams = TrackerParams(), key: str = "stream", lateness: int = 0) -> DataFrame:
    """track() over a stream of detections, with until at the watermark: a frame is stepped once the latest frame of any stream is more than `lateness` frames ahead of it (see passes.run_stream). Until then its detections may come in any micro-batch and order; later ones are dropped and counted. Rows of tracks that are carried on come out with their stream's next frame, or when the last of them dies, and their state goes with them."""
    return run_stream(detections, _pass(detections, key, lambda has: StreamTracker(params, has), COLUMNS), lateness)


def matches(detections: DataFrame, own: tuple[str, ...], params: TrackerParams = TrackerParams(), key: str = "stream") -> DataFrame:
    """The matched detections of track(), a track's last one of each frame: key, track_id and the detection's own columns. What tracks are carried on by doesn't come out of the machine, and nothing has to be joined back."""
    types = ", ".join(f"{c} {detections.schema[c].dataType.simpleString()}" for c in own)
    p = _pass(detections, key, lambda has: StreamMatches(params, has, own), f"track_id long, {types}")
    return run_batch(detections, replace(p, columns=tuple(dict.fromkeys((*p.columns, *own)))), spread=SPREAD)


def _each(run, kinds: tuple[str, ...]) -> DataFrame:
    """The union of each tracker's rows. Their tasks start in this order, so those that take longest come first."""
    kinds = sorted(kinds, key=KINDS.index, reverse=True)
    return reduce(DataFrame.union, [run(TrackerParams(k)).withColumn("tracker", F.lit(k)) for k in kinds])


def track_all(detections: DataFrame, kinds: tuple[str, ...] = KINDS, key: str = "stream") -> DataFrame:
    """track() by each of the trackers: key, tracker and COLUMNS. Detections are made and exchanged once; a stream's run by one tracker is a task's work, not that by all of them."""
    return _each(lambda p: track(detections, p, key), kinds).select(key, "tracker", *NAMES)


def matches_all(detections: DataFrame, own: tuple[str, ...], kinds: tuple[str, ...] = KINDS, key: str = "stream") -> DataFrame:
    """matches() by each of the trackers, as in track_all: key, tracker, track_id and the detection's own columns."""
    return _each(lambda p: matches(detections, own, p, key), kinds).select(key, "tracker", "track_id", *own)


# --- queries ----------------------------------------------------------------------------------


def _tracks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = track(views.detections(spark, sf_dir), TrackerParams(kind))
    return found.select("stream", "frame", "track_id", "detection", "state", "hits", "misses", "age", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "shown_x1", "shown_y1", "mean_confidence")])


def sort_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by predicted boxes."""
    return _tracks(spark, sf_dir, "sort")


def measured_box_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by the boxes as last measured."""
    return _tracks(spark, sf_dir, "iou")


def bytetrack_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by predicted boxes, with a second pass over low scores."""
    return _tracks(spark, sf_dir, "bytetrack")


def botsort_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by predicted boxes and appearance."""
    return _tracks(spark, sf_dir, "botsort")


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each stage of the second-pass tracker did the work, per stream: tracks alive, carried on without a detection, confirmed and lost."""
    found = track(views.detections(spark, sf_dir), TrackerParams("bytetrack"))
    count = lambda c, name: F.count_if(c).alias(name)
    return found.groupBy("stream").agg(F.count(F.lit(1)).alias("tracks"), count(F.col("detection").isNull(), "predicted_only"), count(F.col("state") == CONFIRMED, "confirmed"), count(F.col("state") == LOST, "lost"), F.countDistinct("track_id").alias("identities"))


def tracker_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tracker over the same detections, against the true objects of the adapter: most pure tracks first."""
    hits = matches_all(views.detections(spark, sf_dir).where("stream is not null"), ("object",))
    per = hits.groupBy("tracker", "stream", "track_id").agg(F.count(F.lit(1)).alias("n"), (F.min("object") == F.max("object")).alias("one"))
    out = per.groupBy("tracker").agg(F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("matched"), F.count_if("one").alias("pure"))
    return out.orderBy(F.desc(F.col("pure") / F.col("tracks")), "tracker")


def replayed(truth: DataFrame, tracks: DataFrame, key: str = "stream", threshold: float = 0.5) -> DataFrame:
    """truth (key, frame, object, x1, y1, x2, y2) against tracks (key, frame, track_id, x1, y1, x2, y2) -> per key: truth, predicted and matched boxes, identity switches, fragments, MOTA, detection F1. Frames of either side count, in full."""
    side = lambda df, number, name: df.groupBy(key, "frame").agg(F.array_sort(F.collect_list(F.struct(F.col(number).cast("int").alias("box_ord"), "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")))).alias(name))
    none = "cast(array() as array<struct<box_ord:int,x1:double,y1:double,w:double,h:double>>)"
    f = side(truth, "object", "gt").join(side(tracks, "track_id", "pred"), [key, "frame"], "full_outer").select(key, "frame", F.coalesce("gt", F.expr(none)).alias("gt"), F.coalesce("pred", F.expr(none)).alias("pred"))
    f = matched_frames(f, threshold)
    counts = f.groupBy(key).agg(F.sum(F.size("gt")).alias("gt"), F.sum(F.size("pred")).alias("pred"), F.sum(F.size("pairs")).alias("tp"))
    own = F.expr("transform(gt, a -> named_struct('object', a.box_ord, 'now', try_element_at(filter(pairs, x -> x.g = a.box_ord), 1).p))")
    was = F.lag("now").over(Window.partitionBy(key, "object").orderBy("frame"))
    events = f.select(key, "frame", F.explode(own).alias("m")).select(key, "frame", "m.*").withColumn("was", was).groupBy(key).agg(F.count_if(F.col("now") != F.col("was")).alias("idsw"), F.count_if(F.col("now").isNull() & F.col("was").isNotNull()).alias("fragments"))
    out = counts.join(events, key, "left").na.fill(0, ["idsw", "fragments"])
    mota = F.when(F.col("gt") > 0, 1 - (F.col("gt") - F.col("tp") + F.col("pred") - F.col("tp") + F.col("idsw")) / F.col("gt")).otherwise(0.0)
    f1 = F.when(F.col("gt") + F.col("pred") > 0, 2 * F.col("tp") / (F.col("gt") + F.col("pred"))).otherwise(0.0)
    return out.withColumn("mota", mota).withColumn("idf1", f1)


def replay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tracker's scores over all streams, the best MOTA first; a stream's detections are made and exchanged once for all trackers."""
    d = views.detections(spark, sf_dir)
    truth = d.where("class_id = 0").groupBy("stream", "frame", "object").agg(*[F.min_by(c, "detection").alias(c) for c in ("x1", "y1", "x2", "y2")])
    # a tracker's run over a stream is a key of its own
    run = lambda df: df.withColumn("run", F.struct("tracker", "stream")).drop("tracker", "stream")
    truth = run(truth.withColumn("tracker", F.explode(F.array(*map(F.lit, KINDS)))))
    per = replayed(truth, run(track_all(d)), "run")
    out = per.groupBy(F.col("run.tracker").alias("tracker")).agg(*[F.sum(c).alias(c) for c in ("gt", "pred", "tp", "idsw", "fragments")])
    return out.withColumn("mota", F.round(1 - (F.col("gt") - F.col("tp") + F.col("pred") - F.col("tp") + F.col("idsw")) / F.col("gt"), 9)).orderBy(F.desc("mota"), "tracker")


def assigned(frames: DataFrame, most: float = 0.8) -> DataFrame:
    """frames (l_orderkey, gt, pred: arrays of box_ord, x1, y1, w, h) -> (l_orderkey, gt_id, pred_id, cost): each frame's boxes and predictions one to one with the least total of 1 - overlap, pairs above `most` left out after the fact. A frame without either side has no rows."""

    def run(batches):
        for batch in batches:
            keys = batch.column("l_orderkey").to_numpy(zero_copy_only=False)
            sides = []
            for name in ("gt", "pred"):
                column = batch.column(name)
                box = column.flatten()
                get = lambda c, box=box: box.field(c).to_numpy(zero_copy_only=False)
                x, y, w, h = (get(c).astype(float) for c in ("x1", "y1", "w", "h"))
                sizes = np.diff(column.offsets.to_numpy())
                sides.append((sizes, get("box_ord"), np.stack([x, y, x + w, y + h], axis=1)))
            (n, gt, left), (m, pred, right) = sides
            i, j, cost = assign_batch(n, left, m, right, most)
            frame = np.repeat(np.arange(len(n)), n)[i]
            yield pa.RecordBatch.from_arrays([pa.array(keys[frame], pa.int64()), pa.array(gt[i], pa.int32()), pa.array(pred[j], pa.int32()), pa.array(np.round(cost, 9))], names=["l_orderkey", "gt_id", "pred_id", "cost"])

    return frames.select("l_orderkey", "gt", "pred").mapInArrow(run, "l_orderkey long, gt_id int, pred_id int, cost double")


def optimal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and predictions of each frame, one to one with the least total of 1 - overlap."""
    return assigned(views.frame_boxes(spark, sf_dir))


def stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks over the stream of events; equal to the batch query when all events of a stream come in order."""
    from skyledger.streaming.edge import drain, event_stream

    found = drain(track_stream(views.detection_columns(event_stream(spark, sf_dir)), replace(TrackerParams(), kind="bytetrack")), "append")
    return found.select("stream", "frame", "track_id", "detection", "state", "hits")


def oracles(_views: str) -> dict[str, str]:
    """SQL of the assignment: from box to box, each takes one of the predictions left that it overlaps, or none; the largest total overlap is the least total cost."""
    return {
        "optimal_assignment": f"""WITH RECURSIVE {_views[5:]} e AS (SELECT l_orderkey, gt_id, pred_id, i / (areas - i)::DOUBLE AS v FROM pairs WHERE i > 0),
k AS MATERIALIZED (SELECT l_orderkey, gt_id, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY gt_id) AS n, list(DISTINCT {{'p': pred_id, 'v': v}}) AS o FROM e GROUP BY 1, 2),
w AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS n, 0.0::DOUBLE AS total, 0::BIGINT AS used, [] :: STRUCT(g INT, p INT, v DOUBLE)[] AS picks FROM k
  UNION ALL SELECT w.l_orderkey, w.n + 1, total + coalesce(x.o.v, 0), used | (CASE WHEN x.o IS NULL THEN 0 ELSE 1 << x.o.p END)::BIGINT, CASE WHEN x.o IS NULL THEN picks ELSE list_append(picks, {{'g': gt_id, 'p': x.o.p, 'v': x.o.v}}) END
  FROM w JOIN k ON k.l_orderkey = w.l_orderkey AND k.n = w.n + 1, LATERAL (SELECT unnest(list_append(k.o, NULL)) AS o) x WHERE x.o IS NULL OR used & (1 << x.o.p)::BIGINT = 0),
b1 AS (SELECT l_orderkey, arg_max(picks, (n, round(total, 9))) AS picks FROM w GROUP BY 1)
SELECT l_orderkey, p.g AS gt_id, p.p AS pred_id, round(1 - p.v, 9) AS cost FROM (SELECT l_orderkey, unnest(picks) AS p FROM b1) WHERE 1 - p.v <= 0.8"""
    }


QUERIES = (replay_scores, sort_tracks, measured_box_tracks, bytetrack_tracks, botsort_tracks, stage_counts, tracker_comparison, optimal_assignment, stream_tracks)
