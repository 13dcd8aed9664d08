"""Hand-overs and recoveries of identities: small state machines, one per identity, fed by its events in frame order and by the clock, so that what nobody answers fails by itself. Identities are keys, so they spread over the cluster."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.operators.passes import Pass, run_batch, run_stream
from skyledger.sources.views import read


@dataclass(frozen=True)
class CoordinationParams:
    """Hand-over: frames that must confirm, window in seconds, metres and cosine that a confirmation may be off. Recovery: seconds, missed frames before it begins, seconds per camera, radii in metres and their growth, seconds between predictions."""

    confirm_frames: int = 3
    confirm_s: float = 0.5
    apart_m: float = 25.0
    alike: float = 0.55
    acquire_s: float = 1.5
    budget_s: float = 1.5
    gap_frames: int = 4
    camera_s: float = 0.25
    least_m: float = 8.0
    growth: float = 1.6
    most_m: float = 60.0
    predict_s: float = 0.1
    fps: float = 30.0


@dataclass
class Handover:
    """One identity's hand-over, if any is pending. Each call gives what happened, or nothing."""

    p: CoordinationParams
    to: int | None = None
    started: int = 0
    place: tuple[float, float] = (0.0, 0.0)
    confirmed: int = 0

    def trigger(self, frame: int, place, candidates: list[tuple[int, float, float]]) -> str:
        """candidates: (camera, seconds to acquire, score), the best first."""
        if self.to is not None:
            return ""
        fit = [c for c, seconds, score in candidates if seconds <= self.p.acquire_s and score > 0]
        if not fit:
            return "no receiver"
        self.to, self.started, self.place, self.confirmed = fit[0], frame, place, 0
        return "triggered"

    def move(self, place) -> None:
        if self.to is not None:
            self.place = place

    def see(self, camera: int, place, alike: float | None) -> str:
        """A sighting: it confirms if the receiver reports the identity where it is expected; one that disagrees starts the count anew."""
        if self.to is None or camera != self.to:
            return ""
        if math.dist(place, self.place) > self.p.apart_m or (alike is not None and alike < self.p.alike):
            self.confirmed = 0
            return "disagreed"
        self.confirmed += 1
        if self.confirmed < self.p.confirm_frames:
            return "confirming"
        self.to = None
        return "completed"

    def due(self) -> int | None:
        """The frame at which it fails if it isn't confirmed before."""
        if self.to is None:
            return None
        return self.started + max(1, int(max(self.p.confirm_s, 0.5) * self.p.confirm_frames * self.p.fps * 3)) + 1

    def expire(self, frame: int) -> str:
        if self.to is None or frame < self.due():
            return ""
        self.to = None
        return "failed"


@dataclass
class Recovery:
    """One identity's recovery, if any is active: searches widen until its budget of seconds is spent."""

    p: CoordinationParams
    started: int | None = None
    place: tuple[float, float] = (0.0, 0.0)
    radii: list[float] = field(default_factory=list)
    last: int = 0

    def wanted(self, missed: int, state: str) -> bool:
        return self.started is None and missed >= self.p.gap_frames and state not in ("dead", "tentative")

    def begin(self, frame: int, place) -> None:
        self.started, self.place, self.radii, self.last = frame, place, [], frame

    def due(self) -> int | None:
        """The frame at which its budget is spent."""
        return None if self.started is None else self.started + int(math.floor(self.p.budget_s * self.p.fps)) + 1

    def search(self, frame: int, uncertainty: float, cameras: list[int]) -> tuple[str, float, list[int], bool]:
        """(what, radius, cameras to search with, whether the place was to be predicted anew)."""
        p, spent = self.p, (frame - self.started) / self.p.fps
        if spent > p.budget_s:
            self.started = None
            return "exhausted", 0.0, [], False
        if not cameras:
            return "nobody sees", 0.0, [], False
        radius = min(max(uncertainty, p.least_m), p.most_m)
        if self.radii:
            radius = min(radius * p.growth, p.most_m)
        again = (frame - self.last) / p.fps >= p.predict_s
        self.radii.append(radius)
        self.last = frame
        return "searched", radius, cameras[: max(1, int((p.budget_s - spent) / p.camera_s))], again

    def find(self, place, alike: float | None) -> bool:
        """A sighting that lies within the last search's radius of where the identity was lost, and looks alike, ends the recovery."""
        if self.started is None or math.dist(place, self.place) > max([self.p.least_m, *self.radii[-1:]]) or (alike is not None and alike < self.p.alike):
            return False
        self.started = None
        return True


COLUMNS = "frame long, what string, camera long, radius double, elapsed_s double"
_READS = ("kind", "camera", "x", "y", "alike", "seconds", "score", "missed", "state", "uncertainty", "cameras")


class Coordinator:
    """One identity's hand-over and recovery as a frame-clocked machine. An identity with neither under way keeps no state."""

    def __init__(self, params: CoordinationParams):
        self.p, self.hand, self.lost = params, Handover(params), Recovery(params)

    def _since(self, frame: int, started: int) -> float:
        return (frame - started) / self.p.fps

    def wake(self, frame: int) -> list[tuple]:
        out = []
        while (due := self.due()) is not None and due <= frame:
            if self.hand.due() == due:
                out.append((due, self.hand.expire(due), None, None, self._since(due, self.hand.started)))
            if self.lost.due() == due:
                out.append((due, "exhausted", None, None, self._since(due, self.lost.started)))
                self.lost.started = None
        return out

    def step(self, frame: int, rows: dict) -> list[tuple]:
        out, hand, lost = self.wake(frame), self.hand, self.lost
        for kind, camera, x, y, alike, seconds, score, missed, state, uncertainty, cameras in zip(*(v.tolist() if hasattr(v, "tolist") else v for v in (rows[c] for c in _READS)), strict=True):
            place = (x, y)
            hand.move(place)
            if kind == "leave":
                what = hand.trigger(frame, place, [(camera, seconds, score)])
                out.append((frame, what, camera, None, None))
            elif kind == "see":
                what = hand.see(camera, place, alike)
                out.append((frame, what, camera, None, self._since(frame, hand.started) if what == "completed" else None))
                started = lost.started
                if started is not None and lost.find(place, alike):
                    out.append((frame, "recovered", camera, None, self._since(frame, started)))
            else:
                if lost.wanted(missed, state):
                    lost.begin(frame, place)
                    out.append((frame, "recovery began", camera, None, None))
                if lost.started is not None:
                    what, radius, some, _ = lost.search(frame, uncertainty, list(cameras or ()))
                    out.append((frame, what, some[0] if some else None, radius, None))
        return [r for r in out if r[1]]

    def due(self) -> int | None:
        hand, lost = self.hand.due(), self.lost.due()
        return lost if hand is None else hand if lost is None else min(hand, lost)

    def state(self) -> dict | None:
        h, r = self.hand, self.lost
        if h.to is None and r.started is None:
            return None
        return {"hand": [h.to, h.started, list(h.place), h.confirmed], "lost": [r.started, list(r.place), r.radii, r.last]}

    def restore(self, state: dict) -> None:
        h, r = self.hand, self.lost
        h.to, h.started, place, h.confirmed = state["hand"]
        h.place = tuple(place)
        r.started, place, r.radii, r.last = state["lost"]
        r.place = tuple(place)


def _pass(params: CoordinationParams) -> Pass:
    return Pass(lambda: Coordinator(params), _READS, ("kind", "camera"), COLUMNS, "gid")


def coordinate(events: DataFrame, params: CoordinationParams = CoordinationParams(), until: int | None = None) -> DataFrame:
    """events (gid, frame, kind, camera, x, y, alike, seconds, score, missed, state, uncertainty, cameras) -> (gid, frame, what, camera, radius, elapsed_s): what happened, and how long a hand-over or recovery took that ended.

    kind "leave" asks for a hand-over to camera, which can acquire in `seconds` with `score`; "see" is a
    sighting by camera, of likeness alike (null: unknown); "miss" a frame without one, after which the
    identity is searched for by `cameras`, the best first (null or none: nobody sees it). Events of a
    frame come in order of kind, then camera. A hand-over that isn't confirmed in time fails, and a
    recovery whose budget is spent is exhausted, at the frame when that is so, whether or not another
    event follows; until is the frame where the clock stands at the end (null: at an identity's last
    event). Rows without gid or frame are left out.
    """
    return run_batch(events.where("gid is not null"), _pass(params), until)


def coordinate_stream(events: DataFrame, params: CoordinationParams = CoordinationParams(), lateness: int = 0) -> DataFrame:
    """coordinate() over a stream of events, with until at the watermark: time-outs are timers in event time, so silence is noticed as soon as any identity's events have moved the clock past them (see passes.run_stream)."""
    return run_stream(events.where("gid is not null"), _pass(params), lateness)


def coordination_columns(events: DataFrame) -> DataFrame:
    """Events of an identity per user: sightings that drift, some by the receiver of a hand-over, some misses, after which the cameras next in number search."""
    k, u = F.col("event_id"), F.col("user_id")
    n = F.floor(k / 50)
    kind = F.when(k % 11 == 0, "leave").when(k % 5 < 3, "see").otherwise("miss")
    camera = F.when(k % 31 == 0, -1).otherwise(u % 3).cast("long")
    return events.select(
        u.alias("gid"), n.alias("frame"), kind.alias("kind"), camera.alias("camera"), (u * 5 + n % 40 * 0.3).cast("double").alias("x"), (u * 3 + k % 7 * 0.5).cast("double").alias("y"),
        F.when(k % 4 != 0, 0.5 + k % 6 / 10.0).alias("alike"), (k % 20 / 10.0).alias("seconds"), (k % 9 / 8.0).alias("score"), (k % 8).alias("missed"), F.when(u % 7 == 0, "tentative").otherwise("confirmed").alias("state"), (k % 25).cast("double").alias("uncertainty"), F.when(camera >= 0, F.sequence(camera, camera + 3)).alias("cameras"),
    )


def coordination_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination_columns(read(spark, sf_dir, "events"))


def coordination_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to each identity's hand-overs and recoveries, with the clock at the last frame of all at the end."""
    events = coordination_events(spark, sf_dir)
    return coordinate(events, until=events.agg(F.max("frame")).first()[0])


def coordination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each thing happened, over how many identities, the widest search, and the mean seconds that what ended had taken; with the share of recoveries that succeeded in every row."""
    log = coordination_log(spark, sf_dir)
    per = log.groupBy("what").agg(F.count(F.lit(1)).alias("times"), F.countDistinct("gid").alias("identities"), F.round(F.max("radius"), 6).alias("widest_m"), F.round(F.avg("elapsed_s"), 6).alias("mean_elapsed_s"))
    # the share comes from the few rows of the summary, not from another pass over the log
    times = lambda what: F.coalesce(F.max(F.when(F.col("what") == what, F.col("times"))).over(Window.partitionBy()), F.lit(0))
    return per.withColumn("recovered_share", F.round(times("recovered") / F.greatest(F.lit(1), times("recovery began")), 6))


def stream_coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log over the stream of events; equal to the batch query when all events come within one micro-batch or in order."""
    from skyledger.streaming.edge import drain, event_stream

    return drain(coordinate_stream(coordination_columns(event_stream(spark, sf_dir))), "append")


QUERIES = (coordination_log, coordination_summary, stream_coordination)
