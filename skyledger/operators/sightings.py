"""A store of which camera last saw an identity when, as a frame-clocked machine: the cross-camera verdict without a join, in batch and over a stream; what is older than the window is forgotten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.passes import Pass, run_batch, run_stream
from skyledger.sources.views import read

#: Fixed values of the rule: 3 s at 25 frames a second, and cameras that must agree.
WINDOW, CAMERAS = 75, 2


class SightingStore:
    """Camera -> last frame of one identity. Its size is the number of cameras that have seen the identity within the window; an identity unseen for longer has none."""

    def __init__(self, window: int = WINDOW, least: int = CAMERAS):
        self.window, self.least, self.last = window, least, {}

    def step(self, frame: int, rows: dict) -> list[tuple]:
        events, cameras = ([v.item() if hasattr(v, "item") else v for v in rows[c]] for c in ("event_id", "camera_id"))
        # sightings of one frame see each other
        self.last |= {c: frame for c in cameras if c is not None}
        self.last = {c: f for c, f in self.last.items() if f >= frame - self.window}
        n = len(self.last)
        return [(frame, e, n, "pass" if n >= self.least else "fail") for e in events]

    def wake(self, frame: int) -> list[tuple]:
        self.last = {c: f for c, f in self.last.items() if f >= frame - self.window}
        return []

    def due(self) -> int | None:
        return max(self.last.values()) + self.window + 1 if self.last else None

    def state(self) -> dict | None:
        return {"last": [list(x) for x in self.last.items()]} if self.last else None

    def restore(self, state: dict) -> None:
        self.last = {c: f for c, f in state["last"]}


def _pass(window: int, least: int) -> Pass:
    return Pass(lambda: SightingStore(window, least), ("event_id", "camera_id"), ("event_id",), "frame long, event_id long, cameras int, outcome string", "global_id")


def corroborate(sightings: DataFrame, window: int = WINDOW, least: int = CAMERAS) -> DataFrame:
    """sightings (global_id, frame, event_id, camera_id) -> (global_id, frame, event_id, cameras, outcome): how many cameras have seen the identity within the last `window` frames, this one included, and whether that is enough.

    A null camera counts as none, rows without frame are left out, rows without identity make one of
    their own. One pass in order of frames; a join would meet each sighting with all of its window.
    """
    return run_batch(sightings, _pass(window, least))


def corroborate_stream(sightings: DataFrame, window: int = WINDOW, least: int = CAMERAS, lateness: int = 0) -> DataFrame:
    """corroborate() over a stream; a verdict comes out once the watermark has passed its frame (see passes.run_stream). State is bounded on a stream without end: cameras of identities seen within the window, and open frames."""
    return run_stream(sightings, _pass(window, least), lateness)


def sighting_columns(events: DataFrame) -> DataFrame:
    """Sightings of forty identities by ten cameras, a frame for each four events."""
    return events.select((F.col("user_id") % 40).alias("global_id"), F.floor(F.col("event_id") / 4).alias("frame"), "event_id", ((F.col("event_id") * 7 + F.col("user_id") * 3) % 10).alias("camera_id"))


def corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-camera verdict of each sighting, by the store."""
    return corroborate(sighting_columns(read(spark, sf_dir, "events")))


def stream_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the stream of events."""
    from skyledger.streaming.edge import drain, event_stream

    return drain(corroborate_stream(sighting_columns(event_stream(spark, sf_dir))), "append")


def oracles(_views: str) -> dict[str, str]:
    """SQL of both: each sighting joined with those of its window."""
    sql = f"""WITH s AS (SELECT user_id % 40 AS global_id, event_id // 4 AS frame, event_id, (event_id * 7 + user_id * 3) % 10 AS camera_id FROM events)
SELECT a.global_id, a.frame, a.event_id, count(DISTINCT b.camera_id)::INT AS cameras, CASE WHEN count(DISTINCT b.camera_id) >= {CAMERAS} THEN 'pass' ELSE 'fail' END AS outcome
FROM s a JOIN s b ON a.global_id = b.global_id AND b.frame BETWEEN a.frame - {WINDOW} AND a.frame GROUP BY 1, 2, 3"""
    return {"corroborated": sql, "stream_corroborated": sql}


QUERIES = (corroborated, stream_corroborated)
