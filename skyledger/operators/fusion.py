"""Identities across cameras: a Kalman filter per identity, observations joined to identities by cost under gates. A site is one key, its observations pass in frame order."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.passes import Pass, run_batch, run_stream
from skyledger.operators.trackers import CONFIRMED, DEAD, LOST, TENTATIVE
from skyledger.sources import views

STEP = 1 / 30


@dataclass(frozen=True)
class FusionParams:
    """Weights and gates of the association, frames an identity may be missed, noises of the filter (m/s, m) and the variances it begins with."""

    motion: float = 0.65
    appearance: float = 0.35
    gate: float = 0.75
    rescue_times: float = 3.0
    rescue_m: float = 40.0
    reid: float = 0.55
    max_missed: int = 12
    process: float = 0.35
    measurement: float = 1.0
    max_radius_m: float = 18.0
    apart_m: float = 25.0
    gallery: int = 16
    variances: tuple[float, float] = (25.0, 4.0)

    @staticmethod
    def of_rules(max_age: int = 4, **rules) -> FusionParams:
        """As the alert rules have it: an identity is missed for three times a track's age, four frames at least."""
        return FusionParams(max_missed=max(4, 3 * max_age), **rules)


class Filter:
    """Constant velocity on the ground plane. The two axes never mix in this model, so each has a covariance of position and velocity (p, c, v), and both have the same."""

    def __init__(self, at, p: FusionParams, velocity=(0.0, 0.0)):
        self.at, self.velocity = np.array(at, float), np.array(velocity, float)
        self.p, self.c, self.v = p.variances[0], 0.0, p.variances[1]
        self.noise, self.measured = p.process, p.measurement
        self.updates = 0

    def predict(self, dt: float = STEP) -> None:
        # the noise of 1/60 s, scaled by the frames of 1/30 s that pass
        tick, scale = 1 / 60, self.noise**2 * dt * 30
        self.at = self.at + self.velocity * dt
        self.p += 2 * dt * self.c + dt * dt * self.v + tick**4 / 4 * scale
        self.c += dt * self.v + tick**3 / 2 * scale
        self.v += tick**2 * scale

    def update(self, seen) -> None:
        total = self.p + self.measured**2
        gain, pull = self.p / total, self.c / total
        off = np.asarray(seen, float) - self.at
        self.at, self.velocity = self.at + gain * off, self.velocity + pull * off
        # the symmetric form (1 - k) p (1 - k) + k r k, which stays positive
        r, keep = self.measured**2, 1 - gain
        p, c, v = self.p, self.c, self.v
        self.p = keep * p * keep + gain * r * gain
        self.c = keep * (c - pull * p) + gain * r * pull
        self.v = v - 2 * pull * c + pull * p * pull + pull * r * pull
        self.updates += 1

    def radius(self, sigma: float = 3.0) -> float:
        return sigma * math.sqrt(max(2 * self.p, 0.0) / 2)

    def time_to_radius(self, radius: float, sigma: float = 3.0) -> float:
        return time_to_radius(self.p, self.c, radius, sigma)


def time_to_radius(p: float, c: float, radius: float, sigma: float = 3.0) -> float:
    """Seconds until the radius is reached, by the squared covariances of position with velocity."""
    target, now, growth = (radius / max(sigma, 1e-6)) ** 2, 2 * p, 2 * c**2
    if target <= now:
        return 0.0
    return math.inf if growth <= 1e-12 else math.sqrt((target - now) / growth)


class Bank:
    """The filters of all identities of a site as stacked arrays: foreseen all at once, updated where observed. A row is an identity; rows stand in order of their numbers."""

    def __init__(self, p: FusionParams):
        self.p = p
        self.ids, self.at, self.velocity = np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros((0, 2))
        self.pcv = np.zeros((0, 3))

    def __len__(self) -> int:
        return len(self.ids)

    def add(self, number: int, at) -> None:
        self.ids = np.append(self.ids, number)
        self.at, self.velocity = np.vstack([self.at, np.asarray(at, float)]), np.vstack([self.velocity, np.zeros(2)])
        self.pcv = np.vstack([self.pcv, [self.p.variances[0], 0.0, self.p.variances[1]]])

    def keep(self, rows: np.ndarray) -> None:
        self.ids, self.at, self.velocity, self.pcv = self.ids[rows], self.at[rows], self.velocity[rows], self.pcv[rows]

    def predict(self, frames: int, dt: float = STEP) -> None:
        tick, scale = 1 / 60, self.p.process**2 * dt * 30
        p, c, v = self.pcv.T
        for _ in range(frames):
            self.at = self.at + self.velocity * dt
            p = p + (2 * dt * c + dt * dt * v + tick**4 / 4 * scale)
            c = c + (dt * v + tick**3 / 2 * scale)
            v = v + tick**2 * scale
        self.pcv = np.stack([p, c, v], axis=1)

    def update(self, row: int, seen) -> None:
        p, c, v = self.pcv[row].tolist()
        r = self.p.measurement**2
        gain, pull = p / (p + r), c / (p + r)
        off = np.asarray(seen, float) - self.at[row]
        self.at[row] += gain * off
        self.velocity[row] += pull * off
        keep = 1 - gain
        # the symmetric form (1 - k) p (1 - k) + k r k, which stays positive
        self.pcv[row] = keep * p * keep + gain * r * gain, keep * (c - pull * p) + gain * r * pull, v - 2 * pull * c + pull * p * pull + pull * r * pull

    def radii(self, sigma: float = 3.0) -> np.ndarray:
        return sigma * np.sqrt(np.maximum(2 * self.pcv[:, 0], 0.0) / 2)

    def time_to_radius(self, row: int, radius: float, sigma: float = 3.0) -> float:
        return time_to_radius(float(self.pcv[row, 0]), float(self.pcv[row, 1]), radius, sigma)

    def near(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, point) of identities and points that may be within reach of each other: identities lie in grid cells of that width, and a point looks into its own and the eight around it. With an infinite reach all meet."""
        if not len(self) or not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not math.isfinite(reach) or len(self) <= 16:
            return np.tile(np.arange(len(self)), len(points)), np.repeat(np.arange(len(points)), len(self))
        cells = {}
        for row, cell in enumerate(map(tuple, np.floor(self.at / reach).astype(np.int64).tolist())):
            cells.setdefault(cell, []).append(row)
        rows, at = [], []
        for k, (x, y) in enumerate(np.floor(points / reach).astype(np.int64).tolist()):
            found = sorted(r for i in (-1, 0, 1) for j in (-1, 0, 1) for r in cells.get((x + i, y + j), ()))
            rows += found
            at += [k] * len(found)
        return np.array(rows, np.int64), np.array(at, np.int64)


class Identity:
    """What an identity has beside its filter."""

    __slots__ = ("id", "cameras", "nodes", "first", "last", "missed", "hits", "handoffs", "state", "gallery")

    def __init__(self, number: int, frame: int):
        self.id, self.first, self.last = number, frame, frame
        self.cameras, self.nodes, self.missed, self.hits, self.handoffs, self.state, self.gallery = set(), set(), 0, 1, 0, TENTATIVE, []

    def plain(self) -> list:
        return [self.id, sorted(self.cameras), sorted(self.nodes), self.first, self.last, self.missed, self.hits, self.handoffs, self.state, [list(map(float, g)) for g in self.gallery]]

    @classmethod
    def of(cls, values: list) -> Identity:
        i = cls.__new__(cls)
        i.id, cameras, nodes, i.first, i.last, i.missed, i.hits, i.handoffs, i.state, gallery = values
        i.cameras, i.nodes, i.gallery = set(cameras), set(nodes), [np.array(g, float) for g in gallery]
        return i


def best_cosine(gallery: list[np.ndarray], vector: np.ndarray) -> float:
    """The highest cosine over a gallery, 0 at least and for none."""
    if not len(gallery):
        return 0.0
    g, v = np.stack(gallery), np.asarray(vector, float)
    sizes = np.sqrt((g * g).sum(axis=1)) * math.sqrt(float(v @ v))
    some = sizes >= 1e-8
    return max(0.0, float(((g[some] @ v) / sizes[some]).max())) if some.any() else 0.0


class Fusion:
    """All identities of one site. step() joins a frame's observations (camera, node, x, y, vector) to them and says which identity each has."""

    def __init__(self, params: FusionParams = FusionParams()):
        self.p, self.all, self.next, self.bank = params, {}, 1, Bank(params)

    def costs(self, seen: list[tuple]) -> list[tuple[float, float, int, int]]:
        """(cost, distance, identity, observation) of the pairs within reach, observation by observation; a cost of 1 is a refusal. Beyond the wider of the gates in metres nothing is ever joined, unless a gate lets refusals pass."""
        p, b = self.p, self.bank
        points = np.array([at for _, _, at, _ in seen], float).reshape(-1, 2)
        rows, ks = b.near(points, math.inf if p.gate >= 1 else max(p.apart_m, p.rescue_m))
        away = points[ks] - b.at[rows]
        off = np.hypot(away[:, 0], away[:, 1])
        motion = np.minimum(1.0, off / (3 * np.maximum(b.radii()[rows], 1.0)))
        out = []
        for row, k, d, cost in zip(rows.tolist(), ks.tolist(), off.tolist(), motion.tolist(), strict=True):
            number = int(b.ids[row])
            i, (camera, _, _, vector) = self.all[number], seen[k]
            if i.state == DEAD:
                continue
            if d > p.apart_m:
                cost = 1.0
            elif camera not in i.cameras and p.appearance > 0 and i.gallery and vector is not None:
                similar = best_cosine(i.gallery, vector)
                cost = 1.0 if similar < p.reid else min(1.0, p.motion * cost + p.appearance * min(1.0, max(0.0, (1 - similar) / 2)))
            out.append((cost, d, number, k))
        return out

    def join(self, seen: list[tuple]) -> dict[int, tuple[int, bool]]:
        """Observation -> (identity, rescued): cheapest pairs first, below the gate, then below the wider gate within the rescue distance; with the default gates that is 1, so near pairs that the first pass refuses outright are rescued as well. An identity takes one observation per camera."""
        p = self.p
        # of equal costs the earlier observation counts, then the lower identity
        costs = sorted(self.costs(seen), key=lambda x: (x[0], x[3], x[2]))
        out, taken = {}, set()
        for rescue, gate in ((False, p.gate), (True, min(1.0, p.gate * p.rescue_times))):
            for c, off, number, k in costs:
                if c > gate:
                    break
                if k not in out and not (rescue and off > p.rescue_m) and (number, seen[k][0]) not in taken:
                    out[k] = number, rescue
                    taken.add((number, seen[k][0]))
        return out

    def see(self, i: Identity, camera, node, vector) -> None:
        i.cameras.add(camera), i.nodes.add(node)
        if vector is not None:
            i.gallery = [*i.gallery, np.asarray(vector, float)][-self.p.gallery :]

    def row(self, number: int) -> int:
        return int(np.searchsorted(self.bank.ids, number))

    def clear(self) -> None:
        self.all, self.bank = {}, Bank(self.p)

    def step(self, frame: int, seen: list[tuple], passed: int = 1) -> list[tuple]:
        """(identity, how: matched, rescued or created, first sight by this camera) of each observation. passed: frames since the last step, each of which the filters foresee."""
        p, b = self.p, self.bank
        b.predict(passed)
        for number in b.ids[b.radii() > p.max_radius_m].tolist():
            self.all[number].state = LOST
        joined, out = self.join(seen), [None] * len(seen)
        for k in sorted(joined, key=lambda k: joined[k][1]):
            number, rescued = joined[k]
            i, (camera, node, at, vector) = self.all[number], seen[k]
            b.update(self.row(number), at)
            new = camera not in i.cameras
            i.handoffs += new
            i.hits, i.last, i.missed, i.state = i.hits + 1, frame, 0, CONFIRMED
            self.see(i, camera, node, vector)
            out[k] = number, "rescued" if rescued else "matched", new
        for k, (camera, node, at, vector) in enumerate(seen):
            if out[k] is None:
                i = self.all[self.next] = Identity(self.next, frame)
                b.add(self.next, at)
                self.see(i, camera, node, vector)
                out[k] = self.next, "created", False
                self.next += 1
        for i in self.all.values():
            if i.last != frame:
                i.missed = frame - i.last
        gone = [n for n, i in self.all.items() if i.missed > p.max_missed]
        if gone:
            for n in gone:
                del self.all[n]
            b.keep(~np.isin(b.ids, gone))
        return out


class SiteFusion:
    """A Fusion as a frame-clocked machine. A site where nothing is seen for so long that no identity can be left keeps the number of its next one alone."""

    def __init__(self, params: FusionParams, vectors: bool):
        self.p, self.vectors, self.fusion, self.last = params, vectors, Fusion(params), None

    def step(self, frame: int, rows: dict) -> list[tuple]:
        f, n = self.fusion, len(rows["observation"])
        of = {c: np.asarray(rows[c]).tolist() for c in ("observation", "camera", "node", "x", "y")}
        seen = [(of["camera"][k], of["node"][k], (of["x"][k], of["y"][k]), rows["embedding"][k] if self.vectors else None) for k in range(n)]
        gap = 1 if self.last is None else frame - self.last
        if gap > self.p.max_missed + 1:
            f.clear()
            gap = 1
        said = f.step(frame, seen, gap)
        self.last = frame
        radii, out = f.bank.radii(), []
        for k, (number, how, new) in enumerate(said):
            i, r = f.all[number], f.row(number)
            out.append((frame, of["observation"][k], of["camera"][k], number, how, new, *f.bank.at[r].tolist(), *f.bank.velocity[r].tolist(), float(radii[r]), f.bank.time_to_radius(r, 18.0), i.hits, len(i.cameras), i.handoffs, i.state))
        return out

    def wake(self, frame: int) -> list[tuple]:
        if self.fusion.all and frame > self.last + self.p.max_missed + 1:
            self.fusion.clear()
        return []

    def due(self) -> int | None:
        return self.last + self.p.max_missed + 2 if self.fusion.all else None

    def state(self) -> dict:
        f = self.fusion
        if not f.all:
            return {"next": f.next}
        return {"next": f.next, "last": self.last, "all": [i.plain() for i in f.all.values()], "bank": [f.bank.ids.tolist(), f.bank.at.tolist(), f.bank.velocity.tolist(), f.bank.pcv.tolist()]}

    def restore(self, state: dict) -> None:
        f = self.fusion
        f.next, self.last = state["next"], state.get("last")
        if "all" in state:
            f.all = {i.id: i for i in map(Identity.of, state["all"])}
            ids, at, velocity, pcv = state["bank"]
            f.bank.ids, f.bank.at, f.bank.velocity, f.bank.pcv = np.array(ids, np.int64), np.array(at, float), np.array(velocity, float), np.array(pcv, float)


COLUMNS = "frame long, observation long, camera long, global_id long, how string, new_camera boolean, x double, y double, vx double, vy double, radius_m double, time_to_18m double, hits int, cameras int, handoffs int, state string"


def _pass(observations: DataFrame, params: FusionParams, key: str) -> Pass:
    vectors = "embedding" in observations.columns
    return Pass(lambda: SiteFusion(params, vectors), ("observation", "camera", "node", "x", "y", *(("embedding",) if vectors else ())), ("observation",), COLUMNS, key)


def fuse(observations: DataFrame, params: FusionParams = FusionParams(), key: str = "site") -> DataFrame:
    """observations (key, frame, observation, camera, node, x, y[, embedding]) -> a row per observation with the identity it belongs to and that identity's state after the frame (see COLUMNS).

    Observations without ground position (null x or y) or frame take no part. Frames without any are
    foreseen by the filters but otherwise only missed; after max_missed of them no identity is left. A
    task holds its site's live identities and one Arrow batch of observations.
    """
    return run_batch(observations.where("x is not null and y is not null"), _pass(observations, params, key))


def fuse_stream(observations: DataFrame, params: FusionParams = FusionParams(), key: str = "site", lateness: int = 0) -> DataFrame:
    """fuse() over a stream of observations: a frame is joined once the latest frame of any site is more than `lateness` frames ahead of it (see passes.run_stream)."""
    return run_stream(observations.where("x is not null and y is not null"), _pass(observations, params, key), lateness)


def fused_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each observation with its identity."""
    rounded = [F.round(c, 5).alias(c) for c in ("x", "y", "vx", "vy", "radius_m")]
    return fuse(views.ground_sightings(spark, sf_dir)).select("site", "frame", "observation", "camera", "global_id", "how", "new_camera", *rounded, "hits", "cameras", "handoffs", "state")


def identity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of each site as last seen: how many, confirmed, seen by several cameras, hand-offs, mean and largest uncertainty, in order of the site."""
    last = fuse(views.ground_sightings(spark, sf_dir)).groupBy("site", "global_id").agg(*[F.max_by(c, F.struct("frame", "observation")).alias(c) for c in ("state", "cameras", "handoffs", "radius_m")])
    count = lambda c, name: F.count_if(c).alias(name)
    return last.groupBy("site").agg(F.count(F.lit(1)).alias("total"), count(F.col("state") == CONFIRMED, "confirmed"), count(F.col("cameras") > 1, "multi_camera"), F.sum("handoffs").alias("handoffs"), F.round(F.avg("radius_m"), 6).alias("mean_radius_m"), F.round(F.max("radius_m"), 6).alias("max_radius_m")).orderBy("site")


def nearest_identity(spark: SparkSession, sf_dir: str, most_m: float = 400.0) -> DataFrame:
    """The confirmed identity nearest to each site's centre, within most_m metres."""
    last = fuse(views.ground_sightings(spark, sf_dir)).groupBy("site", "global_id").agg(*[F.max_by(c, F.struct("frame", "observation")).alias(c) for c in ("x", "y", "state")])
    near = last.withColumn("distance", F.sqrt(F.pow(F.col("x") - 150, 2) + F.pow(F.col("y") - 75, 2))).where((F.col("state") == CONFIRMED) & (F.col("distance") <= most_m))
    return near.groupBy("site").agg(F.min_by("global_id", F.struct("distance", "global_id")).alias("global_id"), F.round(F.min("distance"), 5).alias("distance"))


QUERIES = (fused_identities, identity_summary, nearest_identity)
