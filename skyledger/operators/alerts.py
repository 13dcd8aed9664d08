"""The alert rules in full: five gates over a track's last sightings, the verdict with hysteresis, and its severity. A track's history meets the gates as window frames and one bounded array, never as a loop over tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.functions.geometry import inside
from skyledger.operators.shapes import FENCES
from skyledger.sources.views import read

#: Fixed values of the rules.
INITIATE, MAINTAIN, MIN_HITS, MIN_SECONDS, MAX_GAP = 0.60, 0.35, 12, 1.0, 5
SLOW, FAST, TURN, HOVER, HOVER_S, HOVER_SHARE = 1.5, 35.0, 90.0, 0.5, 2.0, 0.8
CAMERAS, WINDOW_S, APART_M, STEP_PX, LAST_FRAMES = 2, 3.0, 25.0, 0.5, 6
#: Heights up to which the fences hold, in their order.
FENCE_HEIGHTS = (12.0, 60.0, 30.0)
IMAGE_HEIGHT = 1080

def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of an identity per user: seconds, camera and node, ground place and height, centre in pixels, confidence."""
    e, k, u = read(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    t = k / 50.0
    speed = u % 45
    return e.select(
        u.alias("gid"), k.alias("frame"), t.alias("t"), (F.floor(k / 8) % (u % 5 + 1)).alias("camera"), (F.floor(k / 8) % (u % 5 + 1) % 2).alias("node"),
        F.when(u % 13 != 0, u % 9 * 110 + speed * (k % 2000) / 500.0).alias("x"), F.when(u % 13 != 0, u % 7 * 130 + k % 3 * (u % 4) * 0.4).alias("y"), (10 + k % 4 * (u % 3) * 0.3 + u % 2 * 25).alias("z"),
        (100 + k / 40.0).alias("px"), (300 + u % 11 * 40 + k % 3 * (u % 4) * 0.2).alias("py"), (F.when(u % 6 == 0, k * 13 % 40).otherwise(55 + k * 13 % 45) / 100.0).alias("confidence"),
    )


def running_mean(c: str, order: str, back: str, keep: float = 0.7) -> Column:
    """An exponential mean of c along order within a group, seeded by the first value; a mean of 0 counts as unset, so zeros before the first other value don't count. back: a row's place from the end, the last one's is 1.

    As a sum of weights, which is added up in parts and holds no group's history: a value weighs
    1 - keep, the seed 1, times keep for each value after it.
    """
    weight = F.pow(F.lit(keep), F.col(back) - 1)
    seed = F.min(F.when(F.col(c) != 0, F.struct(order, F.col(c).alias("v"), weight.alias("w"))))
    return F.sum(F.col(c) * (1 - keep) * weight) + F.coalesce(seed["v"] * keep * seed["w"], F.lit(0.0))


def verdicts(seen: DataFrame, horizons: DataFrame) -> DataFrame:
    """A row per identity at its last sighting: each gate's outcome (pass, fail or skipped), the measured values, the verdict and its severity.

    seen: see sightings. horizons: (camera, horizon), the horizon's row as a share of the image; a camera
    without one skips the spatial gate. An identity that was alerted before is held to a lower confidence.
    Cross-camera counts sightings of the last three seconds, severity all of them.
    """
    by_time = Window.partitionBy("gid").orderBy("frame")
    s = seen.withColumn("last_t", F.max("t").over(Window.partitionBy("gid"))).withColumn("back", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("frame"))))
    lag = lambda c: F.lag(c).over(by_time)
    s = s.withColumn("dpx", F.col("px") - lag("px")).withColumn("dpy", F.col("py") - lag("py")).withColumn("seconds", (F.col("frame") - lag("frame")) / 30.0)
    s = s.withColumn("speed", F.sqrt(F.pow(F.col("x") - lag("x"), 2) + F.pow(F.col("y") - lag("y"), 2)) / (F.col("t") - lag("t")))
    # headings of the last steps that moved at all
    moved = (F.col("back") < LAST_FRAMES) & (F.sqrt(F.col("dpx") * F.col("dpx") + F.col("dpy") * F.col("dpy")) >= STEP_PX) & (F.col("seconds") > 0)
    heads = s.where(moved).withColumn("heading", F.atan2("dpx", "dpy")).withColumn("before", F.lag("heading").over(by_time))
    delta = F.abs(F.pmod(F.col("heading") - F.col("before") + F.pi(), 2 * F.pi()) - F.pi())
    turns = heads.groupBy("gid").agg(F.degrees(F.sum(delta) / F.sum(F.when(F.col("before").isNotNull(), F.col("seconds")))).alias("turn"), F.count(F.lit(1)).alias("headings"))
    recent = F.col("t") >= F.col("last_t") - WINDOW_S
    lately = F.col("t") >= F.col("last_t") - HOVER_S
    first = s.where(recent).groupBy("gid").agg(F.min_by(F.struct("x", "y"), "frame").alias("p0"))
    spread = s.where(recent).join(first, "gid").groupBy("gid").agg(F.max(F.sqrt(F.pow(F.col("x") - F.col("p0.x"), 2) + F.pow(F.col("y") - F.col("p0.y"), 2))).alias("spread"))
    at = lambda c: F.max_by(c, "frame").alias(c)
    t = s.groupBy("gid").agg(
        F.count(F.lit(1)).alias("hits"), (F.max("t") - F.min("t")).alias("duration"), running_mean("confidence", "frame", "back").alias("mean"), *[at(c) for c in ("x", "y", "z", "py", "camera", "speed")],
        F.countDistinct("camera").alias("all_cameras"), F.countDistinct(F.when(recent, F.col("camera"))).alias("cameras"), F.countDistinct(F.when(recent, F.col("node"))).alias("nodes"),
        F.count_if(lately).alias("n_late"), (F.max(F.when(lately, F.col("t"))) - F.min(F.when(lately, F.col("t")))).alias("covered"), (F.max(F.when(lately, F.col("z"))) - F.min(F.when(lately, F.col("z")))).alias("rise"),
    )
    t = t.join(turns, "gid", "left").join(spread, "gid", "left").join(F.broadcast(horizons), "camera", "left")
    t = t.withColumn("misses", F.col("gid") % 8).withColumn("alerted_before", F.col("gid") % 4 == 0).withColumn("class_id", (F.col("gid") % 9 == 8).cast("int"))
    t = t.withColumn("turn", F.when(F.col("headings") >= 2, F.col("turn"))).withColumn("hover", F.when((F.col("n_late") >= 2) & (F.col("covered") >= HOVER_S * HOVER_SHARE), F.col("rise")))
    fence = F.coalesce(*[F.when((F.col("z") <= high + 1e-6) & inside(F.col("x"), F.col("y"), corners), F.lit(action)) for (_, action, corners), high in zip(FENCES, FENCE_HEIGHTS, strict=True)])
    need = F.when(F.col("alerted_before"), MAINTAIN).otherwise(INITIATE)
    fail = lambda c: F.when(c, F.lit("fail"))
    gates = {
        "confidence": F.coalesce(fail(F.col("mean") < need), F.lit("pass")),
        "persistence": F.coalesce(fail((F.col("hits") < MIN_HITS) | (F.col("duration") < MIN_SECONDS) | (F.col("misses") > MAX_GAP)), F.lit("pass")),
        "kinematics": F.when(F.col("x").isNull(), "skipped").otherwise(F.coalesce(fail((F.col("speed") < SLOW) | (F.col("speed") > FAST)), fail(F.col("turn") > TURN), fail(F.col("hover") < HOVER), F.lit("pass"))),
        "spatial": F.when(F.col("horizon").isNull(), "skipped").otherwise(F.coalesce(fail(F.col("py") >= F.col("horizon") * IMAGE_HEIGHT), fail(F.col("x").isNotNull() & (fence == "suppress")), F.lit("pass"))),
        "cross_camera": F.coalesce(fail(F.col("cameras") < CAMERAS), fail(F.col("spread") > APART_M), F.lit("pass")),
    }
    for name, gate in gates.items():
        t = t.withColumn(f"gate_{name}", gate)
    failed = F.coalesce(*[F.when(F.col(f"gate_{n}") == "fail", F.lit(n)) for n in gates])
    t = t.withColumn("first_failure", failed).withColumn("alerted", failed.isNull() & (F.col("class_id") == 0))
    severity = F.when(~F.col("alerted"), "none").when(F.col("all_cameras") >= 4, "critical").when((F.col("all_cameras") >= 2) | (F.coalesce("speed", F.lit(0.0)) >= 20), "warn").otherwise("info")
    r = lambda c: F.round(c, 6).alias(c)
    return t.select("gid", *[f"gate_{n}" for n in gates], "first_failure", "alerted", severity.alias("severity"), "hits", r("mean"), r("speed"), r("turn"), r("hover"), "cameras", "nodes", r("spread"))


def horizons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, 0.35 + 0.15 * c) for c in range(4)], "camera long, horizon double")


def alert_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, gates and measured values of every identity."""
    return verdicts(sightings(spark, sf_dir), horizons(spark))


def alert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by severity and first failure: how many identities, and how sure they were."""
    v = alert_verdicts(spark, sf_dir)
    return v.groupBy("severity", F.coalesce("first_failure", F.lit("")).alias("first_failure")).agg(F.count(F.lit(1)).alias("identities"), F.round(F.avg("mean"), 6).alias("mean"), F.max("hits").alias("most_hits"))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each camera as a probe shows it: sightings, identities, best confidence, last frame, and those seen in its last four frames or due to expire."""
    s = sightings(spark, sf_dir).withColumn("tick", F.floor(F.col("frame") / 100))
    last = F.max("tick").over(Window.partitionBy("camera"))
    own = s.withColumn("last", last).groupBy("camera", "gid").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"), F.max("tick").alias("seen"), F.max("last").alias("last"))
    return own.groupBy("camera").agg(F.sum("n").alias("sightings"), F.count(F.lit(1)).alias("identities"), F.max("best").alias("best"), F.max("last").alias("last_tick"), F.count_if(F.col("last") - F.col("seen") <= 4).alias("live"), F.count_if(F.col("last") - F.col("seen") > 4).alias("expired"))


QUERIES = (alert_verdicts, alert_totals, source_health)


def oracles(views: str) -> dict[str, str]:
    def in_fence(corners) -> str:
        hits = [f"CASE WHEN ({float(ay)} > y) <> ({float(by)} > y) AND x < (y - {float(ay)}) * {float(bx - ax)}::DOUBLE / {float(by - ay)}::DOUBLE + {float(ax)}::DOUBLE THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True) if ay != by]
        return f"({' + '.join(hits)}) % 2 = 1"

    fence = "CASE " + " ".join(f"WHEN z <= {high} + 1e-6 AND {in_fence(c)} THEN '{a}'" for (_, a, c), high in zip(FENCES, FENCE_HEIGHTS, strict=True)) + " END"
    seen = """WITH s AS (SELECT user_id AS gid, event_id AS frame, event_id / 50.0::DOUBLE AS t, event_id // 8 % (user_id % 5 + 1) AS camera, event_id // 8 % (user_id % 5 + 1) % 2 AS node,
  CASE WHEN user_id % 13 <> 0 THEN user_id % 9 * 110 + user_id % 45 * (event_id % 2000) / 500.0::DOUBLE END AS x, CASE WHEN user_id % 13 <> 0 THEN user_id % 7 * 130 + event_id % 3 * (user_id % 4) * 0.4::DOUBLE END AS y, 10 + event_id % 4 * (user_id % 3) * 0.3::DOUBLE + user_id % 2 * 25 AS z,
  100 + event_id / 40.0::DOUBLE AS px, 300 + user_id % 11 * 40 + event_id % 3 * (user_id % 4) * 0.2::DOUBLE AS py, CASE WHEN user_id % 6 = 0 THEN event_id * 13 % 40 ELSE 55 + event_id * 13 % 45 END / 100.0::DOUBLE AS confidence FROM events),
"""
    full = seen + f"""w AS (SELECT *, max(t) OVER (PARTITION BY gid) AS last_t, row_number() OVER (PARTITION BY gid ORDER BY frame DESC) AS back, px - lag(px) OVER o AS dpx, py - lag(py) OVER o AS dpy, (frame - lag(frame) OVER o) / 30.0::DOUBLE AS sec, sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2)) / (t - lag(t) OVER o) AS speed FROM s WINDOW o AS (PARTITION BY gid ORDER BY frame)),
hd AS (SELECT gid, frame, atan2(dpx, dpy) AS hg, sec FROM w WHERE back < {LAST_FRAMES} AND sqrt(dpx * dpx + dpy * dpy) >= {STEP_PX} AND sec > 0),
hl AS (SELECT *, lag(hg) OVER (PARTITION BY gid ORDER BY frame) AS b FROM hd),
tn AS (SELECT gid, CASE WHEN count(*) >= 2 THEN degrees(sum(abs(((hg - b + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi())) / sum(sec) FILTER (WHERE b IS NOT NULL)) END AS turn FROM hl GROUP BY 1),
rc AS (SELECT * FROM w WHERE t >= last_t - {WINDOW_S}), p0 AS (SELECT gid, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0 FROM rc WHERE x IS NOT NULL GROUP BY 1),
sp AS (SELECT gid, max(sqrt(pow(x - x0, 2) + pow(y - y0, 2))) AS spread FROM rc JOIN p0 USING (gid) GROUP BY 1),
em AS (SELECT gid, list_reduce(list_prepend(0.0::DOUBLE, list(confidence ORDER BY frame)), lambda s, c: CASE WHEN s = 0 THEN c ELSE 0.7::DOUBLE * s + (1 - 0.7::DOUBLE) * c END) AS mean FROM s GROUP BY 1),
ls AS (SELECT * FROM w WHERE back = 1),
ag AS (SELECT gid, count(*) AS hits, max(t) - min(t) AS duration, count(DISTINCT camera) AS ac, count(DISTINCT camera) FILTER (WHERE t >= last_t - {WINDOW_S}) AS cameras, count(DISTINCT node) FILTER (WHERE t >= last_t - {WINDOW_S}) AS nodes,
  count(*) FILTER (WHERE t >= last_t - {HOVER_S}) AS nl, max(t) FILTER (WHERE t >= last_t - {HOVER_S}) - min(t) FILTER (WHERE t >= last_t - {HOVER_S}) AS cv, max(z) FILTER (WHERE t >= last_t - {HOVER_S}) - min(z) FILTER (WHERE t >= last_t - {HOVER_S}) AS rise FROM w GROUP BY 1),
j AS (SELECT ag.*, mean, turn, spread, x, y, z, py, speed, CASE WHEN nl >= 2 AND cv >= {HOVER_S * HOVER_SHARE} THEN rise END AS hover, CASE WHEN camera < 4 THEN 0.35 + 0.15 * camera END::DOUBLE AS horizon, gid % 9 = 8 AS bird FROM ag JOIN em USING (gid) LEFT JOIN tn USING (gid) LEFT JOIN sp USING (gid) JOIN ls USING (gid)),
v AS (SELECT gid, CASE WHEN mean < CASE WHEN gid % 4 = 0 THEN {MAINTAIN} ELSE {INITIATE} END THEN 'fail' ELSE 'pass' END AS gate_confidence, CASE WHEN hits < {MIN_HITS} OR duration < {MIN_SECONDS} OR gid % 8 > {MAX_GAP} THEN 'fail' ELSE 'pass' END AS gate_persistence,
  CASE WHEN x IS NULL THEN 'skipped' WHEN speed < {SLOW} OR speed > {FAST} OR turn > {TURN} OR hover < {HOVER} THEN 'fail' ELSE 'pass' END AS gate_kinematics,
  CASE WHEN horizon IS NULL THEN 'skipped' WHEN py >= horizon * {IMAGE_HEIGHT} THEN 'fail' WHEN x IS NOT NULL AND {fence} = 'suppress' THEN 'fail' ELSE 'pass' END AS gate_spatial,
  CASE WHEN cameras < {CAMERAS} OR spread > {APART_M} THEN 'fail' ELSE 'pass' END AS gate_cross_camera, bird, ac, hits, mean, speed, turn, hover, cameras, nodes, spread FROM j),
r AS (SELECT *, CASE WHEN gate_confidence = 'fail' THEN 'confidence' WHEN gate_persistence = 'fail' THEN 'persistence' WHEN gate_kinematics = 'fail' THEN 'kinematics' WHEN gate_spatial = 'fail' THEN 'spatial' WHEN gate_cross_camera = 'fail' THEN 'cross_camera' END AS first_failure FROM v),
o AS (SELECT gid, gate_confidence, gate_persistence, gate_kinematics, gate_spatial, gate_cross_camera, first_failure, first_failure IS NULL AND NOT bird AS alerted, CASE WHEN first_failure IS NOT NULL OR bird THEN 'none' WHEN ac >= 4 THEN 'critical' WHEN ac >= 2 OR coalesce(speed, 0) >= 20 THEN 'warn' ELSE 'info' END AS severity, hits, round(mean, 6) AS mean, round(speed, 6) AS speed, round(turn, 6) AS turn, round(hover, 6) AS hover, cameras, nodes, round(spread, 6) AS spread FROM r)
"""
    return {
        "alert_verdicts": full + "SELECT * FROM o",
        "alert_totals": full + "SELECT severity, coalesce(first_failure, '') AS first_failure, count(*) AS identities, round(avg(mean), 6) AS mean, max(hits) AS most_hits FROM o GROUP BY 1, 2",
        "source_health": seen + "k AS (SELECT *, frame // 100 AS tick FROM s), m AS (SELECT *, max(tick) OVER (PARTITION BY camera) AS last FROM k), g AS (SELECT camera, gid, count(*) AS n, max(confidence) AS best, max(tick) AS seen, max(last) AS last FROM m GROUP BY 1, 2) SELECT camera, sum(n)::BIGINT AS sightings, count(*) AS identities, max(best) AS best, max(last) AS last_tick, count(*) FILTER (WHERE last - seen <= 4) AS live, count(*) FILTER (WHERE last - seen > 4) AS expired FROM g GROUP BY 1",
    }
