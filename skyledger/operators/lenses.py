"""Ground positions of pixels through real lenses: undistorted, turned by yaw, pitch and roll, met with the ground, and shown again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import cameras as c
from skyledger.sources.views import read

#: Image centre and focal lengths in pixels, and how many lens coefficients a camera has.
CX, CY, FX, FY = 960.0, 540.0, 850.0, 840.0
LENS = ("k1", "k2", "p1", "p2", "k3")


def on_ground(pixels: DataFrame, plane: float = 0.0) -> DataFrame:
    """pixels (px, py, x, y, z, yaw, pitch, roll, k1, k2, p1, p2, k3) with ray_x, ray_y, ray_z (unit vector in the world), ground_x, ground_y (null for a ray that doesn't meet the plane ahead) and back_px, back_py, the pixel that shows that ground point."""
    p = pixels.withColumns({"_u": (F.col("px") - CX) / FX, "_v": (F.col("py") - CY) / FY})
    p = p.withColumn("_s", c.undistort("_u", "_v", LENS))
    ray = c.turned(F.col("_s.x"), F.col("_s.y"), F.lit(1.0), F.col("yaw"), F.col("pitch"), F.col("roll"))
    p = p.withColumns(dict(zip(("_rx", "_ry", "_rz"), ray)))
    size = F.sqrt(F.col("_rx") * F.col("_rx") + F.col("_ry") * F.col("_ry") + F.col("_rz") * F.col("_rz"))
    p = p.withColumns({f"ray_{a}": F.col(f"_r{a}") / size for a in "xyz"})
    away = F.when(F.abs("ray_z") >= 1e-6, (F.lit(plane) - F.col("z")) / F.col("ray_z"))
    away = F.when(away > 0, away)
    p = p.withColumns({"ground_x": F.col("x") + away * F.col("ray_x"), "ground_y": F.col("y") + away * F.col("ray_y")})
    right, down, ahead = c.turned_back(F.col("ground_x") - F.col("x"), F.col("ground_y") - F.col("y"), F.lit(plane) - F.col("z"), F.col("yaw"), F.col("pitch"), F.col("roll"))
    p = p.withColumns({"_a": F.when(ahead > 1e-6, right / ahead), "_b": F.when(ahead > 1e-6, down / ahead)}).withColumn("_d", c.distort("_a", "_b", LENS))
    return p.withColumns({"back_px": F.col("_d.x") * FX + CX, "back_py": F.col("_d.y") * FY + CY}).drop("_u", "_v", "_s", "_rx", "_ry", "_rz", "_a", "_b", "_d")


def lens_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a pixel of a camera with a lens of its own: its ray, where that meets the ground, and by how much the pixel that shows the place again is off, in whole millionths."""
    k, d = F.col("event_id"), lambda x: x.cast("double")
    n = k % 12
    pixels = read(spark, sf_dir, "events").select(
        k.alias("event_id"), d(k * 37 % 1920).alias("px"), d(k * 53 % 1080).alias("py"), d(n * 40).alias("x"), d(n * 25).alias("y"), d(n + 6).alias("z"), d(n * 30).alias("yaw"), d(-8 - n * 2).alias("pitch"), d(n % 5 - 2).alias("roll"),
        (d(n) * -0.001).alias("k1"), (d(n) * 0.0001).alias("k2"), (d(n % 3 - 1) * 0.0003).alias("p1"), (d(n % 4 - 2) * 0.0002).alias("p2"), (d(n) * 0.00001).alias("k3"),
    )
    g = on_ground(pixels)
    off = F.round(F.greatest(F.abs(F.col("back_px") - F.col("px")), F.abs(F.col("back_py") - F.col("py"))) * 1e6).cast("long")
    r = lambda x, s: F.round(x, s).alias(x)
    return g.select("event_id", r("ray_x", 6), r("ray_y", 6), r("ray_z", 6), r("ground_x", 2), r("ground_y", 2), off.alias("off"))


def oracles(_views: str) -> dict[str, str]:
    """SQL of the same: ten rounds of the inverse by recursion, one matrix for the three turns."""
    return {
        "lens_positions": f"""WITH RECURSIVE e AS (SELECT event_id, event_id % 12 AS n, event_id * 37 % 1920 AS px, event_id * 53 % 1080 AS py FROM events),
l AS (SELECT *, (px - {CX}::DOUBLE) / {FX}::DOUBLE AS u, (py - {CY}::DOUBLE) / {FY}::DOUBLE AS v, n * -0.001::DOUBLE AS k1, n * 0.0001::DOUBLE AS k2, (n % 3 - 1) * 0.0003::DOUBLE AS p1, (n % 4 - 2) * 0.0002::DOUBLE AS p2, n * 0.00001::DOUBLE AS k3,
  radians(n * 30::DOUBLE) AS a, radians(-98::DOUBLE - n * 2) AS t, radians((n % 5 - 2)::DOUBLE) AS o FROM e),
i AS (SELECT *, 0 AS step, u AS x, v AS y FROM l UNION ALL
  SELECT event_id, n, px, py, u, v, k1, k2, p1, p2, k3, a, t, o, step + 1, (u - (2 * p1 * x * y + p2 * (q + 2 * x * x))) / (1 + k1 * q + k2 * q * q + k3 * q * q * q), (v - (p1 * (q + 2 * y * y) + 2 * p2 * x * y)) / (1 + k1 * q + k2 * q * q + k3 * q * q * q) FROM (SELECT *, x * x + y * y AS q FROM i WHERE step < 10)),
m AS (SELECT *, cos(a) * cos(o) + sin(a) * sin(t) * sin(o) AS m11, sin(a) * cos(t) AS m12, cos(a) * sin(o) - sin(a) * sin(t) * cos(o) AS m13, -sin(a) * cos(o) + cos(a) * sin(t) * sin(o) AS m21, cos(a) * cos(t) AS m22, -sin(a) * sin(o) - cos(a) * sin(t) * cos(o) AS m23, -cos(t) * sin(o) AS m31, sin(t) AS m32, cos(t) * cos(o) AS m33 FROM i WHERE step = 10),
w AS (SELECT *, m11 * x + m12 * y + m13 AS wx, m21 * x + m22 * y + m23 AS wy, m31 * x + m32 * y + m33 AS wz, sqrt(x * x + y * y + 1) AS s FROM m),
g AS (SELECT *, CASE WHEN abs(wz / s) >= 1e-6 AND -(n + 6) / wz > 0 THEN -(n + 6) / wz END AS f FROM w)
SELECT event_id, round(wx / s, 6) AS ray_x, round(wy / s, 6) AS ray_y, round(wz / s, 6) AS ray_z, round(n * 40 + f * wx, 2) AS ground_x, round(n * 25 + f * wy, 2) AS ground_y, CASE WHEN f IS NOT NULL THEN 0 END::BIGINT AS off FROM g"""
    }


QUERIES = (lens_positions,)
