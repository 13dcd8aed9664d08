"""Cameras laid out on a site: along its border by arc length, on a lattice inside, on a ring for those that move; dealt to nodes in turn. Every place is computed from its number alone, so a site of any size is one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.sources.views import read

#: Nodes, margin of the lattice in metres, the ring's share of the sides, and pitches in degrees by role.
NODES, MARGIN, RING = 8, 150.0, 0.34
PITCH = {"perimeter": -8.0, "interior": -10.0, "moving": -6.0}
#: Heights of mounts in metres.
HEIGHT = {"perimeter": 6.0, "interior": 6.0, "moving": 8.0}


def _inward(x: Column, y: Column) -> Column:
    """Compass direction from a place to the site's middle, [0, 360), to hundredths."""
    return F.round(F.pmod(F.degrees(F.atan2(F.col("width") / 2 - x, F.col("depth") / 2 - y)), F.lit(360.0)), 2)


def place(cameras: DataFrame) -> DataFrame:
    """cameras (role, n from 0, of how many of its role, width, depth of the site) with x, y, z, yaw and pitch.

    Along the border cameras stand in the middle of equal parts of its length, from the lower left
    corner on, the lower side first; inside they stand in rows as near square as the site, from its
    lower left; moving ones on an ellipse, from the east on. All look at the middle. Nulls give nulls.
    """
    w, d, n, of = (F.col(c).cast("double") for c in ("width", "depth", "n", "of"))
    along = 2 * (w + d) * (n + 0.5) / of
    border_x = F.when(along <= w, along).when(along <= w + d, w).when(along <= 2 * w + d, 2 * w + d - along).otherwise(0.0)
    border_y = F.when(along <= w, 0.0).when(along <= w + d, along - w).when(along <= 2 * w + d, d).otherwise(2 * (w + d) - along)
    columns = F.greatest(F.lit(1), F.ceil(F.sqrt(of * w / d)))
    rows = F.ceil(of / columns)
    column, row = n % columns, F.floor(n / columns) % rows
    inside = lambda side, at, many: MARGIN + (side - 2 * MARGIN) * (at + 0.5) / many
    turn = 2 * math.pi * n / of
    role = lambda a, b, c: F.when(F.col("role") == "perimeter", a).when(F.col("role") == "interior", b).otherwise(c)
    out = cameras.withColumn("x", role(border_x, inside(w, column, columns), w / 2 + w * RING * F.cos(turn)))
    out = out.withColumn("y", role(border_y, inside(d, row, rows), d / 2 + d * RING * F.sin(turn)))
    return out.withColumns({"z": role(*map(F.lit, HEIGHT.values())), "yaw": _inward(F.col("x"), F.col("y")), "pitch": role(*map(F.lit, PITCH.values()))})


def site_columns(suppliers: DataFrame) -> DataFrame:
    """A site per nation, of its own width and depth, with a camera per supplier: every fifth moves, of the others two fifths stand inside."""
    k, site = F.col("s_suppkey"), F.col("s_nationkey")
    c = suppliers.select(k.alias("camera"), site.alias("site"), (900 + site * 20).cast("double").alias("width"), (600 + site * 35 % 400).cast("double").alias("depth"), F.when(k % 5 == 0, "moving").when(k % 5 >= 3, "interior").otherwise("perimeter").alias("role"))
    same = Window.partitionBy("site", "role")
    return c.withColumn("n", F.row_number().over(same.orderBy("camera")) - 1).withColumn("of", F.count(F.lit(1)).over(same))


def site_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every camera with its place and pose, and its node: a site's cameras go to the nodes in turn, the fixed ones first, so that no node gets all that move."""
    c = place(site_columns(read(spark, sf_dir, "supplier")))
    order = Window.partitionBy("site").orderBy(F.when(F.col("role") == "perimeter", 0).when(F.col("role") == "interior", 1).otherwise(2), "camera")
    r = lambda x: F.round(x, 2).alias(x)
    return c.withColumn("at", F.row_number().over(order) - 1).select("site", "camera", "role", r("x"), r("y"), "z", "yaw", "pitch", F.format_string("node-%02d", (F.col("at") % NODES).cast("int")).alias("node"))


def site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coverage report per site: cameras by role, nodes in use with the most and least loaded, and the widest gap along the border between neighbours, in metres."""
    c = site_cameras(spark, sf_dir)
    count = lambda role: F.count_if(F.col("role") == role).alias(role)
    load = c.groupBy("site", "node").agg(F.count(F.lit(1)).alias("n"), *[count(r) for r in PITCH])
    per = load.groupBy("site").agg(F.sum("n").alias("cameras"), *[F.sum(r).alias(r) for r in PITCH], F.count(F.lit(1)).alias("nodes"), F.max("n").alias("most"), F.min("n").alias("least"), F.max("moving").alias("most_moving"))
    gap = F.round(2 * (F.col("width") + F.col("depth")) / F.col("of"), 2)
    gaps = site_columns(read(spark, sf_dir, "supplier")).where("role = 'perimeter'").groupBy("site").agg(F.max(gap).alias("gap_m"))
    return per.join(gaps, "site", "left")


def oracles(_views: str) -> dict[str, str]:
    """SQL of both; places along the border by walking its four sides."""
    base = f"""WITH s AS (SELECT s_suppkey AS camera, s_nationkey AS site, (900 + s_nationkey * 20)::DOUBLE AS width, (600 + s_nationkey * 35 % 400)::DOUBLE AS depth, CASE WHEN s_suppkey % 5 = 0 THEN 'moving' WHEN s_suppkey % 5 >= 3 THEN 'interior' ELSE 'perimeter' END AS role FROM supplier),
k AS (SELECT *, (row_number() OVER (PARTITION BY site, role ORDER BY camera) - 1)::DOUBLE AS n, (count(*) OVER (PARTITION BY site, role))::DOUBLE AS m FROM s),
sides AS (SELECT * FROM (VALUES (0, 0, 0, 1, 0), (1, 1, 0, 1, 1), (2, 1, 1, 0, 1), (3, 0, 1, 0, 0)) t(side, ax, ay, ex, ey)),
walk AS (SELECT k.*, side, ax * width AS px, ay * depth AS py, ex * width AS qx, ey * depth AS qy, CASE WHEN side % 2 = 0 THEN width ELSE depth END AS len, CASE side WHEN 0 THEN 0 WHEN 1 THEN width WHEN 2 THEN width + depth ELSE 2 * width + depth END AS before, 2 * (width + depth) * (n + 0.5::DOUBLE) / m AS goal FROM k, sides WHERE role = 'perimeter'),
edge AS (SELECT camera, arg_min(px + (qx - px) * (goal - before) / len, side) AS x, arg_min(py + (qy - py) * (goal - before) / len, side) AS y FROM walk WHERE before + len >= goal GROUP BY 1),
lat AS (SELECT *, greatest(1, ceil(sqrt(m * width / depth))) AS cols FROM k WHERE role = 'interior'),
xy AS (SELECT k.*, edge.x, edge.y FROM k JOIN edge USING (camera)
  UNION ALL SELECT camera, site, width, depth, role, n, m, {MARGIN} + (width - {2 * MARGIN}) * (n % cols + 0.5::DOUBLE) / cols, {MARGIN} + (depth - {2 * MARGIN}) * (floor(n / cols) % ceil(m / cols) + 0.5::DOUBLE) / ceil(m / cols) FROM lat
  UNION ALL SELECT *, width / 2 + width * {RING} * cos(2 * pi() * n / m), depth / 2 + depth * {RING} * sin(2 * pi() * n / m) FROM k WHERE role = 'moving'),
cams AS (SELECT site, camera, role, round(x, 2) AS x, round(y, 2) AS y, CASE role WHEN 'perimeter' THEN 6.0 WHEN 'interior' THEN 6.0 ELSE 8.0 END::DOUBLE AS z, round((degrees(atan2(width / 2 - x, depth / 2 - y)) + 360) % 360, 2) AS yaw, CASE role WHEN 'perimeter' THEN -8.0 WHEN 'interior' THEN -10.0 ELSE -6.0 END::DOUBLE AS pitch,
  printf('node-%02d', (row_number() OVER (PARTITION BY site ORDER BY CASE role WHEN 'perimeter' THEN 0 WHEN 'interior' THEN 1 ELSE 2 END, camera) - 1) % {NODES}) AS node FROM xy)
"""
    return {
        "site_cameras": base + "SELECT * FROM cams",
        "site_report": base
        + ", load AS (SELECT site, node, count(*) AS n, count(*) FILTER (role = 'moving') AS mv FROM cams GROUP BY 1, 2), g AS (SELECT site, max(round(2 * (width + depth) / m, 2)) AS gap_m FROM k WHERE role = 'perimeter' GROUP BY 1), r AS (SELECT site, count(*) AS cameras, count(*) FILTER (role = 'perimeter') AS perimeter, count(*) FILTER (role = 'interior') AS interior, count(*) FILTER (role = 'moving') AS moving FROM cams GROUP BY 1) SELECT r.*, nodes, most, least, most_moving, gap_m FROM r JOIN (SELECT site, count(*) AS nodes, max(n) AS most, min(n) AS least, max(mv)::BIGINT AS most_moving FROM load GROUP BY 1) USING (site) LEFT JOIN g USING (site)",
    }


QUERIES = (site_cameras, site_report)
