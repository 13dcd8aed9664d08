"""Cameras on a site: where their views lie, who sees a point, overlaps, blind zones, hand-over candidates and poses. Views are laid out in small grid cells, and points meet the views of their cell; only cells on a view's border need a test.

Cameras of one pose and targets of one place go through the geometry once, as a lot, and are told apart
after it (see alike). Joins whose sides are made by generators are hinted: Spark takes them for as small
as the file they come from and would broadcast them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.sources.views import read

#: Image size and focal length in pixels, reach in metres, border points per side.
WIDTH, HEIGHT, FOCAL, REACH, SIDE = 1920, 1080, 850.0, 320.0, 16
#: Side in metres of the grid cells in which views are laid out, and how far beside a cell's edge counts as on it.
CELL, EDGE = 20.0, 1e-6
#: Zones to be watched: name, height and corners.
ZONES = (
    ("gate", 0.0, ((80, 80), (160, 80), (160, 140), (80, 140))),
    ("hall", 0.0, ((400, 420), (560, 420), (560, 500), (480, 560), (400, 500))),
    ("tower", 0.0, ((800, 760), (860, 760), (830, 820))),
    ("yard", 0.0, ((600, 100), (900, 100), (900, 300), (600, 300))),
    ("far", 0.0, ((2000, 2000), (2010, 2000), (2010, 2010))),
)
#: Fixed values of moving cameras: limits in degrees, zooms, speeds in degrees a second, settling seconds and overshoot.
PAN, TILT, ZOOM, SPEED, SETTLE, OVERSHOOT = (-170.0, 170.0), (-60.0, 30.0), (1.0, 20.0), (80.0, 40.0), 0.4, 0.1

#: What a camera's view depends on, the most rows of one lot, and tasks to a core where lots become rows.
POSE, LOT, TASKS = ("x", "y", "z", "yaw", "pitch"), 1000, 16


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera per supplier: place, yaw (clockwise from north) and pitch in degrees, node, whether it moves, is enabled, and its declared horizon."""
    k = F.col("s_suppkey")
    d = lambda c: c.cast("double")
    return read(spark, sf_dir, "supplier").select(k.alias("camera"), d(k * 37 % 1000).alias("x"), d(k * 53 % 1000).alias("y"), d(k % 4 + 6).alias("z"), d(k * 41 % 360).alias("yaw"), d(k * 7 % 20 - 12).alias("pitch"), (F.col("s_nationkey") % 8).alias("node"), (k % 4 == 0).alias("moves"), (k % 9 != 0).alias("enabled"), F.when(k % 10 == 0, 0.4).alias("declared"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target per customer: place, velocity in metres a second and height."""
    k, d = F.col("c_custkey"), lambda c: c.cast("double")
    return read(spark, sf_dir, "customer").select(k.alias("target"), d(k * 17 % 1000).alias("tx"), d(k * 29 % 1000).alias("ty"), d(k % 7 - 3).alias("vx"), d(k % 5 - 2).alias("vy"), d(k % 30).alias("tz"))


def alike(rows: DataFrame, number: str, *by: str) -> DataFrame:
    """Rows equal in `by` as lots: (by, number: the smallest of its numbers, number + "s": all of them, LOT at the most). A number is in one lot, and more equal rows make more lots."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(number)) - 1
    lots = rows.select(number, *by).withColumn("_lot", F.floor(at / LOT)).groupBy(*by, "_lot")
    return lots.agg(F.min(number).alias(number), F.sort_array(F.collect_list(number)).alias(f"{number}s")).drop("_lot")


def each(lots: DataFrame, number: str) -> DataFrame:
    """Lots with a row for each of their numbers again."""
    return lots.withColumn(number, F.explode(f"{number}s")).drop(f"{number}s")


def dealt(lots: DataFrame, number: str) -> DataFrame:
    """Lots dealt by their number before each() makes rows of them. Spark merges partitions by their bytes, which are few here, into about one to a core; where two are left to one core, the others wait for it. A given number of them is kept."""
    return lots.repartition(TASKS * lots.sparkSession.sparkContext.defaultParallelism, number)


def border(i: str) -> str:
    """SQL: struct (x, y) of the i-th of the image's border pixels, in order round it."""
    n = SIDE - 1
    w, h = float(WIDTH), float(HEIGHT)
    return f"case when {i} < {SIDE} then named_struct('x', {w} * {i} / {n}, 'y', 0D) when {i} < {2 * SIDE - 1} then named_struct('x', {w}D, 'y', {h} * ({i} - {n}) / {n}) when {i} < {3 * SIDE - 2} then named_struct('x', {w} * ({3 * n} - {i}) / {n}, 'y', {h}D) else named_struct('x', 0D, 'y', {h} * ({4 * n} - {i}) / {n}) end"


def view_polygon(plane: float = 0.0) -> Column:
    """Corners of what a camera sees of a horizontal plane, at most REACH away. A ray that meets the plane ends where its length says, along the ground; others at REACH; those that would meet it behind are left out."""
    p, a = "radians(pitch - 90)", "radians(yaw)"
    ray = f"named_struct('r', (b.x - {WIDTH / 2}) / {FOCAL}, 'd', (b.y - {HEIGHT / 2}) / {FOCAL})"
    turned = f"named_struct('n', sqrt(q.r * q.r + q.d * q.d + 1), 'r', q.r, 'f', cos({p}) * q.d - sin({p}), 'u', sin({p}) * q.d + cos({p}))"
    world = f"named_struct('x', (cos({a}) * w.r + sin({a}) * w.f) / w.n, 'y', (cos({a}) * w.f - sin({a}) * w.r) / w.n, 'z', w.u / w.n)"
    length = f"case when abs(v.z) < 1e-9 or v.z > 0 then {REACH}D when ({plane}D - z) / v.z > 0 then least({REACH}D, ({plane}D - z) / v.z) end"
    level = "greatest(sqrt(v.x * v.x + v.y * v.y), 1e-9D)"
    point = f"transform(array({length}), t -> if(t is null, null, named_struct('x', x + t * v.x / {level}, 'y', y + t * v.y / {level})))[0]"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    each = let(border("i"), "b", let(ray, "q", let(turned, "w", let(world, "v", point))))
    return F.expr(f"array_compact(transform(sequence(0, {4 * SIDE - 5}), i -> {each}))")


def holds(polygon: str, x: str, y: str) -> str:
    """SQL: whether a polygon of structs holds a point, by the parity of the edges that a ray to the right crosses; the divisor is kept from zero."""
    a, b = f"{polygon}[e]", f"{polygon}[(e + size({polygon}) - 1) % size({polygon})]"
    crossing = f"({a}.y > {y}) <> ({b}.y > {y}) and {x} < {a}.x + ({y} - {a}.y) / (({b}.y - {a}.y) + 1e-9D) * ({b}.x - {a}.x)"
    return f"(size({polygon}) >= 3 and aggregate(sequence(0, size({polygon}) - 1), 0, (s, e) -> s + if({crossing}, 1, 0)) % 2 = 1)"


def with_views(cams: DataFrame, plane: float = 0.0) -> DataFrame:
    """Cameras with the corners of what they see. The rows are few and dear, so they are dealt over all cores; past the generator Catalyst doesn't write the polygon out again for each of its uses."""
    cores = cams.sparkSession.sparkContext.defaultParallelism
    return cams.repartition(cores, "camera").withColumn("polygon", F.explode(F.array(view_polygon(plane))))


def horizon() -> Column:
    """Row of the horizon as a share of the image's height: the declared one, else from the pitch, within the image."""
    p = F.radians(F.col("pitch") - 90)
    row = (HEIGHT / 2 + FOCAL * (-F.cos(p) / F.sin(p))) / HEIGHT
    return F.coalesce(F.col("declared"), F.when(F.abs(F.sin(p)) < 1e-6, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), row))))


def camera_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each camera's view: corners, area, centroid, bounds, opening angles and horizon."""
    v = with_views(alike(cameras(spark, sf_dir), "camera", *POSE, "declared"))
    n = "size(polygon)"
    cross = "(polygon[i].x * polygon[(i + 1) % size(polygon)].y - polygon[(i + 1) % size(polygon)].x * polygon[i].y)"
    total = lambda term: F.expr(f"aggregate(sequence(0, {n} - 1), 0D, (s, i) -> s + {term})")
    v = v.where(f"{n} >= 3").withColumn("twice", total(cross)).withColumn("mx", total("polygon[i].x") / F.expr(n)).withColumn("my", total("polygon[i].y") / F.expr(n))
    flat = F.abs(F.col("twice")) < 2e-9
    centre = lambda c, m: F.when(flat, F.col(m)).otherwise(total(f"(polygon[i].{c} + polygon[(i + 1) % size(polygon)].{c}) * {cross}") / (3 * F.col("twice")))
    bound = lambda f, c: f(F.expr(f"transform(polygon, p -> p.{c})"))
    angle = lambda px: math.degrees(2 * math.atan(px / (2 * FOCAL)))
    r = lambda c, n: F.round(c, 4).alias(n)
    out = v.select("cameras", F.expr(n).alias("corners"), r(F.abs("twice") / 2, "area"), r(centre("x", "mx"), "cx"), r(centre("y", "my"), "cy"), r(bound(F.array_min, "x"), "min_x"), r(bound(F.array_max, "x"), "max_x"), r(bound(F.array_min, "y"), "min_y"), r(bound(F.array_max, "y"), "max_y"), F.lit(round(angle(WIDTH), 6)).alias("hfov"), F.lit(round(angle(HEIGHT), 6)).alias("vfov"), r(horizon(), "horizon"))
    return each(out, "camera").select("camera", *out.columns[1:])


def view_edges(views: DataFrame) -> DataFrame:
    """views (camera, polygon) -> (camera, ax, ay, bx, by), a row per edge. Rows keep the tests over edges in generated code, which a lambda over the polygon isn't."""
    n = "size(polygon)"
    edge = F.expr(f"transform(sequence(0, {n} - 1), i -> named_struct('ax', polygon[i].x, 'ay', polygon[i].y, 'bx', polygon[(i + 1) % {n}].x, 'by', polygon[(i + 1) % {n}].y))")
    return views.where(f"{n} >= 3").select("camera", F.explode(edge).alias("e")).select("camera", "e.*")


def view_cells(views: DataFrame, cell: float = CELL) -> DataFrame:
    """views (camera, polygon) -> (camera, gx, gy, whole): the cells that each polygon touches. A cell that no edge touches lies inside as a whole or not at all, as its middle does.

    An edge's cells come row by row of the grid, from where it enters a row to where it leaves it; the
    insides from where the edges cross the row's middle, the first crossing to the second and so on.
    """
    e = view_edges(views)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    at = lambda y: F.when(F.col("by") == F.col("ay"), F.col("ax")).otherwise(F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")))
    index = lambda c, off=0.0: F.floor((c + off) / cell)
    rows = e.withColumn("gy", F.explode(F.sequence(index(low, -EDGE), index(high, EDGE))))
    into, out = F.greatest(low, F.col("gy") * cell - EDGE), F.least(high, (F.col("gy") + 1) * cell + EDGE)
    level = F.col("by") == F.col("ay")
    x0, x1 = F.when(level, F.col("ax")).otherwise(at(into)), F.when(level, F.col("bx")).otherwise(at(out))
    border = rows.withColumn("gx", F.explode(F.sequence(index(F.least(x0, x1), -EDGE), index(F.greatest(x0, x1), EDGE)))).select("camera", "gx", "gy", F.lit(False).alias("whole"))
    middle = (F.col("gy") + 0.5) * cell
    crossed = rows.where((F.col("ay") > middle) != (F.col("by") > middle)).groupBy("camera", "gy").agg(F.array_sort(F.collect_list(at(middle))).alias("xs"))
    pair = F.explode(F.expr("transform(sequence(0, size(xs) div 2 - 1), i -> named_struct('a', xs[2 * i], 'b', xs[2 * i + 1]))"))
    first, last = F.ceil(F.col("p.a") / cell - 0.5), F.floor(F.col("p.b") / cell - 0.5)
    inside = crossed.select("camera", "gy", pair.alias("p")).where(first <= last).select("camera", F.explode(F.sequence(first, last)).alias("gx"), "gy", F.lit(True).alias("whole"))
    # a cell that any edge touches is tested
    return border.unionByName(inside).groupBy("camera", "gx", "gy").agg(F.min("whole").alias("whole"))


def _seen(points: DataFrame, views: DataFrame, x: str, y: str) -> DataFrame:
    """Points with the views that hold them, without their polygons: places joined by cell, and only in cells on a border tested against the edges, by the parity of those that a ray to the right crosses. Points of one place are one in this."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    thin = views.select("camera", "polygon")
    places = points.select(x, y).distinct().withColumn("gx", cell(x)).withColumn("gy", cell(y))
    met = places.join(view_cells(thin).hint("merge"), ["gx", "gy"]).drop("gx", "gy")
    px, py = F.col(x), F.col(y)
    across = ((F.col("ay") > py) != (F.col("by") > py)) & (px < F.col("ax") + (py - F.col("ay")) / ((F.col("by") - F.col("ay")) + 1e-9) * (F.col("bx") - F.col("ax")))
    border = met.where(~F.col("whole")).join(view_edges(thin).hint("merge"), "camera").where(across)
    border = border.groupBy(x, y, "camera").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")
    hits = met.where("whole").drop("whole").unionByName(border)
    return points.join(hits.hint("merge"), [x, y]).join(views.drop("polygon").hint("merge"), "camera").select(*points.columns, *[c for c in views.columns if c != "polygon"])


def _within(points: DataFrame, cams: DataFrame, x: str, y: str, reach: float) -> DataFrame:
    """Points with the cameras at most `reach` metres away: by cells of a tenth of the reach, of which a camera has those that its circle touches."""
    side = reach / 10
    cell = lambda c: F.floor(F.col(c) / side)
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    gap = lambda c, g: F.greatest(F.lit(0.0), g * side - F.col(c), F.col(c) - (g + 1) * side)
    spread = cams.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    spread = spread.where(gap("x", F.col("gx")) * gap("x", F.col("gx")) + gap("y", F.col("gy")) * gap("y", F.col("gy")) <= (reach + EDGE) * (reach + EDGE))
    near = (F.col(x) - F.col("x")) * (F.col(x) - F.col("x")) + (F.col(y) - F.col("y")) * (F.col(y) - F.col("y")) <= (reach + EDGE) * (reach + EDGE)
    return points.withColumn("gx", cell(x)).withColumn("gy", cell(y)).join(spread.hint("merge"), ["gx", "gy"]).drop("gx", "gy").where(near)


def kept(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag holds. A generator drops the others: past it Catalyst doesn't push the predicate, which would write out every expression behind the flag again for each of its uses."""
    return df.withColumn("_kept", F.explode(F.when(F.col(flag), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))).drop("_kept")


def cameras_seeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target: the enabled cameras that see its place, fixed ones and all."""
    v = with_views(alike(cameras(spark, sf_dir).where("enabled"), "camera", *POSE, "moves"))
    places = alike(targets(spark, sf_dir), "target", "tx", "ty")
    hits = _seen(places.select("target", "tx", "ty"), v.select("camera", "cameras", "moves", "polygon"), "tx", "ty")
    seen = each(hits, "camera").groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("camera")), ",").alias("cameras"), F.count_if(~F.col("moves")).alias("fixed"))
    out = places.join(seen.hint("merge"), "target", "left").select("targets", F.coalesce("cameras", F.lit("")).alias("cameras"), F.coalesce("fixed", F.lit(0)).alias("fixed"))
    return each(out, "target").select("target", "cameras", "fixed")


def camera_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cameras whose views' bounds share more than 1 square metre and 2 % of the smaller."""
    bound = lambda f, c: F.expr(f"{f}(transform(polygon, p -> p.{c}))")
    v = with_views(alike(cameras(spark, sf_dir), "camera", *POSE)).where("size(polygon) >= 3").select("camera", "cameras", bound("array_min", "x").alias("x1"), bound("array_max", "x").alias("x2"), bound("array_min", "y").alias("y1"), bound("array_max", "y").alias("y2"))
    # bounds that meet share cells; a pair of lots, or a lot with itself, counts in the lowest of them alone
    side = REACH
    cell = lambda c: F.floor(F.col(c) / side)
    spread = v.withColumn("gx", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("gy", F.explode(F.sequence(cell("y1"), cell("y2"))))
    a, b = spread.select("gx", "gy", *[F.col(c).alias(f"a_{c}") for c in v.columns]), spread.hint("merge")
    w = F.greatest(F.lit(0.0), F.least("a_x2", "x2") - F.greatest("a_x1", "x1"))
    h = F.greatest(F.lit(0.0), F.least("a_y2", "y2") - F.greatest("a_y1", "y1"))
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    lowest = (F.col("gx") == F.greatest(cell("a_x1"), cell("x1"))) & (F.col("gy") == F.greatest(cell("a_y1"), cell("y1")))
    pairs = a.join(b, ["gx", "gy"]).where((F.col("a_camera") <= F.col("camera")) & lowest).withColumn("shared", w * h).withColumn("ratio", F.col("shared") / F.greatest(F.least(area("a_"), area("")), F.lit(1e-6)))
    pairs = pairs.where("shared > 1 and ratio > 0.02").select("a_camera", "a_cameras", F.col("camera").alias("b_camera"), F.col("cameras").alias("b_cameras"), F.round("shared", 3).alias("shared"), F.round("ratio", 6).alias("ratio"))
    own = F.col("a_camera") == F.col("b_camera")
    two = pairs.withColumn("own", own).withColumn("i", F.explode("a_cameras")).withColumn("j", F.explode("b_cameras")).where(~F.col("own") | (F.col("i") < F.col("j")))
    return two.select(F.least("i", "j").alias("first"), F.greatest("i", "j").alias("second"), "shared", "ratio")


def _zones(spark: SparkSession) -> DataFrame:
    rows = [(n, h, [(float(x), float(y)) for x, y in c]) for n, h, c in ZONES]
    return spark.createDataFrame(rows, "zone string, height double, corners array<struct<x:double,y:double>>")


def _samples(zones: DataFrame) -> DataFrame:
    """A zone's sample points: the mean of its corners, then the corners."""
    mean = F.expr("named_struct('x', aggregate(corners, 0D, (s, c) -> s + c.x) / size(corners), 'y', aggregate(corners, 0D, (s, c) -> s + c.y) / size(corners))")
    return zones.select("zone", F.posexplode(F.concat(F.array(mean), F.col("corners")))).select("zone", F.col("pos").alias("sample"), F.col("col.x").alias("tx"), F.col("col.y").alias("ty"))


def _poses(pairs: DataFrame, height: Column) -> DataFrame:
    """Pairs of camera and point (tx, ty) with the pose that would show the point: yaw, pitch, zoom, and `within` if a moving camera's limits allow it; else with its widest zoom straight at the point."""
    dx, dy, dz = F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), height - F.col("z")
    away = F.sqrt(dx * dx + dy * dy)
    clamp = lambda c, lim: F.least(F.lit(lim[1]), F.greatest(F.lit(lim[0]), c))
    p = pairs.withColumn("distance", away).withColumn("rise", dz).withColumn("yaw_to", clamp((F.degrees(F.atan2(dx, dy)) + 540) % 360 - 180, PAN))
    p = p.withColumn("elevation", F.when(F.col("distance") < 1e-6, 0.0).otherwise(F.degrees(F.atan2("rise", "distance"))))
    zoom = F.when((F.col("distance") < 1e-3) | (F.abs("rise") < 1e-3), 1.0).otherwise(60.0 * F.col("distance") / (FOCAL * F.abs("rise")))
    p = p.withColumn("zoom_to", clamp(zoom, ZOOM))
    half = F.degrees(F.atan(HEIGHT / 2.0 / (FOCAL * F.col("zoom_to"))))
    p = p.withColumn("pitch_to", clamp(F.col("elevation") - 0.12 * half, TILT))

    def shows(pitch: Column, zoom: Column) -> Column:
        yaw, tip = F.radians("yaw_to"), F.radians(pitch)
        right, ahead = F.cos(yaw) * dx - F.sin(yaw) * dy, F.sin(yaw) * dx + F.cos(yaw) * dy
        depth, down = F.cos(tip) * ahead + F.sin(tip) * F.col("rise"), F.sin(tip) * ahead - F.cos(tip) * F.col("rise")
        ahead_only = F.when(depth > 1e-6, depth)
        px, py = FOCAL * zoom * right / ahead_only + WIDTH / 2, FOCAL * zoom * down / ahead_only + HEIGHT / 2
        return F.coalesce((depth > 1e-6) & (px >= 0) & (px < WIDTH) & (py >= 0) & (py < HEIGHT), F.lit(False))

    deep = F.col("distance") > 1e-6
    p = p.withColumn("first", deep & shows(F.col("pitch_to"), F.col("zoom_to"))).withColumn("second", deep & shows(F.col("elevation"), F.lit(ZOOM[0])))
    p = p.withColumn("within", F.col("first") | F.col("second"))
    return p.withColumn("pitch_to", F.when(F.col("first"), F.col("pitch_to")).otherwise(F.col("elevation"))).withColumn("zoom_to", F.when(F.col("first"), F.col("zoom_to")).otherwise(F.lit(ZOOM[0])))


def zone_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each zone: the enabled cameras that see one of its samples, the moving ones that could be turned to one, and whether it is covered, by fixed views or by moving cameras only."""
    cams, samples = cameras(spark, sf_dir), _samples(_zones(spark))
    seen = _seen(samples, with_views(alike(cams.where("enabled"), "camera", *POSE)).select("camera", "cameras", "polygon"), "tx", "ty").select("zone", "cameras")
    turned = kept(_poses(alike(cams.where("moves"), "camera", *POSE).crossJoin(F.broadcast(samples)), F.lit(0.0)), "within").select("zone", "cameras")
    both = each(seen.withColumn("seen", F.lit(True)).unionByName(turned.withColumn("seen", F.lit(False))), "camera")
    per = both.groupBy("zone", "camera").agg(F.max("seen").alias("seen"), F.min("seen").alias("only")).groupBy("zone").agg(F.array_sort(F.collect_list(F.when(F.col("seen"), F.col("camera")))).alias("seen"), F.count_if(~F.col("only")).alias("turned"), F.count(F.lit(1)).alias("cameras"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    out = _zones(spark).select("zone").join(per, "zone", "left").withColumn("seen", F.coalesce("seen", F.expr("cast(array() as array<bigint>)")))
    state = F.when(F.size("seen") > 0, "seen").when(F.col("turned") > 0, "moving cameras only").otherwise("uncovered")
    return out.select("zone", F.array_join("seen", ",").alias("seen"), number("turned").alias("could_turn"), number("cameras").alias("cameras"), state.alias("state"))


def node_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras of each node, the enabled ones in order, fixed and moving, with a total line of the numbers."""
    count = lambda c, n: F.count_if(c).alias(n)
    per = cameras(spark, sf_dir).groupBy("node").agg(F.count(F.lit(1)).alias("cameras"), count(~F.col("moves"), "fixed"), count(F.col("moves"), "moving"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("enabled"), F.col("camera")))), ",").alias("enabled"))
    total = per.agg(F.lit("TOTAL").alias("node"), *[F.sum(c).alias(c) for c in ("cameras", "fixed", "moving")], F.lit(None).cast("string").alias("enabled"))
    return per.withColumn("node", F.concat(F.lit("n"), F.col("node").cast("string"))).unionByName(total)


def view_exits(spark: SparkSession, sf_dir: str, samples: int = 64, horizon_m: float = 900.0, lead_s: float = 2.0) -> DataFrame:
    """For each target and camera that sees it: metres and seconds until it leaves the view (null if not within horizon_m or if it stands), whether to hand it over now, and the risk of occlusion by how many cameras see the same place."""
    lots, places = alike(cameras(spark, sf_dir), "camera", *POSE), alike(targets(spark, sf_dir), "target", "tx", "ty", "vx", "vy")
    v = with_views(lots).select("camera", F.size("cameras").alias("n"), "polygon")
    hits = _seen(places.drop("targets"), v, "tx", "ty")
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    step = horizon_m / samples
    # distances at which the way crosses the view's edges; it is outside from the first to the second, from the third to the fourth and so on
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    side = lambda q: F.col("vx") * (F.col(f"{q}y") - F.col("ty")) - F.col("vy") * (F.col(f"{q}x") - F.col("tx")) > 0
    at = ((F.col("ax") - F.col("tx")) * dy - (F.col("ay") - F.col("ty")) * dx) * speed / (F.col("vx") * dy - F.col("vy") * dx)
    ways = hits.where((F.col("vx") != 0) | (F.col("vy") != 0)).join(view_edges(v).hint("merge"), "camera").where(side("a") != side("b")).withColumn("at", at).where("at > 0").groupBy("target", "camera").agg(F.array_sort(F.collect_list("at")).alias("ways"))
    out = hits.withColumn("speed", speed).withColumn("shared", F.sum("n").over(Window.partitionBy("target")) - 1).join(ways.hint("merge"), ["target", "camera"], "left")
    probe = f"floor(ways[2 * j] / {step}D) + 1"
    first = F.expr(f"if(size(ways) > 0, array_min(transform(sequence(0, (size(ways) - 1) div 2), j -> if(2 * j + 1 >= size(ways) or ({probe}) * {step}D < ways[2 * j + 1], {probe}, null))), null)")
    out = out.withColumn("exit_m", F.when(first <= samples, first * F.lit(step))).withColumn("exit_s", F.col("exit_m") / F.col("speed"))
    out = out.select("target", "camera", F.round("exit_m", 4).alias("exit_m"), F.round("exit_s", 4).alias("exit_s"), F.coalesce(F.col("exit_s") - lead_s <= 0, F.lit(False)).alias("hand_over"), F.round(F.greatest(F.lit(0.0), 1 - F.least(F.col("shared"), F.lit(3)) / 3.0), 6).alias("occlusion"))
    # what is wide comes last, and past the last exchange
    out = dealt(out.join(lots.select("camera", "cameras").hint("merge"), "camera"), "target")
    out = out.join(dealt(places.select("target", "targets"), "target").hint("merge"), "target")
    return each(each(out, "camera"), "target").select("target", "camera", "exit_m", "exit_s", "hand_over", "occlusion")


def _rated(spark: SparkSession, sf_dir: str, places: DataFrame, most_m: float) -> DataFrame:
    """places (target, tx, ty, tz) with the lots of moving cameras within most_m that can show them: pose, acquire_s and score."""
    movers = alike(cameras(spark, sf_dir).where("moves and enabled"), "camera", *POSE)
    p = _poses(_within(places, movers, "tx", "ty", most_m), F.col("tz"))
    p = kept(p.where(F.col("distance") <= most_m), "within")
    pan = F.abs((F.col("yaw_to") - F.col("yaw") + 540 + 360) % 360 - 180)
    tilt = F.abs(F.col("pitch_to") - F.col("pitch"))
    slew = F.sqrt(F.pow(pan / SPEED[0], 2) + F.pow(tilt / SPEED[1], 2))
    p = p.withColumn("acquire_s", slew + SETTLE * (1 + OVERSHOOT))
    return p.withColumn("score", F.least(F.lit(1.0), 0.5 / (1 + F.col("distance") / 150) + 0.5 / (1 + F.col("acquire_s") / 2)))


def handover_candidates(spark: SparkSession, sf_dir: str, most_m: float = 250.0) -> DataFrame:
    """For each target the moving cameras within most_m that can show it, with the pose, how far and long they must turn, and their score, the best first."""
    places = alike(targets(spark, sf_dir), "target", "tx", "ty", "tz")
    shown = ("distance", "yaw_to", "pitch_to", "zoom_to", "acquire_s", "score")
    lots = _rated(spark, sf_dir, places.drop("targets"), most_m).select("target", "cameras", F.round("score", 9).alias("by"), *[F.round(c, 5).alias(c) for c in shown])
    w = Window.partitionBy("target").orderBy(F.desc("by"), "camera")
    p = each(dealt(lots, "target"), "camera").withColumn("rank", F.row_number().over(w))
    p = p.join(dealt(places.select("target", "targets"), "target").hint("merge"), "target")
    return each(p, "target").select("target", "camera", "rank", *shown)


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearing, elevation and distance of each target from the camera of its number, the camera's yaw unwrapped to be nearest to it, and the angles at which a turn there stops on its way, 170 degrees apart at most."""
    t = targets(spark, sf_dir).withColumn("n", F.col("target") % 100 + 1)
    p = t.join(cameras(spark, sf_dir), F.col("n") == F.col("camera"))
    dx, dy, dz = F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.col("tz") - F.col("z")
    away = F.sqrt(dx * dx + dy * dy)
    wrap = lambda c: F.pmod(c + math.pi, F.lit(2 * math.pi)) - math.pi
    p = p.withColumn("bearing", F.atan2(dx, dy)).withColumn("turn", F.degrees(wrap(F.col("bearing") - F.radians("yaw"))))
    stops = F.greatest(F.lit(1), F.ceil(F.abs(F.col("turn")) / 170.0)).cast("int")
    return p.select("target", F.round(F.degrees("bearing"), 5).alias("bearing"), F.round(F.when(away < 1e-6, 0.0).otherwise(F.degrees(F.atan2(dz, away))), 5).alias("elevation"), F.round(away, 5).alias("distance"), F.round(F.col("yaw") + F.col("turn"), 5).alias("unwrapped"), stops.alias("stops"), F.round(F.col("yaw") + F.col("turn") / stops, 5).alias("first_stop"))


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each target's way of the next 60 s crosses a fence line, and how far along its velocity it meets a box, null where it doesn't."""
    t = targets(spark, sf_dir)
    x1, y1, x2, y2 = F.col("tx"), F.col("ty"), F.col("tx") + 60 * F.col("vx"), F.col("ty") + 60 * F.col("vy")
    x3, y3, x4, y4 = 500.0, 0.0, 450.0, 1000.0
    den = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    ok = F.abs(den) >= 1e-9
    along = F.when(ok, ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / den)
    other = F.when(ok, -((x1 - x2) * (y1 - y3) - (y1 - y2) * (x1 - x3)) / den)
    cross = along.between(0, 1) & other.between(0, 1)
    low, high = 300.0, 700.0
    slab = lambda p, v: (F.when(F.col(v) != 0, (low - F.col(p)) / F.col(v)), F.when(F.col(v) != 0, (high - F.col(p)) / F.col(v)), F.col(p).between(low, high))
    near, far, inside = [], [], []
    for p, v in (("tx", "vx"), ("ty", "vy")):
        a, b, within = slab(p, v)
        near.append(F.coalesce(F.least(a, b), F.when(within, F.lit(-1e300)).otherwise(F.lit(1e300))))
        far.append(F.coalesce(F.greatest(a, b), F.when(within, F.lit(1e300)).otherwise(F.lit(-1e300))))
    n, f = F.greatest(*near), F.least(*far)
    moving = (F.col("vx") != 0) | (F.col("vy") != 0)
    hit = F.when(moving & (n <= f) & (f >= 0), F.greatest(n, F.lit(0.0)))
    return t.select("target", F.round(F.when(cross, x1 + along * (x2 - x1)), 5).alias("x"), F.round(F.when(cross, y1 + along * (y2 - y1)), 5).alias("y"), F.round(hit, 5).alias("box_s"))


def zone_shares(spark: SparkSession, sf_dir: str, steps: int = 64) -> DataFrame:
    """What share of each zone lies in each camera's view, by a grid of samples over the zone, a metre apart at least; only cameras with a share."""
    z = _zones(spark).withColumn("x1", F.expr("array_min(transform(corners, c -> c.x))")).withColumn("x2", F.expr("array_max(transform(corners, c -> c.x))")).withColumn("y1", F.expr("array_min(transform(corners, c -> c.y))")).withColumn("y2", F.expr("array_max(transform(corners, c -> c.y))"))
    z = z.withColumn("step", F.greatest(F.lit(1.0), F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / steps))
    axis = lambda a, b: F.transform(F.sequence(F.lit(0), (F.ceil((F.col(b) - F.col(a)) / F.col("step")) - 1).cast("int")), lambda i: F.col(a) + i * F.col("step"))
    grid = z.select("zone", "corners", F.explode(axis("x1", "x2")).alias("tx"), "y1", "y2", "step").select("zone", "corners", "tx", F.explode(axis("y1", "y2")).alias("ty")).where(holds("corners", "tx", "ty"))
    total = grid.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    lots = alike(cameras(spark, sf_dir), "camera", *POSE)
    hits = _seen(grid.select("zone", "tx", "ty"), with_views(lots).select("camera", "polygon"), "tx", "ty").groupBy("zone", "camera").agg(F.count(F.lit(1)).alias("k"))
    shares = hits.join(F.broadcast(total), "zone").select("zone", "camera", F.round(F.col("k") / F.col("n"), 6).alias("share"))
    return each(shares.join(lots.select("camera", "cameras").hint("merge"), "camera"), "camera").select("zone", "camera", "share")


def _sweep() -> Column:
    """How far a camera is from looking at (tx, ty, height): the angles' root of squares, not wrapped."""
    return F.sqrt(F.pow(F.col("yaw_to") - F.col("yaw"), 2) + F.pow(F.col("elevation") - F.col("pitch"), 2))


def search_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras to search a lost target with: those that see its place, by distance and 25 m for each second they need to turn there, ties by number."""
    v = with_views(alike(cameras(spark, sf_dir).where("enabled"), "camera", *POSE, "moves"))
    places = alike(targets(spark, sf_dir), "target", "tx", "ty")
    hits = _seen(places.drop("targets"), v, "tx", "ty")
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    turn = F.abs((F.degrees(F.atan2(dx, dy)) + 540) % 360 - 180 - F.col("yaw")) / SPEED[0] + SETTLE
    score = F.round(F.sqrt(dx * dx + dy * dy) + F.when(F.col("moves"), turn).otherwise(0.0) * 25, 6)
    w = Window.partitionBy("target").orderBy("score", "camera")
    ranked = each(dealt(hits.select("target", "cameras", score.alias("score")), "target"), "camera").withColumn("rank", F.row_number().over(w))
    return each(ranked.join(dealt(places.select("target", "targets"), "target").hint("merge"), "target"), "target").select("target", "camera", "score", "rank")


def restore_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each zone that no camera sees: the moving camera that has the least way to turn to its middle, less twice the zone's priority; null where none can."""
    unseen = zone_watch(spark, sf_dir).where("state <> 'seen'").select("zone")
    order = spark.createDataFrame([(z[0], float(i + 1)) for i, z in enumerate(ZONES)], "zone string, priority double")
    middle = _samples(_zones(spark)).where("sample = 0").join(unseen, "zone").join(order, "zone")
    movers = alike(cameras(spark, sf_dir).where("moves"), "camera", *POSE).drop("cameras")
    p = kept(_poses(movers.crossJoin(F.broadcast(middle)), F.lit(0.0)), "within").withColumn("score", F.round(_sweep() - 2 * F.col("priority"), 6))
    best = p.groupBy("zone").agg(F.min(F.struct("score", "camera")).alias("b"))
    return unseen.join(best, "zone", "left").select("zone", "b.camera", "b.score")


def preposition_tasks(spark: SparkSession, sf_dir: str, lead_s: float = 3.0) -> DataFrame:
    """For each moving target, the moving camera within reach of where it will be in lead_s seconds that is to be turned there: the least of distance and 25 m for each degree to turn."""
    places = alike(targets(spark, sf_dir).where("vx <> 0 or vy <> 0"), "target", "tx", "ty", "vx", "vy", "tz")
    t = places.select("target", (F.col("tx") + F.col("vx") * lead_s).alias("tx"), (F.col("ty") + F.col("vy") * lead_s).alias("ty"), "tz")
    # of cameras of one pose the first is taken
    movers = alike(cameras(spark, sf_dir).where("moves and enabled"), "camera", *POSE).drop("cameras")
    p = _poses(_within(t, movers, "tx", "ty", REACH), F.col("tz"))
    p = kept(p.where(F.col("distance") <= REACH), "within")
    best = p.withColumn("score", F.round(F.col("distance") + 25 * _sweep(), 5)).groupBy("target").agg(F.min(F.struct("score", "camera")).alias("b"))
    return each(best.join(places.select("target", "targets").hint("merge"), "target"), "target").select("target", "b.camera", "b.score")


def turn_schedule(spark: SparkSession, sf_dir: str, frame: int = 10) -> DataFrame:
    """What becomes of the best hand-over of each target in one cycle: tasks go by priority and then urgency; a camera takes the first that is due, later ones wait while it settles, and none may take it from a zone that it alone watches, unless it sees the target already."""
    places = alike(targets(spark, sf_dir), "target", "tx", "ty", "tz")
    best = _rated(spark, sf_dir, places.drop("targets"), 250.0).groupBy("target").agg(F.min(F.struct(-F.round("score", 9), "camera")).alias("b")).select("target", "b.camera")
    cams = cameras(spark, sf_dir)
    middle = _samples(_zones(spark)).where("sample = 0")
    watch = _seen(middle, with_views(alike(cams.where("enabled"), "camera", *POSE)).select("camera", F.size("cameras").alias("many"), "polygon"), "tx", "ty")
    alone = watch.groupBy("zone").agg(F.sum("many").alias("n"), F.min("camera").alias("camera")).where("n = 1").select("camera").distinct().withColumn("alone", F.lit(True))
    # a place's best camera sees it or not, whichever target is there
    j = with_views(best.join(places.hint("merge"), "target").join(cams.select("camera", *POSE).hint("merge"), "camera")).join(F.broadcast(alone), "camera", "left")
    j = each(j.select("targets", "camera", "alone", F.expr(holds("polygon", "tx", "ty")).alias("sees")), "target")
    j = j.withColumn("priority", F.col("target") % 4).withColumn("urgency", F.col("target") % 10).withColumn("due", F.col("target") % 3 * 5)
    j = j.withColumn("vetoed", F.coalesce("alone", F.lit(False)) & ~F.col("sees")).withColumn("ready", (F.col("due") <= frame) & ~F.col("vetoed"))
    w = Window.partitionBy("camera", "ready").orderBy("priority", F.desc("urgency"), "target")
    state = F.when(F.col("due") > frame, "deferred").when(F.col("vetoed"), "rejected").when(F.row_number().over(w) == 1, "assigned").otherwise("deferred")
    return j.select("target", "camera", "priority", "urgency", state.alias("state"), F.when(state == "assigned", F.lit(frame + max(1, int(SETTLE * (1 + OVERSHOOT) * 30)))).alias("settled_at"))


QUERIES = (search_order, restore_tasks, preposition_tasks, turn_schedule, camera_views, cameras_seeing, camera_overlaps, zone_watch, node_totals, view_exits, handover_candidates, angles, crossings, zone_shares)


def oracles(views: str) -> dict[str, str]:
    n, w, h, f, r = SIDE - 1, float(WIDTH), float(HEIGHT), FOCAL, REACH
    cams = f"""WITH cam AS (SELECT s_suppkey AS camera, (s_suppkey * 37 % 1000)::DOUBLE AS x, (s_suppkey * 53 % 1000)::DOUBLE AS y, (s_suppkey % 4 + 6)::DOUBLE AS z, (s_suppkey * 41 % 360)::DOUBLE AS yaw, (s_suppkey * 7 % 20 - 12)::DOUBLE AS pitch, s_nationkey % 8 AS node, s_suppkey % 4 = 0 AS moves, s_suppkey % 9 <> 0 AS enabled, CASE WHEN s_suppkey % 10 = 0 THEN 0.4::DOUBLE END AS declared FROM supplier),
tgt AS (SELECT c_custkey AS target, (c_custkey * 17 % 1000)::DOUBLE AS tx, (c_custkey * 29 % 1000)::DOUBLE AS ty, (c_custkey % 7 - 3)::DOUBLE AS vx, (c_custkey % 5 - 2)::DOUBLE AS vy, (c_custkey % 30)::DOUBLE AS tz FROM customer),
"""
    polygons = cams + f"""bd AS (SELECT i, CASE WHEN i < {SIDE} THEN {w}::DOUBLE * i / {n} WHEN i < {2 * SIDE - 1} THEN {w} WHEN i < {3 * SIDE - 2} THEN {w}::DOUBLE * ({3 * n} - i) / {n} ELSE 0 END AS px, CASE WHEN i < {SIDE} THEN 0 WHEN i < {2 * SIDE - 1} THEN {h}::DOUBLE * (i - {n}) / {n} WHEN i < {3 * SIDE - 2} THEN {h} ELSE {h}::DOUBLE * ({4 * n} - i) / {n} END AS py FROM range({4 * SIDE - 4}) t(i)),
q AS (SELECT *, (px - {w / 2}) / {f}::DOUBLE AS r, (py - {h / 2}) / {f}::DOUBLE AS d, radians(pitch - 90) AS p, radians(yaw) AS a FROM cam, bd),
wv AS (SELECT *, sqrt(r * r + d * d + 1) AS nn, cos(p) * d - sin(p) AS fw, sin(p) * d + cos(p) AS up FROM q),
v AS (SELECT *, (cos(a) * r + sin(a) * fw) / nn AS dx, (cos(a) * fw - sin(a) * r) / nn AS dy, up / nn AS dz FROM wv),
ln AS (SELECT *, CASE WHEN abs(dz) < 1e-9 OR dz > 0 THEN {r} WHEN (0 - z) / dz > 0 THEN least({r}, (0 - z) / dz) END AS t FROM v),
pt AS (SELECT camera, row_number() OVER (PARTITION BY camera ORDER BY i) - 1 AS i, x + t * dx / greatest(sqrt(dx * dx + dy * dy), 1e-9) AS gx, y + t * dy / greatest(sqrt(dx * dx + dy * dy), 1e-9) AS gy FROM ln WHERE t IS NOT NULL),
ed AS (SELECT camera, i, gx AS ax, gy AS ay, coalesce(lag(gx) OVER o, last_value(gx) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS bx, coalesce(lag(gy) OVER o, last_value(gy) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS "by" FROM pt WINDOW o AS (PARTITION BY camera ORDER BY i)),
bb AS (SELECT camera, min(gx) AS x1, max(gx) AS x2, min(gy) AS y1, max(gy) AS y2, count(*) AS corners FROM pt GROUP BY 1 HAVING count(*) >= 3),
"""
    inside = lambda x, y: f"sum(CASE WHEN (ay > {y}) <> (\"by\" > {y}) AND {x} < ax + ({y} - ay) / ((\"by\" - ay) + 1e-9) * (bx - ax) THEN 1 ELSE 0 END) % 2 = 1"
    seen = f"see AS (SELECT target, bb.camera FROM tgt JOIN bb ON tx BETWEEN x1 AND x2 AND ty BETWEEN y1 AND y2 JOIN ed USING (camera) GROUP BY target, bb.camera, tx, ty HAVING {inside('tx', 'ty')}),\n"
    corners = ", ".join(f"('{z}', {i}, {float(x)}::DOUBLE, {float(y)}::DOUBLE)" for z, _, c in ZONES for i, (x, y) in enumerate(c))
    zone = f"zc(zone, i, zx, zy) AS (VALUES {corners}),\nsm AS (SELECT zone, avg(zx) AS tx, avg(zy) AS ty FROM zc GROUP BY 1 UNION ALL SELECT zone, zx, zy FROM zc),\n"

    def poses(source: str, height: str) -> str:
        shown = lambda pitch, zoom: f"CASE WHEN distance > 1e-6 AND cos(radians({pitch})) * ah + sin(radians({pitch})) * rise > 1e-6 AND {f} * {zoom} * ri / (cos(radians({pitch})) * ah + sin(radians({pitch})) * rise) + {w / 2} BETWEEN 0 AND {w - 1e-9} AND {f} * {zoom} * (sin(radians({pitch})) * ah - cos(radians({pitch})) * rise) / (cos(radians({pitch})) * ah + sin(radians({pitch})) * rise) + {h / 2} BETWEEN 0 AND {h - 1e-9} THEN true ELSE false END"
        return f"""p0 AS (SELECT *, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) AS distance, {height} - z AS rise, least({PAN[1]}, greatest({PAN[0]}, (degrees(atan2(tx - x, ty - y)) + 540) % 360 - 180)) AS yaw_to FROM {source}),
p1 AS (SELECT *, CASE WHEN distance < 1e-6 THEN 0 ELSE degrees(atan2(rise, distance)) END AS elevation, least({ZOOM[1]}, greatest({ZOOM[0]}, CASE WHEN distance < 1e-3 OR abs(rise) < 1e-3 THEN 1 ELSE 60.0::DOUBLE * distance / ({f}::DOUBLE * abs(rise)) END)) AS zm, cos(radians(yaw_to)) * (tx - x) - sin(radians(yaw_to)) * (ty - y) AS ri, sin(radians(yaw_to)) * (tx - x) + cos(radians(yaw_to)) * (ty - y) AS ah FROM p0),
p2 AS (SELECT *, least({TILT[1]}, greatest({TILT[0]}, elevation - 0.12 * degrees(atan({h / 2}::DOUBLE / ({f}::DOUBLE * zm))))) AS pm FROM p1),
p3 AS (SELECT *, {shown('pm', 'zm')} AS one, {shown('elevation', str(ZOOM[0]))} AS two FROM p2),
po AS (SELECT *, one OR two AS within, CASE WHEN one THEN pm ELSE elevation END AS pitch_to, CASE WHEN one THEN zm ELSE {ZOOM[0]} END AS zoom_to FROM p3),
"""

    end = "zz AS (SELECT 1)\n"
    angle = lambda px: round(math.degrees(2 * math.atan(px / (2 * FOCAL))), 6)
    cross = "(ax * ay2 - ax2 * ay)"
    den = "((tx - (tx + 60 * vx)) * (0.0 - 1000.0) - (ty - (ty + 60 * vy)) * (500.0 - 450.0))"
    watch = polygons + zone + f"""zs AS (SELECT zone, bb.camera FROM sm JOIN bb ON tx BETWEEN x1 AND x2 AND ty BETWEEN y1 AND y2 JOIN cam ON cam.camera = bb.camera AND enabled JOIN ed ON ed.camera = bb.camera GROUP BY zone, bb.camera, tx, ty HAVING {inside('tx', 'ty')}),
"""
    sweep = "sqrt(pow(yaw_to - yaw, 2) + pow(elevation - pitch, 2))"
    orders = ", ".join(f"('{z[0]}', {i + 1})" for i, z in enumerate(ZONES))
    rated = "mv AS (SELECT tgt.*, cam.* FROM tgt, cam WHERE moves AND enabled AND sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) <= 250),\n" + poses("mv", "tz") + f"""sl AS (SELECT *, sqrt(pow(abs((yaw_to - yaw + 900) % 360 - 180) / {SPEED[0]}, 2) + pow(abs(pitch_to - pitch) / {SPEED[1]}, 2)) + {SETTLE} * {1 + OVERSHOOT}::DOUBLE AS acquire_s FROM po WHERE within),
tk AS (SELECT target, camera, tx, ty, target % 4 AS priority, target % 10 AS urgency, target % 3 * 5 AS due FROM sl QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(least(1, 0.5 / (1 + distance / 150) + 0.5 / (1 + acquire_s / 2)), 9) DESC, camera) = 1),
"""
    return {
        "search_order": polygons + seen + f"sc AS (SELECT see.target, see.camera, round(sqrt(pow(tx - x, 2) + pow(ty - y, 2)) + 25 * CASE WHEN moves THEN abs((degrees(atan2(tx - x, ty - y)) + 540) % 360 - 180 - yaw) / {SPEED[0]} + {SETTLE} ELSE 0 END, 6) AS score FROM see JOIN tgt USING (target) JOIN cam ON cam.camera = see.camera WHERE enabled) SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, camera)::INT AS rank FROM sc",
        "restore_tasks": watch + "mv AS (SELECT zone, avg(zx) AS tx, avg(zy) AS ty, cam.* FROM zc, cam WHERE moves AND zone NOT IN (SELECT zone FROM zs) GROUP BY ALL),\n" + poses("mv", "0") + f"sc AS (SELECT zone, camera, round({sweep} - 2 * o.p, 6) AS score FROM po JOIN (VALUES {orders}) o(z, p) ON o.z = zone WHERE within), un AS (SELECT DISTINCT zone FROM zc WHERE zone NOT IN (SELECT zone FROM zs)) SELECT un.zone, (SELECT arg_min(camera, score * 1000 + camera / 1000.0) FROM sc WHERE sc.zone = un.zone) AS camera, (SELECT min(score) FROM sc WHERE sc.zone = un.zone) AS score FROM un",
        "preposition_tasks": cams + "ld AS (SELECT target, tx + vx * 3 AS tx, ty + vy * 3 AS ty, tz FROM tgt WHERE vx <> 0 OR vy <> 0), mv AS (SELECT ld.*, cam.* FROM ld, cam WHERE moves AND enabled AND sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) <= 320),\n" + poses("mv", "tz") + f"sc AS (SELECT target, camera, round(distance + 25 * {sweep}, 5) AS score FROM po WHERE within) SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY target ORDER BY score, camera) = 1",
        "turn_schedule": watch.replace("FROM sm JOIN bb", "FROM (SELECT zone, avg(zx) AS tx, avg(zy) AS ty FROM zc GROUP BY 1) JOIN bb") + rated + f"""al AS (SELECT DISTINCT camera FROM (SELECT zone, min(camera) AS camera FROM zs GROUP BY 1 HAVING count(*) = 1)),
st AS (SELECT tk.target, tk.camera FROM tk JOIN ed USING (camera) GROUP BY tk.target, tk.camera, tx, ty HAVING {inside('tx', 'ty')}),
vt AS (SELECT tk.*, tk.camera IN (SELECT camera FROM al) AND (tk.target, tk.camera) NOT IN (SELECT (target, camera) FROM st) AS vetoed FROM tk),
r AS (SELECT *, due <= 10 AND NOT vetoed AS ready FROM vt), n AS (SELECT *, row_number() OVER (PARTITION BY camera, ready ORDER BY priority, urgency DESC, target) AS n FROM r),
z AS (SELECT *, CASE WHEN due > 10 THEN 'deferred' WHEN vetoed THEN 'rejected' WHEN n = 1 THEN 'assigned' ELSE 'deferred' END AS state FROM n)
SELECT target, camera, priority, urgency, state, CASE WHEN state = 'assigned' THEN {10 + max(1, int(SETTLE * (1 + OVERSHOOT) * 30))} END AS settled_at FROM z""",
        "camera_views": polygons + f"""nx AS (SELECT camera, gx AS ax, gy AS ay, coalesce(lead(gx) OVER o, first_value(gx) OVER o) AS ax2, coalesce(lead(gy) OVER o, first_value(gy) OVER o) AS ay2 FROM pt WINDOW o AS (PARTITION BY camera ORDER BY i)),
ar AS (SELECT camera, sum({cross}) AS tw, sum((ax + ax2) * {cross}) AS sx, sum((ay + ay2) * {cross}) AS sy, avg(ax) AS mx, avg(ay) AS my FROM nx GROUP BY 1),
hz AS (SELECT camera, coalesce(declared, CASE WHEN abs(sin(radians(pitch - 90))) < 1e-6 THEN 0.5 ELSE least(1, greatest(0, ({h / 2} + {f}::DOUBLE * (-cos(radians(pitch - 90)) / sin(radians(pitch - 90)))) / {h})) END) AS horizon FROM cam)
SELECT camera, corners::INT AS corners, round(abs(tw) / 2, 4) AS area, round(CASE WHEN abs(tw) < 2e-9 THEN mx ELSE sx / (3 * tw) END, 4) AS cx, round(CASE WHEN abs(tw) < 2e-9 THEN my ELSE sy / (3 * tw) END, 4) AS cy, round(x1, 4) AS min_x, round(x2, 4) AS max_x, round(y1, 4) AS min_y, round(y2, 4) AS max_y, {angle(WIDTH)}::DOUBLE AS hfov, {angle(HEIGHT)}::DOUBLE AS vfov, round(horizon, 4) AS horizon FROM bb JOIN ar USING (camera) JOIN hz USING (camera)""",
        "cameras_seeing": polygons + seen + end + "SELECT target, coalesce(string_agg(see.camera::VARCHAR, ',' ORDER BY see.camera) FILTER (WHERE enabled), '') AS cameras, count(*) FILTER (WHERE enabled AND NOT moves) AS fixed FROM tgt LEFT JOIN see USING (target) LEFT JOIN cam ON cam.camera = see.camera GROUP BY 1",
        "camera_overlaps": polygons + "pr AS (SELECT a.camera AS first, b.camera AS second, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS shared, least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS small FROM bb a JOIN bb b ON a.camera < b.camera) SELECT first, second, round(shared, 3) AS shared, round(shared / greatest(small, 1e-6), 6) AS ratio FROM pr WHERE shared > 1 AND shared / greatest(small, 1e-6) > 0.02",
        "zone_watch": polygons + zone + f"""zs AS (SELECT zone, bb.camera FROM sm JOIN bb ON tx BETWEEN x1 AND x2 AND ty BETWEEN y1 AND y2 JOIN cam ON cam.camera = bb.camera AND enabled JOIN ed ON ed.camera = bb.camera GROUP BY zone, bb.camera, tx, ty HAVING {inside('tx', 'ty')}),
mv AS (SELECT zone, tx, ty, cam.* FROM sm, cam WHERE moves),
""" + poses("mv", "0") + "s1 AS (SELECT DISTINCT zone, camera FROM zs), t1 AS (SELECT DISTINCT zone, camera FROM po WHERE within), al AS (FROM s1 UNION FROM t1), z0 AS (SELECT DISTINCT zone FROM zc) SELECT zone, coalesce((SELECT string_agg(camera::VARCHAR, ',' ORDER BY camera) FROM s1 WHERE s1.zone = z0.zone), '') AS seen, (SELECT count(*) FROM t1 WHERE t1.zone = z0.zone)::INT AS could_turn, (SELECT count(*) FROM al WHERE al.zone = z0.zone)::INT AS cameras, CASE WHEN zone IN (SELECT zone FROM s1) THEN 'seen' WHEN zone IN (SELECT zone FROM t1) THEN 'moving cameras only' ELSE 'uncovered' END AS state FROM z0",
        "node_totals": cams + end + "SELECT coalesce('n' || node, 'TOTAL') AS node, count(*) AS cameras, count(*) FILTER (WHERE NOT moves) AS fixed, count(*) FILTER (WHERE moves) AS moving, CASE WHEN node IS NOT NULL THEN array_to_string(list(camera ORDER BY camera) FILTER (WHERE enabled), ',') END AS enabled FROM cam GROUP BY ROLLUP (node)",
        "view_exits": polygons + seen + f"""sp AS (SELECT see.*, tx, ty, vx, vy, sqrt(vx * vx + vy * vy) AS speed, count(*) OVER (PARTITION BY target) - 1 AS shared FROM see JOIN tgt USING (target)),
pb AS (SELECT target, camera, k, tx + vx / speed * (k * {900 / 64}::DOUBLE) AS qx, ty + vy / speed * (k * {900 / 64}::DOUBLE) AS qy FROM sp, range(1, 65) t(k) WHERE speed > 1e-6),
ou AS (SELECT target, pb.camera, k, {inside('qx', 'qy')} AS i FROM pb JOIN ed ON ed.camera = pb.camera GROUP BY target, pb.camera, k, qx, qy),
ex AS (SELECT target, camera, min(k) FILTER (WHERE NOT i) * {900 / 64}::DOUBLE AS m FROM ou GROUP BY 1, 2)
SELECT sp.target, sp.camera, round(m, 4) AS exit_m, round(m / speed, 4) AS exit_s, coalesce(m / speed - 2 <= 0, false) AS hand_over, round(greatest(0, 1 - least(shared, 3) / 3.0::DOUBLE), 6) AS occlusion FROM sp LEFT JOIN ex ON ex.target = sp.target AND ex.camera = sp.camera""",
        "handover_candidates": cams + "mv AS (SELECT tgt.*, cam.* FROM tgt, cam WHERE moves AND enabled AND sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) <= 250),\n" + poses("mv", "tz") + f"""sl AS (SELECT *, sqrt(pow(abs((yaw_to - yaw + 900) % 360 - 180) / {SPEED[0]}, 2) + pow(abs(pitch_to - pitch) / {SPEED[1]}, 2)) + {SETTLE} * {1 + OVERSHOOT}::DOUBLE AS acquire_s FROM po WHERE within),
sr AS (SELECT *, least(1, 0.5 / (1 + distance / 150) + 0.5 / (1 + acquire_s / 2)) AS score FROM sl)
SELECT target, camera, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, camera)::INT AS rank, {', '.join(f'round({c}, 5) AS {c}' for c in ('distance', 'yaw_to', 'pitch_to', 'zoom_to', 'acquire_s', 'score'))} FROM sr""",
        "angles": cams + f"""p AS (SELECT *, atan2(tx - x, ty - y) AS b, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) AS away FROM tgt JOIN cam ON camera = target % 100 + 1),
t AS (SELECT *, degrees(((b - radians(yaw) + {math.pi}) % {2 * math.pi} + {2 * math.pi}) % {2 * math.pi} - {math.pi}) AS turn FROM p), s AS (SELECT *, greatest(1, ceil(abs(turn) / 170.0))::INT AS stops FROM t)
SELECT target, round(degrees(b), 5) AS bearing, round(CASE WHEN away < 1e-6 THEN 0 ELSE degrees(atan2(tz - z, away)) END, 5) AS elevation, round(away, 5) AS distance, round(yaw + turn, 5) AS unwrapped, stops, round(yaw + turn / stops, 5) AS first_stop FROM s""",
        "crossings": cams + f"""d AS (SELECT *, {den} AS den FROM tgt),
e AS (SELECT *, CASE WHEN abs(den) >= 1e-9 THEN ((tx - 500.0) * (0.0 - 1000.0) - (ty - 0.0) * (500.0 - 450.0))::DOUBLE / den END AS al, CASE WHEN abs(den) >= 1e-9 THEN -((tx - (tx + 60 * vx)) * (ty - 0.0) - (ty - (ty + 60 * vy)) * (tx - 500.0)) / den END AS ot,
  CASE WHEN vx <> 0 THEN least((300 - tx) / vx, (700 - tx) / vx) WHEN tx BETWEEN 300 AND 700 THEN -1e300 ELSE 1e300 END AS nx, CASE WHEN vx <> 0 THEN greatest((300 - tx) / vx, (700 - tx) / vx) WHEN tx BETWEEN 300 AND 700 THEN 1e300 ELSE -1e300 END AS fx,
  CASE WHEN vy <> 0 THEN least((300 - ty) / vy, (700 - ty) / vy) WHEN ty BETWEEN 300 AND 700 THEN -1e300 ELSE 1e300 END AS ny, CASE WHEN vy <> 0 THEN greatest((300 - ty) / vy, (700 - ty) / vy) WHEN ty BETWEEN 300 AND 700 THEN 1e300 ELSE -1e300 END AS fy FROM d)
SELECT target, round(CASE WHEN al BETWEEN 0 AND 1 AND ot BETWEEN 0 AND 1 THEN tx + al * 60 * vx END, 5) AS x, round(CASE WHEN al BETWEEN 0 AND 1 AND ot BETWEEN 0 AND 1 THEN ty + al * 60 * vy END, 5) AS y, round(CASE WHEN (vx <> 0 OR vy <> 0) AND greatest(nx, ny) <= least(fx, fy) AND least(fx, fy) >= 0 THEN greatest(greatest(nx, ny), 0) END, 5) AS box_s FROM e""",
        "zone_shares": polygons + zone + f"""zb AS (SELECT zone, min(zx) AS zx1, max(zx) AS zx2, min(zy) AS zy1, max(zy) AS zy2, greatest(1, greatest(max(zx) - min(zx), max(zy) - min(zy)) / 64) AS step FROM zc GROUP BY 1),
gr AS (SELECT zone, zx1 + i * step AS tx, zy1 + j * step AS ty FROM zb, range(64) a(i), range(64) b(j) WHERE zx1 + i * step < zx2 AND zy1 + j * step < zy2),
ze AS (SELECT zone, zx AS ax, zy AS ay, coalesce(lag(zx) OVER o, last_value(zx) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS bx, coalesce(lag(zy) OVER o, last_value(zy) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS "by" FROM zc WINDOW o AS (PARTITION BY zone ORDER BY i)),
gi AS (SELECT zone, tx, ty FROM gr JOIN ze USING (zone) GROUP BY 1, 2, 3 HAVING {inside('tx', 'ty')}),
gc AS (SELECT zone, bb.camera, tx, ty FROM gi JOIN bb ON tx BETWEEN x1 AND x2 AND ty BETWEEN y1 AND y2 JOIN ed ON ed.camera = bb.camera GROUP BY 1, 2, 3, 4 HAVING {inside('tx', 'ty')})
SELECT zone, camera, round(count(*) / max(n), 6) AS share FROM gc JOIN (SELECT zone, count(*) AS n FROM gi GROUP BY 1) USING (zone) GROUP BY 1, 2""",
    }
