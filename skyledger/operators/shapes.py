"""Box and plane operators: scalars, suppression, tiles, homographies, fences, cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import boxes as fb
from skyledger.functions import geometry
from skyledger.sources import views

WIDTH, HEIGHT = 1920, 1080
#: A sheared and scaled plane, as camera motion gives.
MOTION = ((1.0, 0.125, 5.0), (0.0, 0.875, -3.0), (0.0, 0.0, 2.0))
FENCES = (("inner", "suppress", ((100, 100), (500, 120), (480, 520), (90, 480))), ("north", "alert", ((0, 600), (900, 600), (700, 990), (50, 900))), ("east", "escalate", ((600, 0), (1000, 0), (1000, 1000), (820, 500))))
CAMERAS = tuple((i, 83 * i % 1000, 359 * i % 1000, i % 4) for i in range(10))


def box_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre, area, aspect, clip to the image, relative scale with its band, and the overlap its size asks for. One pass, no shuffle beyond the box numbers'."""
    b = views.boxes(spark, sf_dir)
    w, h = F.col("w"), F.col("h")
    scale = fb.scale_of(w, h, WIDTH, HEIGHT)
    return b.select(
        "l_orderkey",
        "box_ord",
        (F.col("x1") + w / 2).alias("cx"),
        (F.col("y1") + h / 2).alias("cy"),
        (w * h).alias("area"),
        (w / h).alias("aspect"),
        F.least(F.col("x1") + w, F.lit(WIDTH)).alias("x2"),
        F.least(F.col("y1") + h, F.lit(HEIGHT)).alias("y2"),
        F.round(scale, 9).alias("scale"),
        fb.scale_band(scale).alias("band"),
        fb.overlap_needed(F.sqrt((w * h).cast("double"))).alias("overlap"),
    )


def yolo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows: class, centre and size relative to the image; boxes of a side below two pixels go. The sink writes six places."""
    b = views.boxes(spark, sf_dir).withColumn("x2", F.least(F.col("x1") + F.col("w"), F.lit(WIDTH))).withColumn("y2", F.least(F.col("y1") + F.col("h"), F.lit(HEIGHT)))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    kept = b.where((w >= 2) & (h >= 2))
    return kept.select("l_orderkey", "box_ord", "class_id", *[c.alias(n) for c, n in (((F.col("x1") + F.col("x2")) / (2 * WIDTH), "cx"), ((F.col("y1") + F.col("y2")) / (2 * HEIGHT), "cy"), (w / WIDTH, "bw"), (h / HEIGHT, "bh"))])


def giou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised overlap of ground truth and prediction of one number in a frame."""
    keys = ("x1", "y1", "w", "h")
    g = views.boxes(spark, sf_dir).select("l_orderkey", "box_ord", *[F.col(k).alias(f"g_{k}") for k in keys])
    p = views.predictions(spark, sf_dir).select("l_orderkey", "box_ord", *[F.col(k).alias(f"p_{k}") for k in keys])
    return g.join(p, ["l_orderkey", "box_ord"]).select("l_orderkey", "box_ord", fb.giou("g_", "p_").alias("giou"))


def nms_survivors(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Boxes left of each frame and class by descending confidence, each suppressing those it overlaps by more than the threshold. A frame's boxes are one ordered array, walked once."""
    row = F.struct((-F.col("confidence")).alias("k"), F.col("box_ord").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "w", "h")])
    both = "greatest(least(x.x1 + x.w, r.x1 + r.w) - greatest(x.x1, r.x1), 0D) * greatest(least(x.y1 + x.h, r.y1 + r.h) - greatest(x.y1, r.y1), 0D)"
    over = f"transform(array({both}), i -> i > {threshold}D * (x.w * x.h + r.w * r.h - i))[0]"
    kind = "array<struct<k:double,id:int,x1:double,y1:double,w:double,h:double>>"
    frames = views.boxes(spark, sf_dir).groupBy("l_orderkey", "class_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kept = F.expr(f"aggregate(rows, cast(array() as {kind}), (s, r) -> if(exists(s, x -> {over}), s, concat(s, array(r))))")
    return frames.select("l_orderkey", "class_id", F.explode(kept).alias("m")).select("l_orderkey", "class_id", F.col("m.id").alias("box_ord"), (-F.col("m.k")).alias("confidence"))


def tile_starts(extent: Column, size: int, stride: int) -> Column:
    """Offsets of windows along an axis: every stride, the last one flush with the end; those nearer to it than an eighth of the size go."""
    tail = extent - size
    body = F.filter(F.sequence(F.lit(0), tail, F.lit(stride)), lambda s: s + max(1, size // 8) <= tail)
    return F.when(extent <= size, F.array(F.lit(0))).otherwise(F.concat(body, F.array(tail)))


def with_tiles(images: DataFrame, size: int = 640, overlap: float = 0.25, sliver: int = 8) -> DataFrame:
    """images (width, height: int) -> one row per window: tile (index, by rows), tx, ty, tw, th. Windows under `sliver` pixels are skipped."""
    stride = max(round(size * (1 - overlap)), 1)
    d = images.withColumn("_ys", tile_starts(F.col("height"), size, stride)).withColumn("_xs", tile_starts(F.col("width"), size, stride))
    d = d.withColumn("_t", F.expr("flatten(transform(_ys, y -> transform(_xs, x -> named_struct('tx', x, 'ty', y))))"))
    sized = f"filter(transform(_t, t -> named_struct('tx', t.tx, 'ty', t.ty, 'tw', least({size}, width - t.tx), 'th', least({size}, height - t.ty))), t -> t.tw >= {sliver} and t.th >= {sliver})"
    return d.select(*images.columns, F.posexplode(F.expr(sized)).alias("tile", "_w")).select(*images.columns, "tile", "_w.*")


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of images of several sizes, one for each part size."""
    p = views.read(spark, sf_dir, "part").select("p_size").distinct()
    return with_tiles(p.select("p_size", (F.col("p_size") * 40 + 5).alias("width"), (F.col("p_size") * 24 + 3).alias("height")))


def tile_boxes(spark: SparkSession, sf_dir: str, size: int = 640, visible: float = 0.35) -> DataFrame:
    """Boxes of each window that keep at least a share of their area in it, moved to the window's corner. Only the windows a box can touch are made for it: the grid is a constant of a dozen rows."""
    grid = with_tiles(spark.createDataFrame([(WIDTH, HEIGHT)], "width int, height int"), size).drop("width", "height")
    b = views.boxes(spark, sf_dir)
    w = F.least(F.col("x1") + F.col("w"), F.col("tx") + F.col("tw")) - F.greatest("x1", "tx")
    h = F.least(F.col("y1") + F.col("h"), F.col("ty") + F.col("th")) - F.greatest("y1", "ty")
    meets = (F.col("x1") < F.col("tx") + F.col("tw")) & (F.col("tx") < F.col("x1") + F.col("w")) & (F.col("y1") < F.col("ty") + F.col("th")) & (F.col("ty") < F.col("y1") + F.col("h"))
    d = b.join(F.broadcast(grid), meets).withColumn("vw", w).withColumn("vh", h)
    d = d.where(F.col("vw") * F.col("vh") >= F.lit(visible) * F.col("w") * F.col("h"))
    return d.select("l_orderkey", "box_ord", "tile", F.greatest(F.col("x1") - F.col("tx"), F.lit(0)).alias("bx"), F.greatest(F.col("y1") - F.col("ty"), F.lit(0)).alias("by"), F.col("vw").alias("bw"), F.col("vh").alias("bh"))


def motion_compensated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes' corners under the camera's motion between frames: the rectangle around the projected corners."""
    b = views.boxes(spark, sf_dir)
    x1, y1, x2, y2 = F.col("x1"), F.col("y1"), F.col("x1") + F.col("w"), F.col("y1") + F.col("h")
    at = [geometry.project(x, y, MOTION) for x in (x1, x2) for y in (y1, y2)]
    xs, ys = [p[0] for p in at], [p[1] for p in at]
    return b.select("l_orderkey", "box_ord", F.least(*xs).alias("left"), F.least(*ys).alias("top"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("bottom"))


def geofence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fence, in their given order, that holds an observation, and its action."""
    o = views.observations(spark, sf_dir)
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, a, polygon in reversed(FENCES):
        hit = geometry.inside(F.col("x").cast("double"), F.col("y").cast("double"), polygon)
        name, action = F.when(hit, n).otherwise(name), F.when(hit, a).otherwise(action)
    return o.select("event_id", name.alias("fence"), action.alias("action")).where("fence is not null")


def fence_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fence's area, and the observations that it is the first to hold."""
    rows = [(n, a, [{"x": float(x), "y": float(y)} for x, y in p]) for n, a, p in FENCES]
    d = spark.createDataFrame(rows, "fence string, action string, corners array<struct<x:double,y:double>>")
    held = geofence_hits(spark, sf_dir).groupBy("fence").agg(F.count(F.lit(1)).alias("held"))
    return d.join(F.broadcast(held), "fence", "left").select("fence", "action", geometry.shoelace("corners").alias("area"), F.coalesce("held", F.lit(0)).alias("held"))


def handoff_candidates(spark: SparkSession, sf_dir: str, reach: float = 400.0, best: int = 3) -> DataFrame:
    """For each observation the nearest other cameras in reach, at most three; the cameras are a constant of ten rows inside the expression, so nothing is joined."""
    rows = ", ".join(f"named_struct('d', sqrt(cast((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy}) as double)), 'camera', {c})" for c, cx, cy, _ in CAMERAS)
    near = F.expr(f"slice(array_sort(filter(array({rows}), c -> c.camera <> camera_id and c.d <= {reach}D)), 1, {best})")
    o = views.observations(spark, sf_dir).select("event_id", F.posexplode(near).alias("rank", "c"))
    return o.select("event_id", F.col("rank").cast("int").alias("rank"), F.col("c.camera").alias("camera"), F.round("c.d", 6).alias("metres"))
