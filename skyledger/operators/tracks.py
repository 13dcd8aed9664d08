"""Matching, tracking metrics and identity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.functions import cameras
from skyledger.functions.boxes import iou
from skyledger.sources import views


def _pairs(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    keys = ("box_ord", "x1", "y1", "w", "h")
    gt = views.boxes(spark, sf_dir).select("l_orderkey", *[F.col(k).alias(f"g_{k}") for k in keys])
    pred = views.predictions(spark, sf_dir).select("l_orderkey", *[F.col(k).alias(f"p_{k}") for k in keys])
    return gt.join(pred, "l_orderkey").withColumn("iou", iou("g_", "p_")).where(F.col("iou") >= threshold)


def iou_pairs(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Ground truth and predictions of a frame that overlap enough."""
    return _pairs(spark, sf_dir, threshold).select("l_orderkey", F.col("g_box_ord").alias("gt_id"), F.col("p_box_ord").alias("pred_id"), "iou")


def matched_frames(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """frames with arrays gt and pred of (box_ord, x1, y1, w, h) -> adds pairs, an array of (k, g, p): one-to-one pairs by descending overlap -k, ties in (gt, pred) order.

    A frame is one row, matched where it lies: its pairs of enough overlap are sorted and walked once,
    each looked up among those taken, which are no more than the frame has boxes. Overlaps are computed
    for pairs whose sides meet alone, most pairs ending at one comparison.
    """
    both = "greatest(least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1), 0) * greatest(least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1), 0)"
    overlap = f"transform(array({both}), i -> if(a.w * a.h + b.w * b.h - i > 0, i / (a.w * a.h + b.w * b.h - i), 0D))[0]"
    # where a side is null, the overlap itself decides
    meet = "coalesce(b.x1 < a.x1 + a.w, true) and coalesce(a.x1 < b.x1 + b.w, true) and coalesce(b.y1 < a.y1 + a.h, true) and coalesce(a.y1 < b.y1 + b.h, true)"
    others = f"filter(pred, b -> {meet})" if threshold > 0 else "pred"
    near = f"filter(flatten(transform(gt, a -> transform({others}, b -> named_struct('k', -{overlap}, 'g', a.box_ord, 'p', b.box_ord)))), x -> x.k <= -{float(threshold)}D)"
    walk = "aggregate(rows, cast(array() as array<struct<k:double,g:int,p:int>>), (s, r) -> if(exists(s, x -> x.g = r.g or x.p = r.p), s, concat(s, array(r))))"
    return frames.withColumn("rows", F.array_sort(F.expr(near))).withColumn("pairs", F.expr(walk)).drop("rows")


def greedy_match(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs of each frame, taken by descending overlap, ties in (gt, pred) order. Pairs come from the join, whose overlaps are compiled, and a frame's pairs are one ordered array, walked once."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), F.col("g_box_ord").alias("g"), F.col("p_box_ord").alias("p"))))
    walk = "aggregate(rows, cast(array() as array<struct<k:double,g:int,p:int>>), (s, r) -> if(exists(s, x -> x.g = r.g or x.p = r.p), s, concat(s, array(r))))"
    frames = _pairs(spark, sf_dir, threshold).groupBy("l_orderkey").agg(rows.alias("rows"))
    return frames.select("l_orderkey", F.explode(F.expr(walk)).alias("m")).select("l_orderkey", F.col("m.g").alias("gt_id"), F.col("m.p").alias("pred_id"), (-F.col("m.k")).alias("iou"))


def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sequence: matches, misses, false alarms and the ratios made from those counts. One scan, one exchange of boxes; counts come from the matched row itself."""
    f = views.key_columns(matched_frames(views.frame_boxes(spark, sf_dir)))
    s = f.groupBy("sequence_id").agg(F.sum(F.size("gt")).alias("gt"), F.sum(F.size("pred")).alias("pred"), F.sum(F.size("pairs")).alias("tp"))
    return s.select("sequence_id", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"), (F.col("tp") / F.col("pred")).alias("precision"), (F.col("tp") / F.col("gt")).alias("recall"))


def cross_camera(spark: SparkSession, sf_dir: str, seconds: int = 3, cameras: int = 2) -> DataFrame:
    """Observations with the distinct cameras that saw the identity in the last seconds, and the gate's outcome."""
    recent = Window.partitionBy("global_id").orderBy("frame_index").rangeBetween(-25 * seconds, 0)
    o = views.observations(spark, sf_dir).withColumn("cameras", F.size(F.collect_set("camera_id").over(recent)))
    return o.select("event_id", "global_id", "cameras", F.when(F.col("cameras") >= cameras, "pass").otherwise("fail").alias("outcome"))


def velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement from an identity's last observation by the same camera, and the frames between."""
    last = Window.partitionBy("global_id", "camera_id").orderBy("frame_index")
    o = views.observations(spark, sf_dir)
    return o.select("event_id", *[(F.col(c) - F.lag(c).over(last)).alias(f"d{c}") for c in ("x", "y")], (F.col("frame_index") - F.lag("frame_index").over(last)).alias("gap"))


def track_fragments(spark: SparkSession, sf_dir: str, gap: int = 5) -> DataFrame:
    """Runs of an identity in one camera without a pause of more than gap frames."""
    w = Window.partitionBy("global_id", "camera_id").orderBy("frame_index")
    o = views.observations(spark, sf_dir).withColumn("new", F.when(F.col("frame_index") - F.lag("frame_index").over(w) <= gap, 0).otherwise(1))
    o = o.withColumn("fragment", F.sum("new").over(w))
    return o.groupBy("global_id", "camera_id", "fragment").agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count(F.lit(1)).alias("hits"))


def persistence_gate(spark: SparkSession, sf_dir: str, hits: int = 12, initiate: float = 0.6) -> DataFrame:
    """Confidence and persistence verdicts of each identity and camera; without confidence the first can't decide."""
    o = views.observations(spark, sf_dir).groupBy("global_id", "camera_id").agg(F.count(F.lit(1)).alias("hits"), F.max("confidence").alias("best"))
    return o.select("global_id", "camera_id", F.when(F.col("hits") >= hits, "pass").otherwise("fail").alias("persistence"), F.when(F.col("best").isNull(), "skipped").when(F.col("best") >= initiate, "pass").otherwise("fail").alias("confidence"))


def gallery_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each identity's mean vector against its own vectors whose id divides by 20: the cosine, to six places (the best over all vectors is gallery_best). Both sides are aggregated or selected first; there are as many means as labels."""
    e = views.read(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy("label").agg(F.expr("transform(array_sort(collect_list(struct(i, m))), x -> x.m)").alias("mean"))
    q = e.where("vec_id % 20 = 0").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("q"), F.col("label").alias("own"))
    dot = lambda a, b: F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    s = q.join(means, q.own == means.label).withColumn("cosine", dot("q", "mean") / F.sqrt(dot("q", "q") * dot("mean", "mean")))
    return s.select("vec_id", F.col("own").alias("label"), F.round("cosine", 6).alias("cosine"))


def ground_positions(spark: SparkSession, sf_dir: str, plane: float = 10.0, pitch: float = -20.0) -> DataFrame:
    """Where each observation's pixel meets the plane, and its bearing from the camera; null above the horizon. Cameras stand 100 m apart at 30 m, each turned 36 degrees from the last."""
    c, f, mid = F.col("camera_id"), F.lit(900.0), F.lit(500.0)
    look = cameras.ray(F.col("x"), F.col("y"), f, mid, mid, c * 36.0, F.lit(pitch))
    gx, gy = cameras.on_plane(look, (c * 100.0, F.lit(0.0), F.lit(30.0)), F.lit(plane))
    o = views.observations(spark, sf_dir).select("event_id", "camera_id", F.round(gx, 4).alias("gx"), F.round(gy, 4).alias("gy"))
    return o.withColumn("bearing", F.round(cameras.bearing(F.col("gx") - c * 100.0, F.col("gy")), 4))
