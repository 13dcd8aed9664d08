"""Profiles, splits, duplicates and constraint checks over annotated frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.functions.boxes import SIZE_BINS, size_bin
from skyledger.functions.labels import normalize_label, slug
from skyledger.sources import views


def frame_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: frames, boxes, frames with a bird, groups and mean boxes a frame. Boxes are summed per frame before the join."""
    per_frame = views.boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("class_id").alias("bird"))
    f = views.frame_keys(spark, sf_dir).join(per_frame, "l_orderkey")
    return f.groupBy("dataset").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("boxes"), F.sum("bird").cast("long").alias("bird_frames"), F.countDistinct("sequence_id", "modality").alias("groups"), (F.sum("n") / F.count(F.lit(1))).alias("boxes_per_frame"))


def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per class and size bin, zero-filled."""
    found = views.boxes(spark, sf_dir).groupBy("class_id", size_bin(F.col("w"), F.col("h")).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    bins = spark.createDataFrame([(c, b) for c in (0, 1) for b in SIZE_BINS], "class_id int, bin int")
    return bins.join(found, ["class_id", "bin"], "left").select("class_id", "bin", F.coalesce("c", F.lit(0)).alias("boxes"))


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per class name; a class beyond the names would be __invalid_k."""
    names = F.when(F.col("class_id") == 0, "drone").when(F.col("class_id") == 1, "bird").otherwise(F.concat(F.lit("__invalid_"), F.col("class_id").cast("string")))
    return views.boxes(spark, sf_dir).groupBy(names.alias("class_name")).agg(F.count(F.lit(1)).alias("boxes"))


def empty_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without a box, by order status."""
    orders, lines = views.read(spark, sf_dir, "orders"), views.read(spark, sf_dir, "lineitem").select("l_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("frames"))


def stratified_split(spark: SparkSession, sf_dir: str, fraction: float = 0.15, short: int = 8, least: int = 2) -> DataFrame:
    """Leakage-safe split: whole groups go to val or train, within each source and modality, in order of a digest of the group key.

    Groups of fewer than `short` frames ride with train unless all of a stratum are short; the number
    for val is rounded half to even and at least min(least, n // 2) where there are three or more.
    """
    groups = views.frame_keys(spark, sf_dir).groupBy("dataset", "modality", "sequence_id").agg(F.count(F.lit(1)).alias("frames"))
    stratum = Window.partitionBy("dataset", "modality")
    groups = groups.withColumn("all_short", F.max("frames").over(stratum) < short)
    groups = groups.withColumn("long", (F.col("frames") >= short) | F.col("all_short"))
    g = groups.withColumn("n", F.count_if("long").over(stratum))
    n_val = F.when(F.col("n") >= 3, F.greatest(F.bround(F.col("n") * fraction).cast("int"), F.least(F.lit(least), F.floor(F.col("n") / 2)))).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("dataset", "modality", "long").orderBy(F.md5(F.concat_ws("/", "sequence_id", "modality").cast("binary"))))
    return g.withColumn("rank", rank).select("dataset", "modality", "sequence_id", "frames", F.when(F.col("long") & (F.col("rank") <= n_val), "val").otherwise("train").alias("split"))


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(spark, sf_dir).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("groups"), F.sum("frames").alias("frames"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal content: first member, size and whether it spans sources."""
    d = views.read(spark, sf_dir, "documents")
    return d.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"), (F.min("source") != F.max("source")).alias("cross_source")).where("members > 1")


def label_harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised labels and their slugs, with counts."""
    d = views.read(spark, sf_dir, "part")
    return d.groupBy(normalize_label(F.col("p_type")).alias("label"), slug(F.col("p_brand")).alias("slug")).agg(F.count(F.lit(1)).alias("rows"))


def tiling_plan(spark: SparkSession, sf_dir: str, threshold: int = 40) -> DataFrame:
    """Which sources are tiled by default: those whose median target, as measured, is at most the threshold; with what they claim."""
    s = views.sources(spark, sf_dir)
    claims = F.concat_ws(",", *[F.when(F.col(c), c) for c in ("bird_negatives", "track_ids", "visibility")])
    return s.select("source", "median_px", F.coalesce(F.col("median_px") <= threshold, F.lit(False)).alias("tiled"), claims.alias("claims"))


def trackable(height: Column, least: float = 15.0) -> Column:
    """Whether a target is high enough, in pixels, to be told from frame to frame."""
    return height >= least


def trackable_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by class, and those high enough to be tracked."""
    return views.boxes(spark, sf_dir).groupBy("class_id").agg(F.count(F.lit(1)).alias("boxes"), F.count_if(trackable(F.col("h"))).alias("trackable"))
