"""Readers of annotation files: JSON lines, tracking text, label text, per-frame JSON, training curves, file listings."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = "sequence_id string, frame_index int, modality string, dataset string, variant string, image string, label string, width int, height int, class_ids array<int>, source_labels array<string>, box_count int, track_id int, visibility array<double>, target_present boolean, dropped_boxes int, tiles array<string>, split string, notes string"

#: The names that sources give a box's fields.
LEFT, TOP, RIGHT, BOTTOM = ("xmin", "x1", "left", "x"), ("ymin", "y1", "top", "y"), ("xmax", "x2", "right"), ("ymax", "y2", "bottom")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are left out."""
    wide = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")


def read_index(spark: SparkSession, root: str, dataset: str | None = None, variant: str | None = None) -> DataFrame:
    """A frame index partitioned by dataset and variant, pruned to what is asked for; empty where nothing has been written."""
    try:
        found = spark.read.schema(INDEX_SCHEMA).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX_SCHEMA)
    for col, value in (("dataset", dataset), ("variant", variant)):
        if value is not None:
            found = found.where(F.col(col) == value)
    return found


def _fields() -> Column:
    return F.split(F.trim(F.regexp_replace("value", r"[,\s]+", " ")), " ")


def below(path: Column, root: str) -> Column:
    """A file's path below the root that was read; its name alone where the root is the file or a pattern."""
    base = quote(root.removeprefix("file://").rstrip("/"), safe="/:") + "/"
    return F.when(path.contains(base), F.substring_index(path, base, -1)).otherwise(F.element_at(F.split(path, "/"), -1))


def read_mot(spark: SparkSession, path: str, least: int = 6) -> DataFrame:
    """Tracking text of all files below path, commas or blanks: file (its path below, so that files of one name stay apart), frame, id, x1, y1, w, h, conf, class, visibility. Rows of fewer fields than `least`, or with a first six that are no numbers, are left out; visibility is 1 where it is missing."""
    d = spark.read.option("recursiveFileLookup", "true").text(path).select(below(F.col("_metadata.file_path"), path).alias("file"), _fields().alias("f")).where(F.size("f") >= least)
    at = lambda i, kind: F.get("f", F.lit(i)).try_cast(kind)
    d = d.select("file", at(0, "double").cast("int").alias("frame"), at(1, "double").cast("int").alias("id"), *[at(i, "double").alias(n) for i, n in ((2, "x1"), (3, "y1"), (4, "w"), (5, "h"))], F.coalesce(at(6, "double"), F.lit(1.0)).alias("conf"), F.coalesce(at(7, "double").cast("int"), F.lit(1)).alias("class"), F.coalesce(at(8, "double"), F.lit(1.0)).alias("visibility"))
    return d.dropna(subset=["frame", "id", "x1", "y1", "w", "h"])


def has_track_ids(mot: DataFrame) -> DataFrame:
    """Per file, whether its ids tell objects apart."""
    return mot.groupBy("file").agg(F.bool_or(F.col("id") > 1).alias("has_ids"))


def label_rows(spark: SparkSession, path: str, width: int, height: int, names: dict[str, int] | None = None, least_px: float = 2.0) -> DataFrame:
    """Label text, a row per non-empty line: file, class_id, cx, cy, bw, bh clamped to the image, reason.

    reason: kept, degenerate (short, no number, no extent), unknown (class), out_of_frame (centre outside),
    tiny (a side under least_px after clamping). Comments begin with #.
    """
    d = spark.read.option("recursiveFileLookup", "true").text(path).select(below(F.col("_metadata.file_path"), path).alias("file"), "value").where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    d = d.select("file", _fields().alias("f"))
    for i, n in ((1, "cx"), (2, "cy"), (3, "bw"), (4, "bh")):
        d = d.withColumn(n, F.get("f", F.lit(i)).try_cast("double"))
    kind = F.get("f", F.lit(0)).try_cast("int")
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        kind = F.coalesce(kind, table[F.regexp_replace(F.lower(F.get("f", F.lit(0))), "[- ]", "_")])
    d = d.withColumn("class_id", kind)
    lo = lambda c, s: F.greatest(F.col(c) - F.col(s) / 2, F.lit(0.0))
    hi = lambda c, s: F.least(F.col(c) + F.col(s) / 2, F.lit(1.0))
    w, h = hi("cx", "bw") - lo("cx", "bw"), hi("cy", "bh") - lo("cy", "bh")
    reason = (
        F.when((F.size("f") < 5) | F.col("cx").isNull() | F.col("cy").isNull() | F.col("bw").isNull() | F.col("bh").isNull() | (F.col("bw") <= 0) | (F.col("bh") <= 0), "degenerate")
        .when(F.col("class_id").isNull(), "unknown")
        .when(~F.col("cx").between(0, 1) | ~F.col("cy").between(0, 1), "out_of_frame")
        .when((w * width < least_px) | (h * height < least_px), "tiny")
        .otherwise("kept")
    )
    return d.select("file", "class_id", ((lo("cx", "bw") + hi("cx", "bw")) / 2).alias("cx"), ((lo("cy", "bh") + hi("cy", "bh")) / 2).alias("cy"), w.alias("bw"), h.alias("bh"), reason.alias("reason"))


def label_tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def read_frame_objects(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame JSON in any of its three layouts ({"frames": {n: [..]}}, {n: [..]}, [{"frame_id": n, "objects": [..]}]): file, frame (from 0), box x1 y1 x2 y2, id, visible.

    Frames without an object, and objects that are marked absent, are rows with a null box. A document of
    another shape is an error.
    """
    d = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(below(F.col("_metadata.file_path"), path).alias("file"), F.trim("value").alias("doc"))
    obj = "array<map<string,string>>"
    nested, flat = F.from_json(F.get_json_object("doc", "$.frames"), f"map<string,{obj}>"), F.from_json("doc", f"map<string,{obj}>")
    rows = F.map_from_entries(F.transform(F.from_json("doc", f"array<struct<frame_id:string,objects:{obj}>>"), lambda r: F.struct(r["frame_id"].alias("key"), r["objects"].alias("value"))))
    shape = F.when(F.col("doc").startswith("["), rows).when(F.get_json_object("doc", "$.frames").isNotNull(), nested).otherwise(flat)
    d = d.select("file", F.explode_outer(F.coalesce(shape, F.raise_error(F.concat(F.lit("no known layout: "), F.col("file"))))).alias("frame", "objects"))
    d = d.select("file", (F.col("frame").cast("int") - 1).alias("frame"), F.explode_outer("objects").alias("o"))
    named = lambda keys: F.coalesce(*[F.col("o")[k].try_cast("double") for k in keys])
    there = F.col("o").isNotNull() & (F.coalesce(named(("v", "visibility")), F.lit(1.0)) > 0)
    x1, y1 = named(LEFT), named(TOP)
    x2, y2 = F.coalesce(named(RIGHT), x1 + named(("w", "width"))), F.coalesce(named(BOTTOM), y1 + named(("h", "height")))
    return d.select("file", "frame", *[F.when(there, c).alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))], named(("id", "track_id")).cast("int").alias("id"), there.alias("visible"))


def read_curve(spark: SparkSession, path: str, metric: str = "metrics/mAP50-95(B)") -> tuple[DataFrame, DataFrame]:
    """A training curve, and its summary: the first best epoch of the metric, and each column's best (least for losses, else greatest)."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    d = raw.toDF(*[c.strip() for c in raw.columns])
    q = lambda c: F.col(f"`{c}`")
    best = F.max_by(q("epoch"), F.struct(q(metric), -q("epoch"))).alias("best_epoch")
    return d, d.agg(F.count(F.lit(1)).alias("epochs"), best, *[(F.min(q(c)) if "loss" in c else F.max(q(c))).alias(c) for c in d.columns if c != "epoch"])


def list_files(spark: SparkSession, root: str, glob: str = "*.{jpg,jpeg,png,bmp}") -> DataFrame:
    """path, length and modification time of files at any depth; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
