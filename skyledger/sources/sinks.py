"""Writers of frame indexes, reports, label and tracking text, and split lists."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir. Only a local master may do without it; there a temporary folder serves."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "skyledger-checkpoints")
    return f"{base}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of a run's own that nothing reads any more, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_index(records: DataFrame, root: str) -> None:
    """Replaces the partitions (dataset, variant) that records hold and no others, in order of sequence, modality and frame within each file."""
    d = records.repartition("dataset", "variant", "sequence_id").sortWithinPartitions("dataset", "variant", "sequence_id", "modality", "frame_index")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "variant").parquet(root)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def label_text(boxes: DataFrame) -> DataFrame:
    """class_id, cx, cy, bw, bh -> value; boxes without extent are left out."""
    return boxes.where((F.col("bw") > 0) & (F.col("bh") > 0)).select(F.format_string("%d %.6f %.6f %.6f %.6f", F.col("class_id").cast("int"), "cx", "cy", "bw", "bh").alias("value"))


def write_labels(boxes: DataFrame, path: str) -> None:
    """Label text in a folder for each value of `stem`."""
    text = boxes.where((F.col("bw") > 0) & (F.col("bh") > 0)).select("stem", F.format_string("%d %.6f %.6f %.6f %.6f", F.col("class_id").cast("int"), "cx", "cy", "bw", "bh").alias("value"))
    text.repartition("stem").write.mode("overwrite").partitionBy("stem").text(path)


def mot_text(rows: DataFrame) -> DataFrame:
    """frame (from 0), id, x1, y1, w, h, conf, visibility -> value, as tracking text with frames from 1 and class 1."""
    line = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,%.2f,1,%.2f", (F.col("frame") + 1).cast("int"), F.col("id").cast("int"), *[F.col(c).cast("double") for c in ("x1", "y1", "w", "h", "conf", "visibility")])
    return rows.select(line.alias("value"))


def write_mot(rows: DataFrame, path: str) -> None:
    mot_text(rows.repartitionByRange("frame").sortWithinPartitions("frame", "id")).write.mode("overwrite").text(path)


def write_splits(records: DataFrame, path: str) -> None:
    """The distinct images of each split, sorted; those without a split go to train."""
    s = records.select(F.when(F.coalesce(F.trim("split"), F.lit("")) == "", "train").otherwise(F.col("split")).alias("split"), F.col("image").alias("value")).distinct()
    s.repartitionByRange("split", "value").sortWithinPartitions("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def predictions_text(tracks: DataFrame) -> DataFrame:
    """Tracks (frame from 0, track_id, x1, y1, x2, y2, confidence) -> value, as tracking text with frames from 1, class 1 and full visibility."""
    return mot_text(tracks.select("frame", F.col("track_id").alias("id"), "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.col("confidence").alias("conf"), F.lit(1.0).alias("visibility")))


def persist_splits(index: DataFrame, assigned: DataFrame, root: str, report_path: str) -> None:
    """Writes index with the split that assigned (sequence_id, modality, split) gives each group (as it was where it gives none), replacing only the partitions it holds, and the assignment as JSON. The new index is settled first, as it may be read from the same root."""
    given = assigned.select("sequence_id", "modality", F.col("split").alias("_given"))
    new = index.join(given, ["sequence_id", "modality"], "left").withColumn("split", F.coalesce("_given", "split")).select(*index.columns)
    path = scratch(index.sparkSession)
    new.write.parquet(path)
    write_index(index.sparkSession.read.schema(new.schema).parquet(path), root)
    assigned.write.mode("overwrite").json(report_path)


def manifest(names: tuple[str, ...], root: str, notes: tuple[str, ...] = ()) -> str:
    """The text manifest of a built dataset: its root, split lists and class names."""
    lines = [*(f"# {n}" for n in notes), f"path: {root}", "train: splits/split=train", "val: splits/split=val", f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *(f"  {i}: {n}" for i, n in enumerate(names))]) + "\n"


def append_run(run: DataFrame, root: str) -> None:
    """A run's record, appended to the table of runs; the time it is written stands in written_at."""
    run.withColumn("written_at", F.current_timestamp()).write.mode("append").json(root)


def list_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records of runs at any depth, latest first."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(root).orderBy(F.desc("trained_at"), "run_id")


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report of one JSON document over any number of lines."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def unique_stems(records: DataFrame) -> DataFrame:
    """Names under which images of several sources can lie in one folder: source, sequence, modality and the frame in six digits."""
    frame = F.col("frame_index").cast("string")
    digits = F.when(F.length(frame) < 6, F.lpad(frame, 6, "0")).otherwise(frame)
    return records.withColumn("stem", F.concat_ws("__", "dataset", "sequence_id", "modality", digits))


def tile_labels(tiles: DataFrame) -> DataFrame:
    """Boxes cut to tiles (stem, tile, class_id, x1, y1, x2, y2 in tile pixels, width, height) as label rows of each tile's own stem; a class stays with its box."""
    w, h = F.col("width"), F.col("height")
    return tiles.select(F.format_string("%s_t%03d", "stem", F.col("tile").cast("int")).alias("stem"), "class_id", ((F.col("x1") + F.col("x2")) / 2 / w).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 / h).alias("cy"), ((F.col("x2") - F.col("x1")) / w).alias("bw"), ((F.col("y2") - F.col("y1")) / h).alias("bh"))
