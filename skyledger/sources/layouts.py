"""Layouts of source datasets: which is there, how its files make up sequences, and the conversion of what readers give into a frame index with a report. Listings are DataFrames (path, length), as readers.list_files gives them; nothing here opens a file."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.functions.labels import slug
from skyledger.functions.names import IMAGES, VIDEOS, sequence_of, stem_of
from skyledger.sources.readers import INDEX_SCHEMA

#: Tokens of the infrared modality, classes.
INFRARED = r"(?i)(^|[-_. ])(ir|infrared|thermal)($|[-_. ])"
CLASSES = ("drone", "bird")
#: Layouts, told apart by what must be there, the most telling first.
LAYOUTS = (("tracking folders", r"(^|/)gt/gt\.txt$"), ("video annotations", r"\.json$"), ("frame rows", r"(^|/)annotations?/[^/]+\.txt$"), ("image and label pairs", r"(^|/)labels/.+\.txt$"), ("flat labels", r"\.txt$"))


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(suffixes) + ")$")


def detect_layout(listing: DataFrame) -> DataFrame:
    """One row: the first layout whose files are there, and how many of them; null for none."""
    counts = [F.count_if(F.col("path").rlike(p)).alias(str(i)) for i, (_, p) in enumerate(LAYOUTS)]
    found = listing.agg(*counts)
    first = F.coalesce(*[F.when(F.col(str(i)) > 0, F.struct(F.lit(n).alias("layout"), F.col(str(i)).alias("files"))) for i, (n, _) in enumerate(LAYOUTS)])
    return found.select(first.alias("f")).select("f.*")


def sequences(listing: DataFrame, rule: str = "frames") -> DataFrame:
    """Images with their sequence by one of names.RULES, how it was told, and their frame in it by order of path."""
    i = listing.where(has_suffix(F.col("path"), IMAGES)).withColumn("s", sequence_of(F.col("path"), rule)).select("path", F.col("s.sequence").alias("sequence_id"), F.col("s.how").alias("how"))
    return i.withColumn("frame_index", F.row_number().over(Window.partitionBy("sequence_id").orderBy("path")) - 1)


def image_root(listing: DataFrame) -> DataFrame:
    """The directory with the most images, the first by name of equals."""
    d = listing.where(has_suffix(F.col("path"), IMAGES)).groupBy(F.regexp_replace("path", r"/?[^/]+$", "").alias("folder")).agg(F.count(F.lit(1)).alias("images"))
    return d.orderBy(F.desc("images"), "folder").limit(1)


def label_files(listing: DataFrame) -> DataFrame:
    """Images with their label file: under labels/ in place of images/, in labels/ at the root, at the root, or beside the image, the first that is there; null for none."""
    i = listing.where(has_suffix(F.col("path"), IMAGES)).select("path")
    text = F.concat(stem_of(F.col("path")), F.lit(".txt"))
    base = F.regexp_replace("path", r"\.[^.]+$", ".txt")
    apart = F.col("path").rlike("(^|/)images/")
    places = F.array(F.when(apart, F.regexp_replace(base, "(^|/)images/", "$1labels/")), F.when(apart, F.concat(F.lit("labels/"), F.regexp_replace(base, "^(.*/)?images/", ""))), F.concat(F.lit("labels/"), text), text, base)
    there = listing.where(F.col("path").endswith(".txt")).select(F.col("path").alias("label"))
    found = i.select("path", F.posexplode(places).alias("rank", "label")).join(there, "label").groupBy("path").agg(F.min_by("label", "rank").alias("label"))
    return i.join(found, "path", "left")


def video_pairs(listing: DataFrame) -> DataFrame:
    """Videos with the annotation of their stem in the same directory: each modality is a sequence of its own, named without its token. A directory's primary video is the one named like it, else the largest."""
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    v = listing.where(has_suffix(F.col("path"), VIDEOS)).select(F.col("path").alias("video"), "length", folder.alias("folder"), stem_of(F.col("path")).alias("stem"))
    a = listing.where(F.col("path").endswith(".json")).select(F.col("path").alias("annotation"), folder.alias("folder"), stem_of(F.col("path")).alias("stem"))
    primary = v.groupBy("folder").agg(F.max_by("video", F.struct((F.col("stem") == F.element_at(_parts(F.col("folder")), -1)).cast("int"), "length", "video")).alias("primary"))
    modality = F.when(F.col("stem").rlike(INFRARED), "ir").otherwise("rgb")
    name = F.concat_ws("_", F.nullif(slug(F.element_at(_parts(F.col("folder")), -1)), F.lit("unnamed")), F.nullif(slug(F.regexp_replace("stem", r"(?i)[-_. ]?(rgb|visible|ir|infrared|thermal)($|[-_. ])", "$2")), F.lit("unnamed")))
    return v.join(a, ["folder", "stem"], "left").join(primary, "folder").select("video", "annotation", name.alias("sequence_id"), modality.alias("modality"), (F.col("video") == F.col("primary")).alias("primary"))


def numbered_first(names: DataFrame, most: int | None = None, col: str = "sequence_id") -> DataFrame:
    """Distinct names, those that are numbers first and by value, then the others by name; the first `most` of them."""
    d = names.select(col).distinct().withColumn("_n", F.coalesce(F.col(col).try_cast("int"), F.lit(1 << 30))).orderBy("_n", col)
    return (d if most is None else d.limit(most)).drop("_n")


def variants(listing: DataFrame) -> DataFrame:
    """Videos below each directory at the top."""
    return listing.where(has_suffix(F.col("path"), VIDEOS) & F.col("path").contains("/")).groupBy(F.element_at(_parts(F.col("path")), 1).alias("variant")).agg(F.count(F.lit(1)).alias("videos"))


def disk_estimate(listing: DataFrame, most: int, modalities: tuple[str, ...] = ("rgb", "ir")) -> DataFrame:
    """Bytes of the first `most` sequences (directories at the top) over the given modalities (directories below)."""
    d = listing.select(F.element_at(_parts(F.col("path")), 1).alias("sequence_id"), F.get(_parts(F.col("path")), F.lit(1)).alias("modality"), "length")
    return d.join(F.broadcast(numbered_first(d, most)), "sequence_id", "left_semi").where(F.col("modality").isin(*modalities)).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def inventory(spark: SparkSession, root: str, small: int = 1 << 20) -> DataFrame:
    """Files below root with length, and digest of those that are small or archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.when((F.col("length") <= small) | F.col("path").rlike(r"\.(zip|tar|gz|7z)$"), F.sha2("content", 256)).alias("sha256"))


# --- rows of annotations ----------------------------------------------------------------------


def object_rows(lines: DataFrame) -> DataFrame:
    """lines (file, value) of `frame n x y w h ...` -> (file, frame from 0, object, x1, y1, w, h): as many objects as n says and the row holds; rows cut short give what is whole. Frames of no object have none."""
    f = lines.select("file", F.split(F.trim(F.regexp_replace("value", r"[,\s]+", " ")), " ").alias("f")).where(F.size("f") >= 2)
    n = F.least(F.get("f", F.lit(1)).try_cast("int"), F.floor((F.size("f") - 2) / 4).cast("int"))
    d = f.select("file", (F.get("f", F.lit(0)).try_cast("int") - 1).alias("frame"), "f", n.alias("n")).where("frame is not null and n > 0")
    d = d.select("file", "frame", "f", F.explode(F.expr("sequence(0, n - 1)")).alias("object"))
    at = lambda i: F.get("f", 2 + 4 * F.col("object") + i).try_cast("double")
    return d.select("file", "frame", "object", *[at(i).alias(c) for i, c in enumerate(("x1", "y1", "w", "h"))]).dropna()


def sampled(frames: DataFrame, stride: int = 1, start: int = 0, most: int | None = None, key: str = "sequence_id") -> DataFrame:
    """Frames at start, start + stride, ... of each sequence, `most` at the most, renumbered from 0 as frame_index; frames are known by their number in the source, source_frame."""
    d = frames.where((F.col("source_frame") >= start) & (F.pmod(F.col("source_frame") - start, F.lit(stride)) == 0))
    d = d.withColumn("frame_index", F.dense_rank().over(Window.partitionBy(key).orderBy("source_frame")) - 1)
    return d if most is None else d.where(F.col("frame_index") < most)


def frames_with_objects(frames: DataFrame, objects: DataFrame, key: str = "sequence_id", least_visibility: float = 0.0) -> DataFrame:
    """Frames joined on their number in the source with their objects of enough visibility; frames without one keep a row."""
    seen = objects.where(F.coalesce("visibility", F.lit(1.0)) >= least_visibility) if "visibility" in objects.columns else objects
    return frames.join(seen, [key, "source_frame"], "left")


def truth_for(mot: DataFrame, labels: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Truth of each sequence from tracking rows where there are any, else from label rows, all as one object: key, frame, id, x1, y1, w, h, source."""
    cols = (key, "frame", "id", "x1", "y1", "w", "h")
    rest = labels.withColumn("id", F.lit(1)).join(mot.select(key).distinct(), key, "left_anti")
    return mot.select(*cols, F.lit("tracking").alias("source")).unionByName(rest.select(*cols, F.lit("labels").alias("source")))


def label_truth(rows: DataFrame, width: int, height: int, classes: tuple[int, ...] = (0,)) -> DataFrame:
    """Label rows of the given classes in pixels: file, x1, y1, w, h."""
    return rows.where(F.col("class_id").isin(*classes)).select("file", ((F.col("cx") - F.col("bw") / 2) * width).alias("x1"), ((F.col("cy") - F.col("bh") / 2) * height).alias("y1"), (F.col("bw") * width).alias("w"), (F.col("bh") * height).alias("h"))


# --- conversion -------------------------------------------------------------------------------


def convert(frames: DataFrame, boxes: DataFrame, dataset: str, variant: str = "full") -> DataFrame:
    """Index rows (readers.INDEX_SCHEMA) of frames (sequence_id, modality, frame_index, image, label, width, height) and their boxes (sequence_id, modality, frame_index, class_id, source_label, track_id, visibility). class_id null: a label without a class, counted as dropped."""
    key = ["sequence_id", "modality", "frame_index"]
    kept = F.when(F.col("class_id").isNotNull(), F.struct("class_id", "visibility", "source_label", "track_id"))
    per = boxes.groupBy(*key).agg(F.array_sort(F.collect_list(kept)).alias("b"), F.count_if(F.col("class_id").isNull()).cast("int").alias("dropped_boxes"))
    d = frames.join(per, key, "left").withColumn("b", F.coalesce("b", F.expr("cast(array() as array<struct<class_id:int,visibility:double,source_label:string,track_id:int>>)")))
    one = F.when(F.size(F.array_distinct(F.transform("b", lambda x: x["track_id"]))) == 1, F.get("b", F.lit(0))["track_id"])
    values = {"dataset": F.lit(dataset), "variant": F.lit(variant), "class_ids": F.transform("b", lambda x: x["class_id"]), "source_labels": F.transform("b", lambda x: x["source_label"]), "box_count": F.size("b"), "track_id": one, "visibility": F.transform("b", lambda x: F.coalesce(x["visibility"], F.lit(1.0))), "target_present": F.size("b") > 0, "dropped_boxes": F.coalesce("dropped_boxes", F.lit(0)), "tiles": F.expr("cast(array() as array<string>)"), "split": F.lit(""), "notes": F.lit("")}
    fields = [x.split(" ", 1) for x in INDEX_SCHEMA.split(", ")]
    return d.select(*[values.get(n, F.col(n) if n in d.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def repeated_keys(index: DataFrame) -> DataFrame:
    """Keys that two rows have: an index must have none."""
    return index.groupBy("sequence_id", "modality", "frame_index").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def class_histogram(index: DataFrame, names: tuple[str, ...] = CLASSES) -> DataFrame:
    """Boxes of each class by name, none left out."""
    n = index.select(F.explode("class_ids").alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("boxes"))
    d = index.sparkSession.createDataFrame(list(enumerate(names)), "class_id int, class_name string")
    return d.join(n, "class_id", "left").select("class_name", F.coalesce("boxes", F.lit(0)).alias("boxes"))


def report(index: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: frames, sequences, boxes, dropped boxes, empty frames, and the labels without a class with their counts in order."""
    unknown = boxes.where("class_id is null").groupBy("source_label").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_label", "n")))).alias("unknown_labels"))
    a = index.agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("sequence_id", "modality").alias("sequences"), F.coalesce(F.sum("box_count"), F.lit(0)).alias("boxes"), F.coalesce(F.sum("dropped_boxes"), F.lit(0)).alias("dropped"), F.count_if(F.col("box_count") == 0).alias("empty"))
    return a.crossJoin(unknown)


def problems(report_row: DataFrame, histogram: DataFrame, most_birds: float = 1.5) -> list[str]:
    """What makes a conversion fail or doubtful: frames but no box at all, or far more birds than drones, which speaks for a swapped mapping. One row and one row per class are looked at."""
    r = report_row.first()
    n = {x.class_name: x.boxes for x in histogram.collect()}
    out = []
    if r.frames and not r.boxes:
        out.append("error: frames without any box; no label was mapped")
    if n.get("drone", 0) and n.get("bird", 0) > most_birds * n["drone"]:
        out.append("error: more birds than drones, the mapping may be swapped")
    return out + [f"warning: unknown label {k!r} {v} times" for k, v in sorted((r.unknown_labels or {}).items())]


def checked(index: DataFrame, boxes: DataFrame) -> DataFrame:
    """The index, or an error: repeated keys, or problems() that are errors."""
    if (twice := repeated_keys(index).limit(1).collect()):
        raise ValueError(f"two frames of one key: {twice[0].asDict()}")
    if wrong := [p for p in problems(report(index, boxes), class_histogram(index)) if p.startswith("error")]:
        raise ValueError("; ".join(wrong))
    return index


def variant_of(asked: str | None, there: DataFrame) -> str:
    """The variant asked for if it is there, else the only one or the first by name; an error where it isn't there."""
    names = [r.variant for r in there.select("variant").distinct().orderBy("variant").limit(1000).collect()]
    if asked and names and asked not in names:
        raise ValueError(f"no variant {asked!r}; there are {', '.join(names)}")
    return asked or (names[0] if names else "full")


# --- configuration on the driver --------------------------------------------------------------


def load_config(path: str, environment: Mapping[str, str] | None = None, prefix: str = "SKYLEDGER") -> dict:
    """A JSON document overlaid by PREFIX_SECTION__FIELD of the environment, whose values are read as JSON where they can be."""
    with open(path) as f:
        config = json.load(f)
    for name, raw in sorted((os.environ if environment is None else environment).items()):
        if name.startswith(prefix + "_"):
            *sections, field = name[len(prefix) + 1 :].lower().split("__")
            at = config
            for s in sections:
                at = at.setdefault(s, {})
            try:
                at[field] = json.loads(raw)
            except ValueError:
                at[field] = raw
    return config
