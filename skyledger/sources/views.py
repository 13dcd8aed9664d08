"""Adapter views: the star schema's tables shaped into frames, boxes, predictions and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The sources' published values: name, median target in pixels, has bird negatives, track ids, visibility flags.
SOURCES = (
    ("dvb", 28, True, False, False),
    ("mavvid", 171, True, False, False),
    ("antiuav", 92, False, True, True),
    ("mmuav", 12, False, True, False),
    ("kaggle_cybersimar", 64, False, False, False),
    ("github_maciullo", 80, True, False, False),
    ("hf_seraphim", 72, False, False, False),
    ("kaggle_banderastepan", 56, False, False, False),
)


#: The same measured on the frames themselves, in SQL: a source's boxes are the larger, the higher its number is modulo four.
SOURCES_SQL = """m AS (SELECT l_orderkey % 97 % 8 AS ord, CAST(floor(median(least(CAST(floor(l_quantity) AS BIGINT) + 4, l_linenumber * 5 + 3) * (1 + l_orderkey % 97 % 8 % 4))) AS INT) AS median_px, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS birds, count(DISTINCT l_orderkey) AS frames, sum(l_partkey % 100) AS sure FROM lineitem GROUP BY 1),
src AS (SELECT s.ord, s.source, median_px, coalesce(birds * sum(n) OVER () > sum(birds) OVER () * n, false) AS bird_negatives, coalesce(n * sum(frames) OVER () > sum(n) OVER () * frames, false) AS track_ids, coalesce(sure * sum(n) OVER () > sum(sure) OVER () * n, false) AS visibility FROM (VALUES {names}) s(ord, source) LEFT JOIN m USING (ord))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources in order, as their frames show them: median target in pixels, and claims where a source has more than the corpus of birds among its boxes, of boxes a frame, of sure boxes. A source without frames has no median and claims nothing."""
    k = F.col("l_orderkey") % 97 % 8
    side = F.least(F.floor("l_quantity") + 4, F.col("l_linenumber") * 5 + 3) * (1 + k % 4)
    per = read(spark, sf_dir, "lineitem").groupBy(k.cast("int").alias("ord")).agg(F.floor(F.median(side)).cast("int").alias("median_px"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("birds"), F.count_distinct("l_orderkey").alias("frames"), F.sum(F.col("l_partkey") % 100).alias("sure"))
    names = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SOURCES)], "ord int, source string")
    # eight rows
    total = lambda c: F.sum(c).over(Window.partitionBy())
    more = lambda part, whole: F.coalesce(F.col(part) * total(whole) > total(part) * F.col(whole), F.lit(False))
    return names.join(F.broadcast(per), "ord", "left").select("ord", "source", "median_px", more("birds", "n").alias("bird_negatives"), more("n", "frames").alias("track_ids"), more("sure", "n").alias("visibility"))


def sources_sql() -> str:
    """CTEs m and src: the same in SQL."""
    return SOURCES_SQL.format(names=", ".join(f"({i}, '{s[0]}')" for i, s in enumerate(SOURCES)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.row_number().over(order).alias("box_ord"),
        (F.col("l_partkey") % 1800).alias("x1"),
        (F.col("l_suppkey") * 7 % 1000).alias("y1"),
        (F.floor("l_quantity") + 4).alias("w"),
        (F.col("l_linenumber") * 5 + 3).cast("long").alias("h"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("class_id"),
        ((F.col("l_partkey") % 100) / 100.0).alias("confidence"),
    )


def key_columns(frames: DataFrame) -> DataFrame:
    """frames with sequence, modality and source of their l_orderkey."""
    seq = F.col("l_orderkey") % 97
    return frames.withColumns({"sequence_id": F.concat(F.lit("seq_"), seq.cast("string")), "modality": F.when(F.col("l_orderkey") % 3 == 0, "ir").otherwise("rgb"), "dataset": F.concat(F.lit("src"), (seq % 8).cast("string"))})


def frame_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per frame with its boxes and its predictions as arrays of (box_ord, x1, y1, w, h): one scan and one exchange give both."""
    raw = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))
    f = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(raw.alias("raw"))
    box = "named_struct('box_ord', i + 1, 'x1', r.l_partkey % 1800, 'y1', r.l_suppkey * 7 % 1000, 'w', floor(r.l_quantity) + 4, 'h', cast(r.l_linenumber * 5 + 3 as bigint))"
    f = f.select("l_orderkey", F.expr(f"transform(raw, (r, i) -> {box})").alias("gt"))
    moved = "named_struct('box_ord', b.box_ord, 'x1', b.x1 + b.box_ord % 3, 'y1', b.y1, 'w', b.w, 'h', b.h)"
    return f.withColumn("pred", F.expr(f"transform(filter(gt, b -> (l_orderkey + b.box_ord) % 11 <> 0), b -> {moved})"))


def frame_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per frame with its sequence, modality and source; frame_index counts within sequence and modality."""
    f = read(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    f = f.withColumn("seq", F.col("l_orderkey") % 97)
    f = f.withColumn("sequence_id", F.concat(F.lit("seq_"), F.col("seq").cast("string"))).withColumn("modality", F.when(F.col("l_orderkey") % 3 == 0, "ir").otherwise("rgb"))
    f = f.withColumn("dataset", F.concat(F.lit("src"), (F.col("seq") % 8).cast("string")))
    order = Window.partitionBy("sequence_id", "modality").orderBy("l_orderkey")
    return f.withColumn("frame_index", F.row_number().over(order) - 1).drop("seq")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jittered boxes: x1 moved by box_ord % 3, every eleventh missing."""
    return boxes(spark, sf_dir).where((F.col("l_orderkey") + F.col("box_ord")) % 11 != 0).withColumn("x1", F.col("x1") + F.col("box_ord") % 3)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of identities by cameras, on a frame clock of 25 per second in each identity."""
    order = Window.partitionBy("global_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("global_id", F.col("user_id") % 40)
    return e.select("event_id", "global_id", ((F.col("event_id") * 7 + F.col("user_id") * 3) % 10).alias("camera_id"), (F.row_number().over(order) - 1).alias("frame_index"), (F.col("event_id") * 37 % 1000).alias("x"), (F.col("event_id") * 53 % 1000).alias("y"), ((F.col("event_id") % 100) / 100.0).alias("confidence"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit sign hashes of vectors, with copies of every twentieth in which up to six low bits differ."""
    e = read(spark, sf_dir, "embeddings")
    own = e.select(F.col("vec_id").alias("id"), F.expr("aggregate(sequence(0, 63), 0L, (s, i) -> if(embedding[i] > 0, s | shiftleft(1L, i), s))").alias("hash"))
    near = own.where("id % 20 = 0").select((F.col("id") + 10_000_000).alias("id"), F.expr("hash ^ (shiftleft(1L, cast(id div 20 % 7 as int)) - 1)").alias("hash"))
    return own.unionByName(near)


def detection_columns(events: DataFrame) -> DataFrame:
    """Detections on four moving objects per stream, a frame for each two hundred events. An object is seen by some of its events: boxes shake by a few pixels, scores are those of the events, vectors tell the objects apart."""
    e = events.select("event_id", (F.col("user_id") % 8).alias("stream"), (F.col("event_id") % 4).alias("object"), F.floor(F.col("event_id") / 200).alias("frame"), "user_id")
    # of a frame's events of one object only those of the first users count, or frames would be crowded
    e = e.where((F.col("event_id") % 200) < 8 * 8)
    x, y = F.col("object") * 260 + F.col("frame") * 5 % 900 + F.col("event_id") % 3, F.col("object") * 150 + F.col("frame") * 3 % 400 + F.col("event_id") % 5
    e = e.select("stream", "frame", F.col("event_id").alias("detection"), "object", x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 48).cast("double").alias("x2"), (y + 36).cast("double").alias("y2"), (F.col("event_id") * 13 % 100 / 100.0).alias("confidence"), (F.col("event_id") % 29 == 0).cast("int").alias("class_id"))
    return e.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == F.col("object"), 1.0).otherwise(0.05 * ((F.col("detection") + i) % 3))))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection_columns(read(spark, sf_dir, "events"))


def ground_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground positions of three objects per site, as four cameras see them, a frame for each sixty events; every 17th sighting has no position."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("site"), (F.col("event_id") % 3).alias("object"), F.floor(F.col("event_id") / 60).alias("frame"))
    x, y = F.col("object") * 100 + F.col("frame") % 500 * 0.4 + (F.col("event_id") % 7 - 3) * 0.3, F.col("object") * 50 + F.col("frame") % 500 * 0.3 + (F.col("event_id") % 5 - 2) * 0.3
    e = e.select("site", "frame", F.col("event_id").alias("observation"), "object", (F.floor(F.col("event_id") / 3) % 4).alias("camera"), F.when(F.col("event_id") % 17 != 0, x).cast("double").alias("x"), y.cast("double").alias("y"))
    return e.withColumn("node", F.col("camera") % 2).withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("object"), 1.0).otherwise(0.1)))
