"""Sequences of paths by each rule, on paths whose sequence is known."""

from pyspark.sql import functions as F

from skyledger.functions.names import RULES, sequence_of, stem_of

#: path -> sequence and how, by frames, pairs and flat.
PATHS = {
    "scene01/a.jpg": (("scene01", "layout"),) * 3,
    "x/track_3/00001.jpg": (("track_3", "layout"), ("track_3", "layout"), ("vid_track_3_00001", "filename")),
    "vid7/a.jpg": (("vid7", "layout"), ("vid7", "layout"), ("orphan_a", "orphan")),
    "clips/a.jpg": (("clips", "layout"),) * 3,
    "my_source/a.jpg": (("dir_my_source", "parent"), ("my_source", "layout"), ("orphan_a", "orphan")),
    "train/abc123.jpg": (("dir_train", "parent"), ("frame_abc123", "orphan"), ("orphan_abc123", "orphan")),
    "abc_123.jpg": (("vid_123", "filename"), ("clip_123", "filename"), ("vid_123", "filename")),
    "birds/bird_image_000123.png": (("vid_000123", "filename"), ("clip_000123", "filename"), ("vid_birds_000123", "filename")),
    "park/img_1234567.jpg": (("dir_park", "parent"), ("park", "parent"), ("orphan_img_1234567", "orphan")),
    "park/12.jpg": (("dir_park", "parent"), ("park", "parent"), ("orphan_12", "orphan")),
    "park/drone/0042-7.v2.jpg": (("vid_0042", "filename"), ("clip_0042", "filename"), ("vid_drone_0042", "filename")),
    "park/raw/.x/p.jpg": (("dir_.x", "parent"), ("park", "parent"), ("orphan_p", "orphan")),
    "lone.jpg": (("orphan_lone", "orphan"), ("frame_lone", "orphan"), ("orphan_lone", "orphan")),
}


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS] + [(None,)], "path string")
    got = {r.path: tuple(tuple(r[k]) for k in RULES) for r in df.select("path", *[sequence_of(F.col("path"), k).alias(k) for k in RULES]).collect()}
    assert got.pop(None) == ((None, None),) * 3
    assert got == PATHS


def test_stems(spark):
    df = spark.createDataFrame([("a/b.c.jpg",), (".hidden",), ("a/x",)], "path string")
    assert [r.s for r in df.select(stem_of(F.col("path")).alias("s")).collect()] == ["b.c", ".hidden", "x"]
