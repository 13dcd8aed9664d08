"""Tiles and their labels on disk agree in number and geometry; runs that repeat or fail leave nothing behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.sources import materialise


@pytest.fixture(scope="module")
def images(spark, tmp_path_factory):
    root, r = tmp_path_factory.mktemp("src"), np.random.default_rng(5)
    for name, (h, w, c) in {"a": (90, 130, 3), "b": (40, 30, 1)}.items():
        (root / f"{name}.png").write_bytes(materialise.png(r.integers(0, 256, (h, w, c), np.uint8)))
    d = spark.read.format("image").load(str(root)).select("image.*")
    return root, d.withColumn("stem", F.regexp_extract("origin", r"([^/]+)\.png$", 1))


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc"))


def test_tiles_and_labels(spark, images, tmp_path):
    _, d = images
    boxes = spark.createDataFrame([("a", 1, 10.0, 10.0, 30.0, 20.0), ("a", 0, 50.0, 40.0, 90.0, 80.0), ("b", 0, 0.0, 0.0, 5.0, 5.0)], "stem string, class_id int, x1 double, y1 double, x2 double, y2 double")
    root = str(tmp_path / "out")
    for _ in range(2):  # a second run gives the same files
        materialise.write_files(materialise.tile_files(d, 64), root)
        materialise.write_files(materialise.tile_label_files(d, boxes, 64), root)
        names = listed(root)
        stems = sorted(n[7:-4] for n in names if n.startswith("images/"))
        assert stems == sorted(n[7:-4] for n in names if n.startswith("labels/")) and stems[-1] == "b_t000" and len(stems) == 7
        assert names == sorted(["_SUCCESS", *(f"images/{s}.png" for s in stems), *(f"labels/{s}.txt" for s in stems)])
    whole = {r.stem: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels) for r in d.collect()}
    cut = {r.stem: r for r in spark.read.format("image").load(f"{root}/images").select("image.*").withColumn("stem", F.regexp_extract("origin", r"([^/]+)\.png$", 1)).collect()}
    first = np.frombuffer(cut["a_t000"].data, np.uint8).reshape(64, 64, 3)
    assert (first == whole["a"][:64, :64]).all() and (cut["b_t000"].height, cut["b_t000"].width) == (40, 30)
    line = open(f"{root}/labels/a_t000.txt").read().split()
    assert line[0] == "1" and [float(v) * 64 for v in line[1:]] == pytest.approx([20, 15, 20, 10], abs=1e-3)
    # every box keeps its share in some window, and all stay within
    for s in stems:
        for row in open(f"{root}/labels/{s}.txt"):
            _, cx, cy, w, h = map(float, row.split())
            assert 0 <= cx - w / 2 + 1e-6 and cx + w / 2 <= 1 + 1e-6 and 0 <= cy - h / 2 + 1e-6 and cy + h / 2 <= 1 + 1e-6


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    good = spark.createDataFrame([("x/a.bin", b"1"), ("b.bin", None), ("b.bin", None)], "name string, content binary")
    materialise.write_files(good, root)
    assert listed(root) == ["_SUCCESS", "b.bin", "x/a.bin"] and open(f"{root}/_SUCCESS").read() == "2 files, 1 bytes\n"
    for bad in ("../out.bin", "/abs", "_staging/x", ""):
        with pytest.raises(Exception, match="no name below"):
            materialise.write_files(good.withColumn("name", F.concat(F.lit("new/"), "name")).unionByName(spark.createDataFrame([(bad, b"2")], good.schema)), root)
        assert [n for n in listed(root) if "new" in n] == [] and os.listdir(f"{root}/_staging") == []


def test_images_as_they_are(spark, images, tmp_path):
    root, _ = images
    names = spark.createDataFrame([(f"file:{root}/a.png", "src__seq__rgb__000001")], "path string, stem string")
    materialise.write_files(materialise.image_files(spark, names), str(tmp_path / "out"))
    assert (tmp_path / "out/images/src__seq__rgb__000001.png").read_bytes() == (root / "a.png").read_bytes()
