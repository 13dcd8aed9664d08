"""Layouts, conversion, sinks and configuration on small listings and files."""

import json

import pytest

from skyledger.sources import layouts, readers, sinks


def listing(spark, *paths):
    return spark.createDataFrame([(p, 10 * i + 10) for i, p in enumerate(paths)], "path string, length long")


def test_detect(spark):
    say = lambda *p: layouts.detect_layout(listing(spark, *p)).first().layout
    assert say("a/gt/gt.txt", "b/x.json") == "tracking folders" and say("v/a.mp4", "v/a.json") == "video annotations"
    assert say("annotations/a.txt", "a.mp4") == "frame rows" and say("labels/a.txt", "images/a.jpg") == "image and label pairs"
    assert say("a.txt", "a.jpg") == "flat labels" and say("a.jpg") is None


def test_sequences(spark):
    d = listing(spark, "train/Video_12/a.jpg", "train/Video_12/b.jpg", "train/x_00123.jpg", "other/pic.png", "lone.jpg", "train/n.txt", "train/1234567.jpg")
    got = {r.path: (r.sequence_id, r.how, r.frame_index) for r in layouts.sequences(d).collect()}
    assert got == {"train/Video_12/a.jpg": ("Video_12", "layout", 0), "train/Video_12/b.jpg": ("Video_12", "layout", 1), "train/x_00123.jpg": ("vid_00123", "filename", 0), "other/pic.png": ("dir_other", "parent", 0), "lone.jpg": ("orphan_lone", "orphan", 0), "train/1234567.jpg": ("dir_train", "parent", 0)}
    assert {r.sequence_id for r in layouts.sequences(d, "flat").collect()} >= {"vid_train_00123", "orphan_pic"}
    assert tuple(layouts.image_root(d).first()) == ("train", 2)


def test_label_files(spark):
    d = listing(spark, "images/a.jpg", "labels/a.txt", "b.jpg", "labels/b.txt", "b.txt", "c.png", "x/images/t/d.jpg", "x/labels/t/d.txt")
    assert {r.path: r.label for r in layouts.label_files(d).collect()} == {"images/a.jpg": "labels/a.txt", "b.jpg": "labels/b.txt", "c.png": None, "x/images/t/d.jpg": "x/labels/t/d.txt"}


def test_videos(spark):
    d = listing(spark, "s1/s1_rgb.mp4", "s1/s1_rgb.json", "s1/s1_ir.mp4", "s2/big.avi", "s2/s2.mp4", "s3/a.mov", "s3/b.mov")
    got = {r.video: (r.annotation, r.sequence_id, r.modality, r.primary) for r in layouts.video_pairs(d).collect()}
    assert got["s1/s1_rgb.mp4"] == ("s1/s1_rgb.json", "s1_s1", "rgb", False) and got["s1/s1_ir.mp4"][:3] == (None, "s1_s1", "ir")
    assert [v for v, r in got.items() if r[3]] and got["s2/s2.mp4"][3] and got["s3/b.mov"][3]
    assert {r.variant: r.videos for r in layouts.variants(d).collect()} == {"s1": 2, "s2": 2, "s3": 2}


def test_order_and_disk(spark):
    d = spark.createDataFrame([(x,) for x in ("10", "9", "b", "a", "9")], "sequence_id string")
    assert [r.sequence_id for r in layouts.numbered_first(d).collect()] == ["9", "10", "a", "b"]
    files = listing(spark, "2/rgb/a.jpg", "10/rgb/b.jpg", "2/ir/c.jpg", "2/depth/d.jpg", "x/rgb/e.jpg")
    assert layouts.disk_estimate(files, 1).first().bytes == 10 + 30 and layouts.disk_estimate(files, 9, ("rgb",)).first().bytes == 10 + 20 + 50
    assert layouts.disk_estimate(files.limit(0), 1).first().bytes == 0


def test_object_rows(spark):
    d = spark.createDataFrame([("f", "1 2 1 2 3 4 5 6 7 8"), ("f", "2 2 1 2 3 4 5"), ("f", "3 0"), ("f", "x 1 1 1 1 1"), ("f", "")], "file string, value string")
    assert sorted((r.frame, r.object, r.x1, r.h) for r in layouts.object_rows(d).collect()) == [(0, 0, 1.0, 4.0), (0, 1, 5.0, 8.0), (1, 0, 1.0, 4.0)]


def test_frames(spark):
    f = spark.createDataFrame([("s", i) for i in range(10)], "sequence_id string, source_frame int")
    assert [(r.source_frame, r.frame_index) for r in layouts.sampled(f, 3, 1, 2).orderBy("source_frame").collect()] == [(1, 0), (4, 1)]
    o = spark.createDataFrame([("s", 1, 0.1), ("s", 4, 0.9)], "sequence_id string, source_frame int, visibility double")
    j = layouts.frames_with_objects(layouts.sampled(f, 3, 1), o, least_visibility=0.5)
    assert {(r.source_frame, r.visibility) for r in j.collect()} == {(1, None), (4, 0.9), (7, None)}
    m = spark.createDataFrame([("a", 0, 7, 1.0, 1.0, 2.0, 2.0)], "sequence_id string, frame int, id int, x1 double, y1 double, w double, h double")
    labels = spark.createDataFrame([("a", 0, 1.0, 1.0, 2.0, 2.0), ("b", 0, 1.0, 1.0, 2.0, 2.0)], "sequence_id string, frame int, x1 double, y1 double, w double, h double")
    assert {(r.sequence_id, r.id, r.source) for r in layouts.truth_for(m, labels).collect()} == {("a", 7, "tracking"), ("b", 1, "labels")}


def frames_and_boxes(spark):
    f = spark.createDataFrame([("s", "rgb", i, f"i{i}.jpg", f"l{i}.txt", 640, 480) for i in range(3)], "sequence_id string, modality string, frame_index int, image string, label string, width int, height int")
    b = spark.createDataFrame([("s", "rgb", 0, 0, "uav", 5, 0.5), ("s", "rgb", 0, None, "kite", None, None), ("s", "rgb", 1, 1, "bird", 6, None), ("s", "rgb", 1, 0, "uav", 7, None)], "sequence_id string, modality string, frame_index int, class_id int, source_label string, track_id int, visibility double")
    return f, b


def test_convert(spark, tmp_path):
    f, b = frames_and_boxes(spark)
    index = layouts.convert(f, b, "x")
    rows = {r.frame_index: r for r in index.collect()}
    assert (rows[0].class_ids, rows[0].track_id, rows[0].dropped_boxes, rows[0].visibility) == ([0], 5, 1, [0.5])
    assert (rows[1].box_count, rows[1].track_id, rows[1].class_ids) == (2, None, [0, 1]) and rows[2].target_present is False
    r = layouts.report(index, b).first()
    assert (r.frames, r.boxes, r.dropped, r.empty, r.unknown_labels) == (3, 3, 1, 1, {"kite": 1})
    assert {x.class_name: x.boxes for x in layouts.class_histogram(index).collect()} == {"drone": 2, "bird": 1}
    assert layouts.problems(layouts.report(index, b), layouts.class_histogram(index)) == ["warning: unknown label 'kite' 1 times"]
    assert layouts.checked(index, b) is index
    with pytest.raises(ValueError, match="without any box"):
        layouts.checked(layouts.convert(f, b.where("class_id is null"), "x"), b)
    with pytest.raises(ValueError, match="one key"):
        layouts.checked(index.unionByName(index), b)
    birds = b.where("class_id = 1").crossJoin(spark.range(4)).drop("id").unionByName(b.where("source_label = 'uav'"))
    with pytest.raises(ValueError, match="more birds"):
        layouts.checked(layouts.convert(f, birds, "x"), birds)
    root = str(tmp_path / "index")
    sinks.write_index(index, root)
    assigned = spark.createDataFrame([("s", "rgb", "val")], "sequence_id string, modality string, split string")
    sinks.persist_splits(readers.read_index(spark, root), assigned, root, str(tmp_path / "assigned"))
    assert {r.split for r in readers.read_index(spark, root, "x").collect()} == {"val"} and readers.read_index(spark, root).count() == 3
    assert {r.stem for r in sinks.unique_stems(index).collect()} >= {"x__s__rgb__000002"}


def test_variant(spark):
    there = spark.createDataFrame([("b",), ("a",)], "variant string")
    assert layouts.variant_of(None, there) == "a" and layouts.variant_of("b", there) == "b" and layouts.variant_of(None, there.limit(0)) == "full"
    with pytest.raises(ValueError):
        layouts.variant_of("c", there)


def test_text_sinks(spark, tmp_path):
    t = spark.createDataFrame([(0, 3, 1.0, 2.0, 4.0, 6.0, 0.9)], "frame long, track_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert [r.value for r in sinks.predictions_text(t).collect()] == ["1,3,1.00,2.00,3.00,4.00,0.90,1,1.00"]
    assert sinks.manifest(("drone", "bird"), "/d", ("note",)) == "# note\npath: /d\ntrain: splits/split=train\nval: splits/split=val\nnc: 2\nnames:\n  0: drone\n  1: bird\n"
    tiles = spark.createDataFrame([("i", 2, 1, 0.0, 0.0, 32.0, 64.0, 64, 64)], "stem string, tile int, class_id int, x1 double, y1 double, x2 double, y2 double, width int, height int")
    assert tuple(sinks.tile_labels(tiles).first()) == ("i_t002", 1, 0.25, 0.5, 0.5, 1.0)
    root = str(tmp_path / "runs")
    for i in (1, 2):
        sinks.append_run(spark.createDataFrame([(i, i * 10)], "run_id int, trained_at int"), root)
    assert [r.run_id for r in sinks.list_runs(spark, root, "run_id int, trained_at int").collect()] == [2, 1]
    (tmp_path / "r.json").write_text(json.dumps({"a": {"b": 1}}, indent=2))
    assert sinks.read_report(spark, str(tmp_path / "r.json")).first().a.b == 1


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for s, ids in (("seq1", (1, 2)), ("seq 2", (1,))):
        (tmp_path / "d" / s / "gt").mkdir(parents=True)
        (tmp_path / "d" / s / "gt" / "gt.txt").write_text("".join(f"1,{i},5,5,2,2\n" for i in ids))
    got = readers.has_track_ids(readers.read_mot(spark, str(tmp_path / "d")))
    assert sorted((r.file.replace("%20", " "), r.has_ids) for r in got.collect()) == [("seq 2/gt/gt.txt", False), ("seq1/gt/gt.txt", True)]
    found = {r.path.split("/")[-3]: r.sha256 for r in layouts.inventory(spark, str(tmp_path / "d")).collect()}
    assert len(found) == 2 and all(len(x) == 64 for x in found.values())
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_index(spark, str(tmp_path / "bad")).collect()


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"rules": {"min_hits": 12}, "name": "x"}))
    got = layouts.load_config(str(p), {"SKYLEDGER_RULES__MIN_HITS": "5", "SKYLEDGER_NAME": "y z", "SKYLEDGER_NEW__FLAG": "true", "OTHER": "1"})
    assert got == {"rules": {"min_hits": 5}, "name": "y z", "new": {"flag": True}}
