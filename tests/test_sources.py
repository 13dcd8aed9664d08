"""Readers and sinks on small files, and the edge gate against a plain loop."""

import json

from pyspark.sql import Row

from skyledger.sources import readers, sinks
from skyledger.streaming import edge

SF = "/root/testdata/sf0.001"


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]


def test_mot_round_trip(spark, tmp_path):
    rows = [(f, i, 1.5 * f, 2.0, 10.0, 5.0, 0.9, 1.0) for f in range(4) for i in (1, 2)]
    d = spark.createDataFrame(rows, "frame int, id int, x1 double, y1 double, w double, h double, conf double, visibility double")
    sinks.write_mot(d, str(tmp_path / "gt"))
    got = readers.read_mot(spark, str(tmp_path / "gt"))
    assert sorted((r.frame - 1, r.id, r.x1) for r in got.collect()) == sorted((f, i, x) for f, i, x, *_ in rows)
    assert all(r.has_ids for r in readers.has_track_ids(got).groupBy().agg({"has_ids": "max"}).withColumnRenamed("max(has_ids)", "has_ids").collect())
    (tmp_path / "short.txt").write_text("1 2 3\n1 1 5 5 2 x\n2 1 5 5 2 2\n")
    assert [(r.frame, r.visibility) for r in readers.read_mot(spark, str(tmp_path / "short.txt")).collect()] == [(2, 1.0)]


def test_labels(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("# c\n0 0.5 0.5 0.1 0.1\nUAV 0.5 0.5 0.2 0.2\nnone 0.5 0.5 0.2 0.2\n0 0.5\n0 1.5 0.5 0.1 0.1\n0 0.5 0.5 0.001 0.1\n0 0.95 0.5 0.2 0.2\n")
    rows = readers.label_rows(spark, str(p), 640, 480, {"uav": 0})
    assert {r.reason: r.rows for r in readers.label_tally(rows).collect()} == {"kept": 3, "unknown": 1, "degenerate": 1, "out_of_frame": 1, "tiny": 1}
    clamped = [r for r in rows.where("reason = 'kept'").collect() if r.cx > 0.6]
    assert abs(clamped[0].cx - 0.925) < 1e-9 and abs(clamped[0].bw - 0.15) < 1e-9
    sinks.write_labels(rows.where("reason = 'kept'").withColumnRenamed("file", "stem"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value = '0 0.925000 0.500000 0.150000 0.200000'").count() == 1


def test_layouts(spark, tmp_path):
    box = {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4, "v": 1, "id": 7}
    docs = {"a": {"frames": {"1": [box], "2": []}}, "b": {"1": [box], "2": [box | {"v": 0}]}, "c": [{"frame_id": 1, "objects": [box]}, {"frame_id": 2, "objects": []}]}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    got = sorted((r.file, r.frame, r.x1, r.y2) for r in readers.read_frame_objects(spark, str(tmp_path)).collect() if r.x1 is not None)
    assert got == [(f"{n}.json", 0, 1.0, 4.0) for n in "abc"]
    assert readers.read_frame_objects(spark, str(tmp_path)).where("x1 is null").count() == 3


def test_index(spark, tmp_path):
    root = str(tmp_path / "index")
    assert readers.read_index(spark, root).count() == 0
    cols = readers.INDEX_SCHEMA
    d = spark.createDataFrame([Row(**{c.split()[0]: None for c in cols.replace("array<", "array").split(", ")})], cols)
    one = d.selectExpr(*[f"'{v}' as {c}" if (v := {"dataset": "x", "variant": "full", "sequence_id": "s", "split": ""}.get(c)) is not None else c for c in d.columns])
    sinks.write_index(one, root)
    sinks.write_index(one.selectExpr(*[f"'y' as {c}" if c == "dataset" else c for c in one.columns]), root)
    assert readers.read_index(spark, root).count() == 2 and readers.read_index(spark, root, "x").count() == 1
    assert readers.read_index(spark, root, "none").count() == 0
    sinks.write_splits(one.selectExpr("split", "'i.jpg' as image"), str(tmp_path / "splits"))
    assert [(r.split, r.value) for r in spark.read.text(str(tmp_path / "splits")).collect()] == [("train", "i.jpg")]


def test_curve(spark, tmp_path):
    p = tmp_path / "results.csv"
    p.write_text("epoch, train/box_loss, metrics/mAP50-95(B)\n1, 0.9, 0.5\n2, 0.4, 0.7\n3, 0.5, 0.7\n")
    _, best = readers.read_curve(spark, str(p))
    assert best.first().asDict() == {"epochs": 3, "best_epoch": 2, "train/box_loss": 0.4, "metrics/mAP50-95(B)": 0.7}


def test_edge_gate(spark):
    rows = edge.sightings(spark.read.parquet(f"{SF}/events.parquet")).collect()
    state, want = {}, []
    for r in sorted(rows, key=lambda r: (r.frame, r.event_id)):
        key = (r.source_id, r.object_id)
        state[key], said = edge.step(state.get(key, (0, False, -1)), r.frame, r.confidence)
        if said in ("promote", "drop"):
            want.append((*key, r.event_id, said))
    got = [(r.source_id, r.object_id, r.event_id, r.decision) for r in edge.stream_edge_gate(spark, SF).collect()]
    assert sorted(got) == sorted(want) and {"promote", "drop"} >= {x[3] for x in got}
