"""The annotation source against the text readers; malformed rows counted or fatal; files chosen by filters; a folder that grows."""

import random
import time

import pytest

from skyledger.sources import annotations, readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, r = tmp_path_factory.mktemp("notes"), random.Random(2)
    (root / "a/b").mkdir(parents=True)
    for name in ("a/one.txt", "a/b/two.txt", "three.txt", "empty.txt"):
        lines = [] if name == "empty.txt" else [f"{f},{r.randrange(9)},{r.uniform(0, 90):.3f},{r.uniform(0, 90):.3f},10,12" + r.choice(["", ",0.5", ",0.5,1,0.25", ",x"]) for f in range(40)]
        if name == "three.txt":
            lines += ["", "# note", "1,2,3", "1,2,3,4,5,nan", "a,2,3,4,5,6", "7 8 1.5 2 3 4"]
        (root / name).write_text("\n".join(lines))
    (root / "other.csv").write_text("1,2,3,4,5,6")
    return root


def read(spark, path, **options):
    annotations.register(spark)
    return spark.read.format("annotations").options(**options).load(str(path))


def test_same_rows_as_the_text_reader(spark, folder):
    got = read(spark, folder).where("reason is null").drop("line", "reason")
    want = readers.read_mot(spark, f"{folder}/*.txt").count() + 80
    assert got.count() == want == 121
    own = sorted(map(tuple, got.where("file like 'a/%'").collect()))
    assert own == sorted(map(tuple, readers.read_mot(spark, f"{folder}/a").selectExpr("concat('a/', file)", "frame", "id", "x1", "y1", "w", "h", "conf", "class", "visibility").collect()))


def test_tally_and_strict(spark, folder):
    t = {r.file: r for r in annotations.tally(read(spark, folder, taskBytes="100")).collect()}
    assert set(t) == {"a/one.txt", "a/b/two.txt", "three.txt"}
    assert (t["three.txt"].rows, t["three.txt"].sound, t["three.txt"].malformed) == (44, 41, {"short": 1, "no number": 2}) and t["a/one.txt"].malformed == {}
    assert read(spark, folder / "a", strict="true").count() == 80
    with pytest.raises(Exception, match="three.txt, line 43: short"):
        read(spark, folder, strict="true").collect()
    with pytest.raises(Exception, match="kind is one of"):
        read(spark, folder, kind="x").count()


def test_filters_choose_files(folder):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    chosen = lambda *f: (r := annotations.AnnotationReader({"path": str(folder)}), list(r.pushFilters(list(f))), [x[0] for p in r.partitions() for x in p.files])[1:]
    assert chosen(StringStartsWith(("file",), "a/"), IsNotNull(("frame",))) == ([IsNotNull(("frame",))], ["a/b/two.txt", "a/one.txt"])
    assert chosen(EqualTo(("file",), "three.txt"))[1] == ["three.txt"] and chosen(In(("file",), ("a/one.txt", "no")))[1] == ["a/one.txt"]
    assert len(annotations.AnnotationReader({"path": str(folder), "taskBytes": "1"}).partitions()) == 4
    assert annotations.AnnotationReader({"path": f"{folder}/none"}).partitions() == []


def test_filter_reaches_the_source(spark, folder):
    rows = read(spark, folder, strict="true").where("file = 'a/one.txt'")
    # the malformed file is never opened
    assert rows.count() == 40


def test_labels(spark, tmp_path):
    (tmp_path / "x.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.05 0.5 0.2 0.2\nbird 0.5 0.5 0.1 0.1\n0 1.5 0.5 0.1 0.1\n0 0.5 0.5 0 0.1\n0 0.5\n")
    rows = {r.line: r for r in read(spark, tmp_path, kind="labels").collect()}
    assert [rows[i].reason for i in range(1, 7)] == [None, None, "unknown", "out_of_frame", "degenerate", "degenerate"]
    assert [rows[i].clamped for i in (1, 2)] == [False, True] and (rows[2].cx, rows[2].bw) == pytest.approx((0.075, 0.15))
    assert annotations.tally(read(spark, tmp_path, kind="labels")).first().clamped == 1
    kept = readers.label_rows(spark, str(tmp_path), 1000, 1000).where("reason = 'kept'").orderBy("cx").collect()
    assert [(k.class_id, pytest.approx(k.cx), pytest.approx(k.bw)) for k in kept] == [(rows[i].class_id, rows[i].cx, rows[i].bw) for i in (2, 1)]


def test_stream(spark, tmp_path):
    annotations.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("0,1,2,3,4,5\n1,1,2,3,4,5\n")
    seen = []

    def run():
        q = spark.readStream.format("annotations").load(f"{tmp_path}/in").writeStream.foreachBatch(lambda b, n: seen.extend((r.file, r.frame) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="200 milliseconds").start()
        q.processAllAvailable()
        q.stop()

    run()
    time.sleep(0.05)
    (tmp_path / "in/0.txt").write_text("7,1,2,3,4,5")
    run()
    assert seen == [("a.txt", 0), ("a.txt", 1), ("0.txt", 7)]
