"""Streams over folders, late rows, empty input, and a publisher that fails."""

import datetime as dt
import time

from skyledger.streaming import edge

SF = "/root/testdata/sf0.001"


def write(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def test_folder_and_late_rows(spark, tmp_path):
    path, day = f"{tmp_path}/events.parquet", dt.datetime(2024, 1, 1)
    write(spark, path, [(1, day, 1, "a", 1.0), (2, day + dt.timedelta(days=3), 1, "a", 2.0)])
    time.sleep(1.1)
    write(spark, path, [(3, day + dt.timedelta(days=3, hours=1), 1, "a", 5.0)])
    time.sleep(1.1)
    # its window has been closed by the watermark
    write(spark, path, [(4, day + dt.timedelta(hours=2), 1, "a", 9.0)])
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.start.day, r.events, r.most) for r in edge.drain(edge.window_counts(stream), "update", ("start", "event_type")).collect()}
    assert got == {(1, 1, 1.0), (4, 2, 5.0)}
    # all at once nothing is late
    assert {(r.start.day, r.events) for r in edge.stream_window_counts(spark, str(tmp_path)).collect()} == {(1, 2), (4, 2)}


def test_empty_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert edge.stream_window_counts(spark, str(tmp_path)).count() == 0 and edge.stream_edge_gate(spark, str(tmp_path)).count() == 0


def test_a_failed_publication_stops_nothing(spark, tmp_path):
    seen = []

    def put(batch, number):
        seen.append((number, batch.count()))
        raise OSError("away")

    q = edge.publish(edge.event_stream(spark, SF).select("event_id"), put, f"{tmp_path}/state", "100 milliseconds")
    for _ in range(100):
        if seen:
            break
        time.sleep(0.2)
    assert seen and q.exception() is None and q.isActive
    q.stop()
