"""Streams of observations: windowed counts with a watermark, and the edge gate as a custom stateful operator."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyledger.operators.passes import stateful
from skyledger.sources.sinks import discard, scratch

#: Fixed values of the edge gate.
HITS, PROMOTE, DROP, MISSED = 12, 0.60, 0.35, 4


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: a file, or a folder of part files to which more may be added."""
    # a pattern, as only that may stand for a file or for a folder
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def window_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and summed value per window and type; rows later than the watermark are dropped once their window has closed, and its state is freed then; so the stream is to be run in append or update mode."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("most")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "most")


def step(state: tuple[int, bool, int], frame: int, confidence: float) -> tuple[tuple[int, bool, int], str]:
    """One sighting: the new state (hits, alerted, last frame) and what the gate does: hold, promote, keep or drop. An object missed for more than four frames starts anew."""
    hits, alerted, last = state
    if last >= 0 and frame - last > MISSED:
        hits, alerted = 0, False
    hits += 1
    if alerted:
        return ((hits, True, frame), "keep") if confidence >= DROP else ((hits, False, frame), "drop")
    if confidence >= PROMOTE and hits >= HITS:
        return (hits, True, frame), "promote"
    return (hits, False, frame), "hold"


def edge_gate(sightings: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """sightings (source_id, object_id, event_id, frame, confidence) -> the changes: source_id, object_id, event_id, decision (promote or drop). State is three numbers a key; a task holds the rows of one key in one micro-batch.

    forget_ms: wall-clock time after which an object that isn't seen any more loses its state, for streams
    that never end. A query with it runs on without data, so it can't be drained.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, False, -1)
        rows = pd.concat(list(batches)).sort_values(["frame", "event_id"])
        out = []
        for event, frame, confidence in zip(rows.event_id, rows.frame, rows.confidence, strict=True):
            now, said = step(now, int(frame), float(confidence))
            if said in ("promote", "drop"):
                out.append((key[0], key[1], event, said))
        state.update(now)
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["source_id", "object_id", "event_id", "decision"])

    return sightings.groupBy("source_id", "object_id").applyInPandasWithState(run, "source_id long, object_id long, event_id long, decision string", "hits long, alerted boolean, last long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)


def sightings(events: DataFrame) -> DataFrame:
    return events.select(((F.col("event_id") * 7 + F.col("user_id") * 3) % 10).alias("source_id"), (F.col("user_id") % 40).alias("object_id"), "event_id", F.floor(F.col("event_id") / 400).alias("frame"), ((F.col("event_id") % 100) / 100.0).alias("confidence"))


def drain(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that is there and returns its result, written to the shared folder; its state is removed, as such a run isn't taken up again. mode "append" gives all rows; "update" the last row of each of keys."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own rows
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    stateful(spark)
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        discard(spark, f"{path}/state")
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    # without any event there is no folder of rows
    rows = spark.read.schema(schema).parquet(f"{path}/rows") if q.lastProgress is not None and any_rows(spark, f"{path}/rows") else spark.createDataFrame([], schema)
    if mode == "append":
        return rows.drop("batch")
    last = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("_r")
    return rows.groupBy(*keys).agg(last).select(*keys, "_r.*").select(*stream.columns)


def any_rows(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def publish(stream: DataFrame, put, checkpoint: str, every: str = "500 milliseconds"):
    """Starts a query that hands each micro-batch to put; what put raises is logged, and never stops the stream."""

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            put(batch, number)
        except Exception:  # noqa: BLE001
            logging.getLogger(__name__).exception("batch %s was not published", number)

    return stream.writeStream.outputMode("append").foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(window_counts(event_stream(spark, sf_dir)), "update", ("start", "event_type"))


def stream_edge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(edge_gate(sightings(event_stream(spark, sf_dir))), "append")
