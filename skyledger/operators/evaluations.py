"""Metrics out of evaluation documents, whose names shift from version to version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import documents as d
from skyledger.sources.views import read

#: Names of the headline metrics in documents, the preferred first.
HEADLINES = {
    "precision": ("box.mp", "(metrics/precision(B))"),
    "recall": ("box.mr", "(metrics/recall(B))"),
    "map50": ("box.map50", "(metrics/mAP50(B))"),
    "map50_95": ("box.map", "(metrics/mAP50-95(B))"),
}
#: Lists of a class's metrics by its position.
PER_CLASS = {"ap50": ("box.ap50", "ap50"), "small": ("box.AP_S", "AP_S", "ap_small")}


def headlines(runs: DataFrame, doc: str = "doc") -> DataFrame:
    """runs with a column per headline metric; null where no name of it is there."""
    return runs.withColumns({name: d.first_of(F.col(doc), paths) for name, paths in HEADLINES.items()})


def per_class(runs: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """(key, position, class, metrics of PER_CLASS): a row per class named in a run's document that any of them is known for."""
    named = runs.select(key, doc, F.posexplode(d.at(F.col(doc), "names", "array<string>")).alias("position", "class"))
    out = named.withColumns({name: d.by_position(F.col(doc), paths, F.col("position")) for name, paths in PER_CLASS.items()})
    return out.select(key, "position", "class", *PER_CLASS).where(" or ".join(f"{m} is not null" for m in PER_CLASS))


def documents_of(events: DataFrame) -> DataFrame:
    """A document per event around its own properties: metrics under the names of one of three versions, some of them null or missing, every eleventh broken."""
    k = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    new = text('"box": {"mp": 0.', 100 + k % 800, ', "mr": null, "map50": 0.', 100 + k % 700, ', "ap50": [0.', 10 + k % 80, ", 0.", 10 + k % 70, '], "AP_S": [null, 0.', 10 + k % 60, ']}, "nt_per_class": [', k % 40, ", null, ", k % 7, "]")
    old = text('"metrics/precision(B)": 0.', 100 + k % 500, ', "metrics/recall(B)": 0.', 100 + k % 400, ', "metrics/mAP50-95(B)": "none", "ap_small": [0.', 10 + k % 50, '], "instances": ', k % 90)
    body = F.when(k % 3 == 0, new).when(k % 3 == 1, old).otherwise('"box": []')
    names = F.when(k % 2 == 0, '["drone", "bird"]').otherwise('["drone"]')
    whole = text("{", body, ', "names": ', names, ', "properties": ', F.col("props"), F.when(k % 11 == 0, "").otherwise("}"))
    return events.select("event_id", whole.alias("text")).withColumn("doc", d.document(F.col("text")))


def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline metrics, number of classes, the property k and the counted instances of each event's document."""
    r = headlines(documents_of(read(spark, sf_dir, "events")))
    return r.select("event_id", *HEADLINES, d.count_at(F.col("doc"), "names").alias("classes"), d.at(F.col("doc"), "properties.k", "bigint").alias("k"), d.counted(F.col("doc"), ("nt_per_class", "instances")).alias("instances"))


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by class of each event's document."""
    return per_class(documents_of(read(spark, sf_dir, "events")), "event_id")


def oracles(_views: str) -> dict[str, str]:
    """SQL of both, by JSON functions over the same texts."""
    docs = """WITH x AS (SELECT event_id, '{' || CASE event_id % 3 WHEN 0 THEN '"box": {"mp": 0.' || (100 + event_id % 800) || ', "mr": null, "map50": 0.' || (100 + event_id % 700) || ', "ap50": [0.' || (10 + event_id % 80) || ', 0.' || (10 + event_id % 70) || '], "AP_S": [null, 0.' || (10 + event_id % 60) || ']}, "nt_per_class": [' || (event_id % 40) || ', null, ' || (event_id % 7) || ']'
  WHEN 1 THEN '"metrics/precision(B)": 0.' || (100 + event_id % 500) || ', "metrics/recall(B)": 0.' || (100 + event_id % 400) || ', "metrics/mAP50-95(B)": "none", "ap_small": [0.' || (10 + event_id % 50) || '], "instances": ' || (event_id % 90) ELSE '"box": []' END
  || ', "names": ' || CASE WHEN event_id % 2 = 0 THEN '["drone", "bird"]' ELSE '["drone"]' END || ', "properties": ' || props || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END AS text FROM events),
d AS (SELECT event_id, CASE WHEN json_valid(text) THEN text::JSON END AS doc FROM x)
"""
    number = lambda p: f"TRY_CAST(json_extract_string(doc, '{p}') AS DOUBLE)"
    json_path = lambda p: '$."' + p[1:-1] + '"' if p[0] == "(" else "$." + ".".join(f'"{x}"' for x in p.split("."))
    heads = ", ".join(f"coalesce({', '.join(number(json_path(p)) for p in paths)}) AS {name}" for name, paths in HEADLINES.items())
    listed = ", ".join(f"coalesce({', '.join(number(json_path(p) + chr(91) + chr(39) + ' || position || ' + chr(39) + chr(93)) for p in paths)}) AS {name}" for name, paths in PER_CLASS.items())
    return {
        "evaluation_metrics": docs + f"SELECT event_id, {heads}, coalesce(json_array_length(doc, '$.names'), 0)::INT AS classes, TRY_CAST(json_extract_string(doc, '$.properties.k') AS BIGINT) AS k, coalesce(list_sum(CAST(json_extract(doc, '$.nt_per_class') AS BIGINT[])), TRY_CAST(json_extract_string(doc, '$.instances') AS BIGINT))::BIGINT AS instances FROM d",
        "class_metrics": docs + f", n AS (SELECT event_id, doc, unnest(range(json_array_length(doc, '$.names')::BIGINT))::INT AS position FROM d WHERE doc IS NOT NULL), m AS (SELECT event_id, position, json_extract_string(doc, '$.names[' || position || ']') AS class, {listed} FROM n) SELECT * FROM m WHERE {' OR '.join(f'{x} IS NOT NULL' for x in PER_CLASS)}",
    }


QUERIES = (evaluation_metrics, class_metrics)
