"""Lookups in documents: paths, first names, positions, absent and broken ones."""

import pytest
from pyspark.sql import functions as F

from skyledger.functions import documents as d
from skyledger.operators import evaluations


def test_paths():
    assert d.path_of("a.b.0") == "$['a']['b'][0]" and d.path_of("(metrics/mAP50-95(B))") == "$['metrics/mAP50-95(B)']" and d.path_of("a.(b.c)") == "$['a']['b.c']"
    for bad in ("a..b", "it's", ""):
        if bad:
            with pytest.raises(ValueError):
                d.path_of(bad)


def test_lookups(spark):
    rows = [(1, '{"a": {"b": [1, 2.5, null]}, "x": null, "y": "7", "names": ["p", "q"]}'), (2, '{"a": 3}'), (3, "{broken"), (4, None), (5, "[]")]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("doc", d.document(F.col("text")))
    doc = F.col("doc")
    got = df.select("k", d.at(doc, "a.b.1"), d.first_of(doc, ("x", "z", "y")), d.by_position(doc, ("none", "a.b"), F.lit(0)), d.by_position(doc, ("a.b",), F.lit(2)), d.count_at(doc, "names"), d.at(doc, "a", "double")).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(2.5, 7.0, 1.0, None, 2, None), (None, None, None, None, 0, 3.0)] + [(None, None, None, None, 0, None)] * 3


def test_classes(spark):
    text = '{"names": ["drone", "bird", "none"], "box": {"ap50": [0.5]}, "AP_S": [null, 0.25]}'
    runs = spark.createDataFrame([(1, text), (2, "{}")], "run long, text string").withColumn("doc", d.document(F.col("text")))
    assert sorted(map(tuple, evaluations.per_class(runs, "run").collect())) == [(1, 0, "drone", 0.5, None), (1, 1, "bird", None, 0.25)]
