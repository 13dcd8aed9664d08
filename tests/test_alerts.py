"""The running mean against its fold, also over long histories and leading zeros."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.operators.alerts import running_mean


def test_fold(spark):
    r = random.Random(4)
    groups = {g: [r.choice([0.0, 0.0, r.random()]) if g < 3 else r.random() for _ in range(n)] for g, n in enumerate((1, 2, 9, 40, 700))} | {5: [0.0, 0.0], 6: [0.0, 0.5, 0.0]}
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, at int, v double").withColumn("back", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("at"))))
    for row in df.groupBy("g").agg(running_mean("v", "at", "back").alias("m")).collect():
        mean = 0.0
        for v in groups[row.g]:
            mean = v if mean == 0 else 0.7 * mean + 0.3 * v
        assert row.m == pytest.approx(mean, rel=1e-12, abs=1e-15)
