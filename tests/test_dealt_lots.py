"""Where lots become rows, they are dealt to more tasks than Spark makes of their bytes, evenly."""

import pytest
from pyspark.sql import functions as F

from skyledger.operators import coverage

SF = "/root/testdata/sf0.001"
NAMES = ("view_exits", "handover_candidates", "search_order")


@pytest.mark.parametrize("name", NAMES)
def test_rows_come_from_many_tasks(spark, name):
    df = next(f for f in coverage.QUERIES if f.__name__ == name)(spark, SF)
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert df.rdd.getNumPartitions() >= coverage.TASKS * spark.sparkContext.defaultParallelism
    assert max(rows) * 4 < sum(rows)
