"""Shards equal their SQL on tables with a hot text, null ids and texts, ties and few rows."""

import random

import duckdb
import pytest

from skyledger.llm import sharding


@pytest.mark.parametrize("kind", ["hot", "few", "one", "mixed"])
def test_query_equals_its_sql(spark, tmp_path, kind):
    r = random.Random(7)
    text = lambda: "é" * r.randrange(3) + "x" * r.randrange(400)
    rows = {
        "hot": [(i, "the same text" if i % 3 == 0 else text()) for i in range(900)],
        "few": [(i, text()) for i in range(10)],
        "one": [(1, "a")] * 40,
        "mixed": [(i, text()) for i in range(300)] + [(None, None)] * 20 + [(None, "n")] * 5 + [(7, ""), (7, ""), (7, "z" * 20_000)],
    }[kind]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    got = [tuple(x) for x in sharding.op1_histogram_sharding(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(con.execute(sharding.oracle()).fetchall(), key=key)
    for s in {x[4] for x in got}:
        assert sorted(x[5] for x in got if x[4] == s) == list(range(sum(x[4] == s for x in got)))


def test_more_ranges_change_nothing(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else "x" * r.randrange(300)) for i in range(600)], "doc_id long, text string").repartition(4)
    a, b = ({tuple(x) for x in sharding.shard_documents(df, 6, ranges_per_shard=n).collect()} for n in (1, 64))
    assert a == b and len(a) == 600
