"""Very many matches in one text cost no square of their number, and the query equals its SQL."""

import re
import time

import duckdb

from skyledger.llm import secrets


def test_many_matches(spark):
    text = "é token=abcdef1, " * 40_000
    df = spark.createDataFrame([(1, text), (2, None), (2, "x token=abcdef1"), (None, "AKIA" + "Z" * 16)], "doc_id long, text string")
    begin = time.time()
    got = secrets.scan_secrets(df).collect()
    assert time.time() - begin < 30
    first = next(r for r in got if r.doc_id == 1)
    want = [(m.start(), m.end()) for m in re.finditer(secrets.BASE_RULES[0].pattern, text)]
    assert [(s.start, s.end) for s in first.found] == want
    assert sorted((r.doc_id or 0, len(r.found)) for r in got) == [(0, 1), (1, 40_000), (2, 0), (2, 1)]


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(1, "Password: 'abcdef' ghp_" + "a1" * 20), (2, None), (3, ""), (3, "xoxb-123456789012 " + "0f" * 14 + "AKIA" + "A1" * 9), (4, "-----BEGIN RSA PRIVATE KEY-----\n😀 api_key=abcdef\"'"), (5, "token=abc " * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(secrets.oracle()).fetchall()
    assert sorted(tuple(r) for r in secrets.op8_trigram_secret_scan(spark, str(tmp_path)).collect()) == sorted(want)


def test_postings(spark):
    df = spark.createDataFrame([(1, "an AKIA key"), (2, "nothing"), (3, None), (4, "Token")], "doc_id long, text string")
    assert {(r.trigram, r.doc_id) for r in secrets.postings(df, ["aki", "kia", "tok"], "doc_id").collect()} == {("aki", 1), ("kia", 1), ("tok", 4)}
