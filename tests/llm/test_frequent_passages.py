"""Windows that the broadcast automaton holds are found as the exchanged ones are, whatever passages it holds; the query equals its SQL."""

import random
import re

import duckdb
import pytest

from skyledger.llm import substrings
from skyledger.llm.common import WORD


def corpus():
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["é", "😀", "long" * 40]
    shared = [[r.choice(words) for _ in range(r.randint(13, 50))] for _ in range(6)]
    rows = []
    for i in range(240):
        parts = [r.choice(shared) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 30))] for _ in range(r.randint(1, 6))]
        rows.append((1000 - i, r.choice([" ", "  ", "\n"]).join(w for p in parts for w in p)))
    return rows + [(5, "a " * 300), (4, "a " * 40), (3, ""), (2, None), (None, " ".join(shared[0])), (1000, rows[3][1])]


def brute(rows):
    seen, out = {}, {}
    for i in sorted({i for i, _ in rows if i is not None}):
        texts = [re.findall(WORD, t or "") for k, t in rows if k == i]
        for w in texts:
            gone = {q for j in range(len(w) - 12) if seen.get(tuple(w[j : j + 13]), i) < i for q in range(j, j + 13)}
            out.setdefault(i, []).append((len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
        for w in texts:
            for j in range(len(w) - 12):
                seen.setdefault(tuple(w[j : j + 13]), i)
    return sorted((i, *x) for i, some in out.items() for x in some)


@pytest.mark.parametrize("passages", [0, 3, 40, 4096])
def test_any_number_of_passages(spark, passages):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, passages=passages, sample=1).collect()]
    assert sorted(g for g in got if g[0] is not None) == brute(rows)
    assert len(got) == len(rows)


def test_passages_take_most_windows(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).where("doc_id is not null")
    texts = substrings.frequent_passages(df, 13, 4, sample=1)
    shared = substrings.with_first_documents(df, texts, 13)
    n = lambda held: sum(len(x.hashes) // 8 for x in substrings.anchored_windows(df, 13, 4, None, held).collect())
    assert n(shared) < 0.6 * n(None)


def test_query_equals_its_sql(spark, tmp_path):
    rows = [r for r in corpus()[:-2] if r[0] != 1000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in substrings.op10_substring_dedup(spark, str(tmp_path)).collect()) == sorted(con.execute(substrings.oracle()).fetchall())
