"""Rows of one id with different texts: the same classes however the rows are dealt."""

import random

from skyledger.llm import minhash


def test_same_classes_in_any_order(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(80)]
    rows = []
    for i in range(60):
        t = list(base) if i % 2 else [r.choice(words) for _ in range(80)]
        t[r.randrange(80)] = "changed"
        rows.append((i // 3, " ".join(t)))
    rows += [(3, None), (3, ""), (None, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.class_id or 0, x.copy_of or 0)
    one, many = (sorted((tuple(x) for x in minhash.near_duplicates(df.orderBy("text").repartition(n)).collect()), key=str) for n in (1, 5))
    assert one == many and len(one) == len(rows)
    assert all(c is not None for i, c, *_ in one if i is not None)
