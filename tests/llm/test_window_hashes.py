"""Windows of words that differ stay apart, and the windows of a frequent anchor are split without changing what is found."""

import random

from skyledger.llm import substrings

HEAD = " ".join(f"p{i}" for i in range(12))


def test_windows_with_equal_low_bytes(spark):
    # these two windows share their anchor and 40 bits of their hashes
    df = spark.createDataFrame([(1, HEAD + " x3462567"), (2, HEAD + " x1365397"), (3, HEAD + " x1365397")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 13}


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).update(range(r.a, r.b))
    return out


def test_frequent_anchor_is_split(spark):
    r = random.Random(6)
    rows = []
    for i in range(200):
        fill = [f"f{r.randrange(9)}" for _ in range(24)]
        rows.append((i, " ".join(fill[:12] + HEAD.split()[:5] + fill[12:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    most = lambda hot: max(sum(len(x.hashes) // 8 for x in g) for g in groups(substrings.anchored_windows(df, 13, 4, hot)))
    hot = substrings.hot_anchors(df, 13, 4, 50, 1)
    assert hot and most(hot) < most(None) / 2
    whole, split = substrings.repeated_spans(df), substrings.repeated_spans(df, most=5, sample=1)
    assert covered(whole) == covered(split)


def groups(df):
    out = {}
    for x in df.collect():
        out.setdefault(x.anchor, []).append(x)
    return out.values()
