"""Importance resampling against a plain loop, also with runs of words, nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import re
import zlib

import pytest

from skyledger.llm import resampling

SCHEMA = "doc_id long, text string, bucket int, weight string, rank long, feature string, n long"


def plain(docs, target, buckets, most, least, percent, seed=2024):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for of, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for g in grams(x)[1]:
                of[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        words, found = grams(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = [tuple(r[:4]) for r in drawn[: percent * len(drawn) // 100]]
    out = [(*r, k + 1) for k, r in enumerate(drawn)]
    left = [tuple(r[:4]) for r in rows]
    for r in drawn:
        left.remove(r)
    return sorted(out + [(*r, None) for r in left], key=repr)


def texts():
    words = "Apple böse C3PO the end.of 😀 x_y über TREE z".split()
    rows = [(i, " ".join(words[(i * k + k * k) % len(words)] for k in range(i % 40 + 1))) for i in range(90)]
    return [*rows, rows[39], rows[39], (39, rows[38][1]), (None, rows[35][1]), (None, None), (200, ""), (201, None), (202, "word " * 50_000)]


@pytest.mark.parametrize("most", [1, 3])
def test_plain_loop(spark, most):
    rows, target = texts(), ["the tree", None, "", "Apple über alles " * 3]
    docs = spark.createDataFrame([(*r, 1, "w", 2, "f", 3) for r in rows], SCHEMA).repartition(3)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, wanted, buckets=50, most=most, least_words=5, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, target, 50, most, 5, 30)


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(none, target).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in resampling.resample(docs, target, buckets=50, least_words=1, percent=100).collect()) == plain([(1, "a b"), (2, "")], [], 50, 1, 1, 100)


def test_no_python_in_the_plan(spark):
    plan = resampling.op12_importance_resampling(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
