"""Toxicity on the rows whose labels the model never sees: ranking, threshold and contract."""

import zlib

import numpy as np

from skyledger.llm import toxicity
from skyledger.llm.common import read

SF = "/root/testdata/sf0.1"


def area(scores, labels):
    """Share of pairs of a toxic and another row that the score puts in order, ties by half."""
    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(labels)[order]
    ranks = np.empty(len(s))
    for value in np.unique(s):
        at = s == value
        ranks[at] = np.flatnonzero(at).mean() + 1
    toxic = y.sum()
    return (ranks[y == 1].sum() - toxic * (toxic + 1) / 2) / (toxic * (len(y) - toxic))


def test_held_out_rows(spark):
    rows = toxicity.op4_noisy_or_toxicity(spark, SF).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == read(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    label = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    held = [(r.score, label[r.doc_id], r.predicted) for r in rows if r.held_out and label.get(r.doc_id) is not None]
    scores, labels, predicted = (np.array(c) for c in zip(*held))
    toxic, clean = labels == 1, labels == 0
    print("area", area(scores, labels), "caught", predicted[toxic].sum(), "of", toxic.sum(), "wrong", predicted[clean].sum(), "of", clean.sum())
    assert area(scores, labels) >= 0.93 and predicted[toxic].mean() >= 0.8 and predicted[clean].mean() <= 0.02
