"""The mix stage writes each source's target of words, also where every document is long beside a block."""

import random

from pyspark.sql import functions as F

from skyledger.llm import mixing, stages
from skyledger.llm.common import word_count


def test_written_words_follow_targets(spark):
    r = random.Random(4)
    rows, i = [], 0
    for source, n, low, high in (("a", 60, 300, 900), ("b", 80, 20, 1500), ("c", 90, 200, 800), ("d", 40, 20, 60), (None, 150, 100, 2000)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * r.randint(low, high)), source))
            i += 1
    rows += [(None, "w " * 400, "a"), (i, None, "b"), (i + 1, "w " * 300, "c"), (i + 1, "w " * 200, "c"), (i + 1, "w " * 100, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    sizes = docs.groupBy("source").agg(F.sum(word_count()).alias("source_size"))
    targets = {x.source: x.target for x in mixing.source_targets(sizes).collect()}
    out = stages.mix(spark, docs, "").cache()
    assert out.columns == docs.columns
    written = {x.source: x.n for x in out.groupBy("source").agg(F.sum(word_count()).alias("n")).collect()}
    off = {s: written.get(s, 0) / t - 1 for s, t in targets.items()}
    assert max(abs(x) for x in off.values()) < 0.02, off
    assert out.where("doc_id is null").count() == 1 and out.where("text is null").count() == 1
    assert out.groupBy("doc_id", "source", "text").count().agg(F.max("count")).first()[0] <= 2
