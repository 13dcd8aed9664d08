"""A benchmark of several blocks and a reference of several shards give what one of each gives."""

from dataclasses import replace

from skyledger.llm import decontamination, substrings
from skyledger.llm.common import read

SF = "/root/testdata/sf0.001"


def test_benchmark_in_blocks(spark):
    docs, benchmark = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    docs = docs.unionByName(docs.limit(3)).selectExpr("*", "1 as leaking_text", "text as other").unionByName(spark.createDataFrame([(None, None, None, None, None, 1, None)], "doc_id long, text string, lang string, source string, n_chars long, leaking_text int, other string"))
    one, many = decontamination.TemplateParams(), replace(decontamination.TemplateParams(), block_chars=1200)
    size = sum(len(r.text) for r in benchmark.collect())
    assert size // many.block_chars + 1 >= 3
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = rows(decontamination.find_leaks(docs, benchmark, many))
    assert got and got == rows(decontamination.find_leaks(docs, benchmark, one))
    kept = decontamination.decontaminate(docs, benchmark, many)
    assert kept.columns == docs.columns and rows(kept) == rows(decontamination.decontaminate(docs, benchmark, one))
    assert kept.count() < docs.count() and kept.where("doc_id is null").count() == 1


def test_reference_in_shards(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    reference = docs.where("doc_id % 7 = 0")
    docs = docs.unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None)], docs.schema))
    words = sum(len((r.text or "").split()) for r in reference.collect())
    rows = lambda n: sorted(map(tuple, substrings.remove_reference_spans(docs, reference, shard_words=n).collect()), key=repr)
    one = rows(10**9)
    assert sum(r[3] for r in one) >= words and one == rows(words // 5)
    assert len(one) == docs.count()
