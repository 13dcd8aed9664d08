"""The corpus pipeline over the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        assert 0.5 * kept.count() < out.count() <= kept.count()
        kept = out.cache()
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, SF)
    assert mixed.columns == docs.columns
    shards = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert shards.count() == mixed.count()


def test_run_leaves_the_last_stage_alone(spark):
    """Every stage's folder but the one that the result reads is gone; the result can be read."""
    import glob
    import os

    from skyledger.llm.common import shared_dir

    base = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{base}/corpus-*"))
    assert corpus_pipeline.run(spark, SF).count() > 0
    (own,) = set(glob.glob(f"{base}/corpus-*")) - before
    assert os.listdir(own) == ["3-mix"]
