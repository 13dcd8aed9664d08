"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, mix, shards; each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import stages
from skyledger.llm.common import discard, shared_dir

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("benchmark_leaks", stages.drop_benchmark_leaks),
    ("mix", stages.mix),
    ("shards", stages.shard),
]

#: The trained model, the sampling and the seeded choices can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. The results between stages are written to the shared folder, so a lost executor repeats no earlier stage; each goes once the next one is there, but for the last, which the result reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}-{name}")
            docs = spark.read.parquet(f"{base}/{i}-{name}")
            if i:
                discard(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
