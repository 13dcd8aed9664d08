"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), works on all of docs and returns rows with docs' columns.

All of them take null and empty texts, repeated rows, null ids and further columns of any name, which pass
through unchanged; an empty table stays empty. What each does with them stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import decontamination, minhash, mixing, sharding, toxicity
from skyledger.llm.common import fresh, read, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7. Null and empty texts have the score of a text without known words; repeated rows all stay or all go."""
    return toxicity.drop_toxic(docs, toxicity.train_on(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near-duplicates; of repeated rows of it, one. Rows without doc_id stay. Empty and null texts equal each other, so one of them stays."""
    found = minhash.near_duplicates(docs)
    kept, rows = fresh(docs, "kept_id"), fresh(docs, "kept_rows")
    ids = settle(found.where("doc_id = class_id").groupBy(F.col("doc_id").alias(kept)).agg(F.count(F.lit(1)).alias(rows)))
    same = F.col("doc_id") == F.col(kept)
    one = docs.join(ids.where(F.col(rows) == 1).hint("shuffle_hash"), same, "left_semi")
    many = ids.where(F.col(rows) > 1)
    if many.limit(1).count():
        one = one.unionByName(docs.join(many, same, "left_semi").dropDuplicates(["doc_id"]))
    if found.where("doc_id is null").limit(1).count():
        one = one.unionByName(docs.where("doc_id is null"))
    return one


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark question, also a re-parameterised one. Null and empty texts hold none; repeated rows all stay or all go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as whole copies follow its source's quota of words: not at all, once or twice. Documents without words, and rows without doc_id, stay once; repeated rows of an id and source are each written as often."""
    id_, source, copies, copy = (fresh(docs, n) for n in ("mixed_id", "mixed_source", "mixed_copies", "mixed_copy"))
    taken = settle(mixing.whole_copies(docs).where("doc_id is not null").select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("copies").alias(copies)))
    same = (F.col("doc_id") == F.col(id_)) & F.col("source").eqNullSafe(F.col(source))
    known = docs.join(taken.where(F.col(copies) > 0).hint("shuffle_hash"), same)
    out = known.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
    return out.unionByName(docs.where("doc_id is null"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, as op1 returns them: null texts are empty ones, repeated rows each have a slot."""
    return sharding.shard_documents(docs)
