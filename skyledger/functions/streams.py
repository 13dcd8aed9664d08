"""Named random streams: what is drawn for a row depends on the seed, the stream's name and the row's key alone, so it is the same on any partitioning and in any process, and a new stream disturbs no other."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType


@pandas_udf(LongType())
def stable_hash(text: pd.Series) -> pd.Series:
    """64 bits of BLAKE2b of a text in UTF-8, as a signed number; null for null. Spark has no such function of its own."""
    one = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True)
    return pd.Series([None if t is None else one(t) for t in text], dtype="Int64")


def stream_key(seed: int, names: tuple, key: Column) -> Column:
    """The text that is hashed: seed, names and key, joined by bars. A null key has no draw."""
    return F.concat(F.lit("|".join(map(str, (seed, *names))) + "|"), key.cast("string"))


def drawn(seed: int, names: tuple, key: Column) -> Column:
    """A number in [0, 1) of 53 bits for a row's key in a stream."""
    return F.shiftrightunsigned(stable_hash(stream_key(seed, names, key)), 11) / F.lit(float(1 << 53))


def sampled(df: DataFrame, n: int, seed: int, names: tuple, key: str) -> DataFrame:
    """n rows of df by the least draws, ties by key, in that order: a bounded top of each task. Rows without key are not drawn; rows of one key come together."""
    return df.where(F.col(key).isNotNull()).withColumn("_drawn", drawn(seed, names, F.col(key))).orderBy("_drawn", key).limit(n).drop("_drawn")


def split(df: DataFrame, fraction: float, seed: int, names: tuple, key: str) -> DataFrame:
    """df with split: val for keys whose draw is below the fraction, else train, also for rows without key. A key's rows stay together, and a larger fraction only adds keys to val."""
    return df.withColumn("split", F.when(drawn(seed, names, F.col(key)) < fraction, "val").otherwise("train"))
