"""Draws against hashlib, on several partitionings."""

import hashlib

from pyspark.sql import functions as F

from skyledger.functions import streams


def plain(seed, names, key):
    return int.from_bytes(hashlib.blake2b("|".join(map(str, (seed, *names, key))).encode(), digest_size=8).digest(), "big")


def test_hash(spark):
    texts = ["", "a", "ümläut|😀", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", streams.stable_hash("t").alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True) for t in texts}


def test_draws_are_the_same_everywhere(spark):
    df = spark.range(500).unionByName(spark.createDataFrame([(None,)], "id long"))
    want = {i: (plain(7, ("split", "dvb"), i) >> 11) / 2**53 for i in range(500)}
    for parts in (1, 5):
        got = {r.id: r.d for r in df.repartition(parts).select("id", streams.drawn(7, ("split", "dvb"), F.col("id")).alias("d")).collect()}
        assert got == want | {None: None}
        order = [r.id for r in streams.sampled(df.repartition(parts), 40, 7, ("split", "dvb"), "id").collect()]
        assert order == sorted(want, key=lambda i: (want[i], i))[:40]
    few, many = ({r.id for r in streams.split(df, f, 7, ("split", "dvb"), "id").where("split = 'val'").collect()} for f in (0.1, 0.3))
    assert few == {i for i, d in want.items() if d < 0.1} and few < many
    other = {r.id for r in streams.split(df, 0.1, 7, ("split", "other"), "id").where("split = 'val'").collect()}
    assert other != few
