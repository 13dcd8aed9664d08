"""Sizes as people read them, as printf writes them: of two decimals as near the even one."""

from pyspark.sql import functions as F

from skyledger.operators.curation import human_bytes

SIZES = [0, 7, 1023, 1024, 1280, 1281, 1279, 1792, 1024 * 1023 + 1023, 1024 * 9 + 256, 2**20, 2**20 + 2**18, 2**20 + 3 * 2**18, 2**20 + 2**18 + 1, 2**30 - 1, 5 * 2**30 + 2**28, 2**40 + 2**38, 123_456_789_012_345, 2**52 + 12345]


def test_as_printf(spark):
    def want(n):
        i = next((i for i in range(4) if n < 1024 ** (i + 1)), 4)
        return f"{n / 1024.0**i:.1f} {('B', 'KB', 'MB', 'GB', 'TB')[i]}"

    df = spark.createDataFrame([(n,) for n in SIZES] + [(None,)], "n long")
    got = {r.n: r.shown for r in df.select("n", human_bytes(F.col("n")).alias("shown")).collect()}
    assert got.pop(None) is None
    assert got == {n: want(n) for n in SIZES}
