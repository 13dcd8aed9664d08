"""Quotas equal plain Sainte-Lague, whatever the sizes of the sources; no product of words and blocks overflows."""

import heapq
import random

import pytest

from skyledger.llm import mixing


def plain(rows, most=2):
    """Seat by seat to the highest quotient, ties to the first source, null last."""
    quota = {r.source: 0 for r in rows}
    for block in {r.block for r in rows}:
        some = [r for r in rows if r.block == block]
        seats = min(int(sum(r.target for r in some) / block + 0.5), sum(most * r.blocks for r in some))
        order = {r.source: i for i, r in enumerate(sorted(some, key=lambda r: (r.source is None, r.source or "")))}
        heap = [(-r.target, order[r.source], 0, r.source, r.target, most * r.blocks) for r in some if r.blocks]
        heapq.heapify(heap)
        for _ in range(seats):
            _, i, k, source, target, cap = heapq.heappop(heap)
            quota[source] += 1
            if k + 1 < cap:
                heapq.heappush(heap, (-target / (2 * k + 3), i, k + 1, source, target, cap))
    return quota


@pytest.mark.parametrize("sizes", [[5000], [1, 1, 1], [0, 0], [300, 300, 300, 300], [90_000, 90_000, 250, 40, 3, 0], "random"])
def test_quotas(spark, sizes):
    r = random.Random(4)
    if sizes == "random":
        sizes = [int(10 ** r.uniform(0, 6)) for _ in range(40)]
    rows = [(f"s{i}" if i else None, n) for i, n in enumerate(sizes)]
    targets = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long"))
    got = mixing.block_quotas(targets).collect()
    assert {x.source: x.quota for x in got} == plain(got)
    for x in got:
        assert sum(x.shard_quotas) == x.quota and max(x.shard_quotas) - min(x.shard_quotas) <= 1
        assert x.blocks >= min(x.source_size, 100) and x.blocks <= max(400, x.source_size / 1024 + 1)


def test_large_sources(spark):
    """A source of 10**13 words, by documents at its two ends."""
    size = 10**13
    targets = mixing.source_targets(spark.createDataFrame([("a", size), ("b", 10**12)], "source string, source_size long"))
    q = {x.source: x for x in mixing.block_quotas(targets).collect()}
    assert abs(q["a"].quota * 1024 - q["a"].target) < 2048
    rows = [(0, 5000), (size - 5000, 5000), (7 * 10**12, 10**6)]
    blocks = q["a"].blocks
    df = spark.createDataFrame([(b, n, size, blocks, q["a"].quota, 2_147_483_647 % blocks, 12345) for b, n in rows], "begin long, size long, source_size long, blocks long, quota long, a long, b long")
    for (begin, n), row in zip(rows, df.selectExpr(f"{mixing.picked_words(8, 2.0)} as p").collect(), strict=True):
        long, short = size % blocks, size // blocks
        want = 0
        start = lambda i: i * short + min(i, long)  # noqa: B023, E731
        at = begin // (short + 1) if begin < long * (short + 1) else long + (begin - long * (short + 1)) // short
        for i in range(max(0, at - 2), at + n // short + 3):
            words = min(begin + n, start(i + 1)) - max(begin, start(i))
            seat = (i * (2_147_483_647 % blocks) + 12345) % blocks
            want += max(0, words) * sum(seat + c * blocks < q["a"].quota for c in range(2)) if i < blocks else 0
        assert sum(x.words for x in row.p) == want


def test_each_source_comes_near_its_target(spark):
    r = random.Random(8)
    rows = [(i if i % 7 else None, " ".join("w" for _ in range(r.choice([1, 5, 40, 900]))), ["a", "b", None][min(2, i % 11)]) for i in range(900)] + [(10_000 + i, "x y", "tiny") for i in range(3)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for x in out:
        got = by.setdefault((x.source_size, x.target), [0])
        got[0] += x.taken
        assert 0 <= x.taken <= 2 * x.size
    assert len(out) == len(rows) and len(by) == 4
    for (size, target), (taken,) in by.items():
        assert abs(taken - target) <= 0.02 * target + 2, (size, target, taken)
