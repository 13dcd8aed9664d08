"""Leaders against the loop over images in order, on chains, copies and random hashes."""

import random

from skyledger.operators import leaders


def plain(rows, most=4):
    found, out = [], {}
    for i, h in sorted(rows):
        led = None if h is None else next((k for k, g in found if ((g ^ h) & (1 << 64) - 1).bit_count() <= most), None)
        if led is None and h is not None:
            found.append((i, h))
        out[i] = i if led is None else led
    return out


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def test_loop(spark):
    r = random.Random(21)
    base = [r.getrandbits(64) for _ in range(25)]
    rows = []
    for i in range(400):
        h = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 3, 5])):
            h ^= 1 << r.randrange(64)
        rows.append((i, signed(h)))
    chain = r.getrandbits(64)
    for i in range(1000, 1030):  # each three bits from the one before
        chain ^= sum(1 << b for b in r.sample(range(64), 3))
        rows.append((i, signed(chain)))
    rows += [(2000, None), (2001, None)]
    for i, (k, h) in enumerate(rows[:20]):
        rows.append((3000 + i, h))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, hash long")
    for most in (4, 2, 0):
        assert {x.id: x.leader for x in leaders.lead(df, most).collect()} == plain(rows, most)
    assert leaders.lead(df.limit(0)).count() == 0
