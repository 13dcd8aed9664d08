"""The sighting store against a plain search through all sightings, and over a stream that ends in silence."""

import random
import time

from skyledger.operators import sightings
from skyledger.streaming.edge import drain

SCHEMA = "global_id long, frame long, event_id long, camera_id long"


def plain(rows, window=75, least=2):
    out = []
    for g, f, e, _ in rows:
        n = len({c for i, t, _, c in rows if i == g and c is not None and f - window <= t <= f})
        out.append((g, f, e, n, "pass" if n >= least else "fail"))
    return sorted(out, key=repr)


def rows_of(n=300):
    r = random.Random(6)
    return [(r.choice([1, 2, 3, None]), r.choice([r.randrange(60), r.randrange(60), 200 + r.randrange(40)]), e, r.choice([1, 2, 3, None])) for e in range(n)]


def test_plain_search(spark):
    rows = rows_of()
    assert sorted(map(tuple, sightings.corroborate(spark.createDataFrame(rows, SCHEMA).repartition(5), 10).collect()), key=repr) == plain(rows, 10)
    assert sightings.corroborate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream(spark, tmp_path):
    """Shuffled within the lateness, over several files; what the watermark has passed equals the batch, and identities that fall silent keep nothing."""
    rows = sorted(rows_of(), key=lambda r: r[1])
    parts = [rows[:100], rows[90:100] + rows[100:200], rows[200:]]
    parts[1] = parts[1][10:]
    for p in parts:
        random.Random(1).shuffle(p)
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(sightings.corroborate_stream(stream, 10, lateness=60), "append").collect()
    top = max(r[1] for r in rows) - 60
    assert sorted(map(tuple, got), key=repr) == [r for r in plain(rows, 10) if r[1] <= top]
    s = sightings.SightingStore(10)
    s.step(3, {"event_id": [1], "camera_id": [4]})
    assert s.due() == 14 and s.wake(13) == [] and s.state() == {"last": [[4, 3]]} and s.wake(14) == [] and s.state() is None and s.due() is None
