"""Clusters against plain loops; image functions on images whose outcome is known."""

import random
import zlib
import struct

import numpy as np
import pytest

from skyledger.functions import images
from skyledger.operators import clusters

SF = "/root/testdata/sf0.001"


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(5, 5)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in clusters.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in links if a != b for x in (a, b)}
    assert clusters.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_fit_keeps_the_order(spark):
    r = random.Random(2)
    base = [r.getrandbits(63) - (1 << 62) for _ in range(4)]
    rows = []
    for i in range(120):
        h = base[i % 4]
        for _ in range(r.randint(0, 3)):
            h ^= 1 << r.randrange(62)
        rows.append((i, h))
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
    links = [(i, j) for i, a in rows for j, b in rows if i < j and near(a, b)]
    want, found = {}, []
    for i, h in rows:
        c = next((c for c in found if any(near(h, k) for k in c[1])), None)
        if c is None:
            c = (i, [])
            found.append(c)
        c[1].append(h)
        want[i] = c[0]
    got = clusters.first_fit(spark.createDataFrame(rows, "id long, hash long"), spark.createDataFrame(links, "a long, b long"))
    assert {x.id: x.cluster for x in got.collect()} == want and 4 < len(found) < 120


def test_report(spark):
    r = clusters.duplicate_report(spark, SF).first()
    assert r.clusters > 0 and r.surplus >= r.clusters and r.share == pytest.approx(r.surplus / r.images, abs=1e-8)


def png(rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(3)
    smooth = np.clip(np.add.outer(np.arange(96) * 2, np.arange(128))[..., None] * np.ones(3), 0, 255).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + rng.integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, smooth.shape).astype(np.uint8)
    for name, image in (("a", smooth), ("b", noisy), ("c", other)):
        (tmp_path / f"{name}.png").write_bytes(png(image))
    (tmp_path / "d.png").write_bytes(b"no image")
    got = {r.path[-5]: r for r in images.image_features(spark, str(tmp_path)).collect()}
    assert set(got) == set("abc") and (got["a"].width, got["a"].height) == (128, 96)
    bits = lambda x, y: bin(int(got[x].phash, 16) ^ int(got[y].phash, 16)).count("1")
    assert len(got["a"].phash) == 16 and bits("a", "b") < 12 < bits("a", "c")
    assert got["a"].focus < got["b"].focus < got["c"].focus
    assert len(got["a"].colours) == 68 and np.linalg.norm(got["c"].colours) == pytest.approx(1)


def test_image_helpers(spark):
    m = images.cosine_transform(16)
    assert np.allclose(m @ m.T, np.eye(16)) and np.allclose(images.shares(7, 3).sum(axis=1), 1)
    red = np.zeros((4, 4, 3), np.uint8)
    red[..., 2] = 255
    assert images.colours(red)[:64].argmax() == 7 and images.sharpness(np.full((5, 5), 9.0)) == 0
    assert not images.colours(np.zeros((0, 0, 3), np.uint8)).any()
    row = spark.createDataFrame([(10.0, 10.0, 20.0, 30.0), (0.0, 0.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    from pyspark.sql import functions as F

    got = [tuple(r.c) for r in row.select(images.context_crop(*map(F.col, ("x1", "y1", "x2", "y2")), F.lit(22), F.lit(32)).alias("c")).collect()]
    assert got == [(7, 5, 22, 32), (0, 0, 1, 1)]
