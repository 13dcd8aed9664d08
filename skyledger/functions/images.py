"""Image functions over decoded pixels (Spark's image source gives BGR bytes), as pandas UDFs in NumPy: perceptual hash, sharpness, colours, crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of BGR pixels; one channel as it is."""
    return image[..., 0].astype(float) if image.shape[2] == 1 else image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def shares(source: int, target: int) -> np.ndarray:
    """(target, source) weights of source pixels in each target pixel by the length they share."""
    edge = np.arange(target + 1) * source / target
    low, high = np.arange(source), np.arange(source) + 1
    both = np.clip(np.minimum(edge[1:, None], high) - np.maximum(edge[:-1, None], low), 0, None)
    return both / both.sum(axis=1, keepdims=True)


def cosine_transform(n: int) -> np.ndarray:
    """Orthonormal type-2 cosine transform as a matrix."""
    k = np.arange(n)[:, None]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n) + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def perceptual_hash(luma: np.ndarray, size: int = 8, factor: int = 4) -> str:
    """Hex of the low frequencies above their median (that of all rows but the first) of an image shrunk by area."""
    side = size * factor
    small = shares(luma.shape[0], side) @ luma @ shares(luma.shape[1], side).T
    m = cosine_transform(side)
    low = (m @ small @ m.T)[:size, :size]
    bits = (low > np.median(low[1:])).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{size * size // 4}x}"


def sharpness(luma: np.ndarray) -> float:
    """Variance of the Laplacian, the border mirrored without its edge."""
    p = np.pad(luma, 1, mode="reflect") if min(luma.shape) > 1 else np.pad(luma, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * luma).var())


def colours(image: np.ndarray, bins: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Histogram of hue and saturation of unit length, then brightness, contrast, aspect and sharpness, the whole of unit length."""
    if not image.size:
        return np.zeros(bins[0] * bins[1] + 4)
    b, g, r = (image[..., i].astype(float) for i in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = np.maximum(top - low, 1e-12)
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 30 % 180
    hue = np.where(top > low, hue, 0)
    saturation = np.where(top > 0, 255 * (top - low) / np.maximum(top, 1e-12), 0)
    grid, *_ = np.histogram2d(hue.ravel(), saturation.ravel(), bins=bins, range=((0, 180), (0, 256)))
    grid = grid.ravel() / max(float(np.linalg.norm(grid)), 1e-12)
    luma = grey(image)
    out = np.concatenate([grid, [luma.mean() / 255, luma.std() / 255, image.shape[1] / max(image.shape[0], 1), sharpness(luma) / 1000]])
    size = float(np.linalg.norm(out))
    return out / size if size >= 1e-8 else out


def context_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, context: float = 0.25) -> Column:
    """The rectangle to cut round a box: wider by a share of its sides, within the image, one pixel at least."""
    w, h = (x2 - x1) * context, (y2 - y1) * context
    left, top = F.greatest(F.lit(0), F.floor(x1 - w)), F.greatest(F.lit(0), F.floor(y1 - h))
    right, bottom = F.least(width, F.ceil(x2 + w)), F.least(height, F.ceil(y2 + h))
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(right, left + 1).alias("right"), F.greatest(bottom, top + 1).alias("bottom"))


def _each(f):
    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else f(pixels(d, h, w, c)) for d, h, w, c in zip(data, height, width, channels, strict=True)])

    return run


phash = pandas_udf(_each(lambda p: perceptual_hash(grey(p))), T.StringType())
focus_score = pandas_udf(_each(lambda p: sharpness(grey(p))), T.DoubleType())
colour_descriptor = pandas_udf(_each(lambda p: [float(x) for x in colours(p)]), T.ArrayType(T.DoubleType()))


def image_features(spark: SparkSession, root: str) -> DataFrame:
    """Size, perceptual hash, sharpness and colours of the images below a folder; what can't be decoded is left out."""
    i = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root).select("image.*")
    args = ("data", "height", "width", "nChannels")
    return i.select(F.col("origin").alias("path"), "width", "height", phash(*args).alias("phash"), focus_score(*args).alias("focus"), colour_descriptor(*args).alias("colours"))
