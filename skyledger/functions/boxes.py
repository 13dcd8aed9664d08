"""Box arithmetic on columns (x1, y1, w, h), all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-open bounds of the size histogram, in pixels.
SIZE_BINS = (0, 8, 16, 32, 64, 128, 256)


def intersection(a: str, b: str) -> Column:
    """Area that two boxes share; a and b are prefixes of their columns."""
    c = lambda p, k: F.col(f"{p}{k}")
    w = F.least(c(a, "x1") + c(a, "w"), c(b, "x1") + c(b, "w")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y1") + c(a, "h"), c(b, "y1") + c(b, "h")) - F.greatest(c(a, "y1"), c(b, "y1"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 for two boxes without area."""
    both = intersection(a, b)
    union = F.col(f"{a}w") * F.col(f"{a}h") + F.col(f"{b}w") * F.col(f"{b}h") - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def size_bin(w: Column, h: Column) -> Column:
    """Lower bound of the bin of sqrt(w * h), found on the exact area."""
    out = F.lit(SIZE_BINS[0])
    for low in SIZE_BINS[1:]:
        out = F.when(w * h >= low * low, F.lit(low)).otherwise(out)
    return out


def giou(a: str, b: str) -> Column:
    """Overlap less the empty share of the enclosing box."""
    c = lambda p, k: F.col(f"{p}{k}")
    w = F.greatest(c(a, "x1") + c(a, "w"), c(b, "x1") + c(b, "w")) - F.least(c(a, "x1"), c(b, "x1"))
    h = F.greatest(c(a, "y1") + c(a, "h"), c(b, "y1") + c(b, "h")) - F.least(c(a, "y1"), c(b, "y1"))
    union = c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - intersection(a, b)
    return iou(a, b) - F.when(w * h > 0, (w * h - union) / (w * h)).otherwise(F.lit(0.0))


def scale_of(w: Column, h: Column, width: int, height: int) -> Column:
    """Side of a box relative to the image's."""
    return F.sqrt((w * h).cast("double")) / F.sqrt(F.lit(float(width * height)))


def scale_band(scale: Column) -> Column:
    return F.when(scale < 0.33, "small").when(scale < 0.66, "medium").otherwise("large")


#: Side in pixels from which an overlap threshold holds.
OVERLAP_BY_SIDE = ((64, 0.30), (32, 0.25), (16, 0.20), (0, 0.15))


def overlap_needed(side: Column) -> Column:
    out = F.lit(OVERLAP_BY_SIDE[-1][1])
    for least, t in reversed(OVERLAP_BY_SIDE[:-1]):
        out = F.when(side >= least, t).otherwise(out)
    return out
