"""Planar geometry as column expressions over small constant shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]


def inside(x: Column, y: Column, polygon: Sequence[Point]) -> Column:
    """Whether a point lies in a polygon, by the parity of edges that a ray to the right crosses. Fewer than three corners hold nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if ay != by:
            spans = (F.lit(float(ay)) > y) != (F.lit(float(by)) > y)
            at = (y - F.lit(float(ay))) * F.lit(float(bx - ax)) / F.lit(float(by - ay)) + F.lit(float(ax))
            crossed = crossed + F.when(spans & (x < at), 1).otherwise(0)
    return crossed % 2 == 1


def shoelace(corners: str) -> Column:
    """Area of an array of structs (x, y)."""
    n = f"size({corners})"
    term = f"{corners}[i].x * {corners}[(i + 1) % {n}].y - {corners}[(i + 1) % {n}].x * {corners}[i].y"
    return F.expr(f"if({n} < 3, 0D, abs(aggregate(sequence(0, {n} - 1), 0D, (s, i) -> s + {term})) / 2)")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def project(x: Column, y: Column, h: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """A point under a 3 x 3 homography; (0, 0) where it falls on the horizon."""
    row = [F.lit(float(a)) * x + F.lit(float(b)) * y + F.lit(float(c)) for a, b, c in h]
    return tuple(F.when(row[2] != 0, row[k] / row[2]).otherwise(0.0) for k in (0, 1))
