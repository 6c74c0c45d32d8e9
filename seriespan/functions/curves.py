"""Limit curves as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_limit(reference: Column, base: float, slope: float, divisor: float) -> Column:
    """``base + slope * (reference / divisor)``."""
    return F.lit(base) + F.lit(slope) * (reference / F.lit(divisor))


def interpolated(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through ``points``, clamped at both ends."""
    if len(points) < 2 or any(b[0] <= a[0] for a, b in zip(points, points[1:])):
        raise ValueError("a curve needs two or more points with increasing x")
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x > points[-1][0], F.lit(float(points[-1][1])))
