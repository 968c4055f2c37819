"""Quadrilaterals and canvases of the image tier, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(value: Column) -> Column:
    """Clamped to 0..1; NaN is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(value, F.lit(0.0))))


def canvas(width: Column, height: Column, long_side: int = 1536, step: int = 32) -> tuple[Column, Column]:
    """Detection canvas: long side scaled to ``long_side``, both sides rounded up to a multiple of ``step``."""
    scale = long_side / F.greatest(width, height)
    up = lambda v: (F.ceil(F.round(v * scale) / step) * step).cast("int")
    return up(width), up(height)


def capped(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size with the long side at most ``most``; the other side is cut to whole pixels, not rounded."""
    long = F.greatest(width, height)
    cut = lambda v: F.when(long <= most, v).when(v == long, most).otherwise(F.floor(v * most / long)).cast("int")
    return cut(width), cut(height)


def inside(x: Column, y: Column, quad: Column) -> Column:
    """Whether a point lies in a convex quad (array of four (x, y) structs, either turn)."""
    cross = lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    turns = [cross(F.get(quad, F.lit(i)), F.get(quad, F.lit((i + 1) % 4))) for i in range(4)]
    return reduce(Column.__and__, [t >= 0 for t in turns]) | reduce(Column.__and__, [t <= 0 for t in turns])
