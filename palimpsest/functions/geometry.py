"""Boxes as four columns. All in doubles; a box is (x0, y0, x1, y1), y grows downwards."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, source: str | Column | None = None) -> Box:
        """The four columns of a frame (None), with a prefix (string), or fields of a struct."""
        if isinstance(source, Column):
            return cls(*(source[c] for c in cls._fields))
        return cls(*(F.col(f"{source or ''}{c}") for c in cls._fields))

    @property
    def width(self) -> Column:
        return F.greatest(self.x1 - self.x0, F.lit(0.0))

    @property
    def height(self) -> Column:
        return F.greatest(self.y1 - self.y0, F.lit(0.0))

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) * F.lit(0.5)

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) * F.lit(0.5)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    return w * h


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    u = a.area + b.area - i
    return F.when(u <= 0, F.lit(0.0)).otherwise(F.try_divide(i, u))


def center_distance(a: Box, b: Box) -> Column:
    dx, dy = a.center_x - b.center_x, a.center_y - b.center_y
    return F.sqrt(dx * dx + dy * dy)


def covered_share(inner: Box, outer: Box) -> Column:
    """Share of inner's area (at least 1) that outer covers."""
    return intersection(inner, outer) / F.greatest((inner.x1 - inner.x0) * (inner.y1 - inner.y0), F.lit(1.0))
