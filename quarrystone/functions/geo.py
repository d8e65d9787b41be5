"""Points and rectangles in the plane as column expressions. A rectangle is (min_x, min_y, max_x, max_y)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


class Rect(NamedTuple):
    min_x: Column
    min_y: Column
    max_x: Column
    max_y: Column

    @staticmethod
    def of(prefix: str = "") -> Rect:
        return Rect(*(F.col(prefix + c) for c in ("min_x", "min_y", "max_x", "max_y")))

    def is_valid(self) -> Column:
        return (self.min_x <= self.max_x) & (self.min_y <= self.max_y)

    def area(self) -> Column:
        return (self.max_x - self.min_x) * (self.max_y - self.min_y)

    def perimeter(self) -> Column:
        return 2 * ((self.max_x - self.min_x) + (self.max_y - self.min_y))

    def center(self) -> tuple[Column, Column]:
        return (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2

    def contains_point(self, x: Column, y: Column) -> Column:
        return x.between(self.min_x, self.max_x) & y.between(self.min_y, self.max_y)

    def contains(self, o: Rect) -> Column:
        return (o.min_x >= self.min_x) & (o.max_x <= self.max_x) & (o.min_y >= self.min_y) & (o.max_y <= self.max_y)

    def intersects(self, o: Rect) -> Column:
        return (self.min_x <= o.max_x) & (o.min_x <= self.max_x) & (self.min_y <= o.max_y) & (o.min_y <= self.max_y)

    def union(self, o: Rect) -> Rect:
        return Rect(F.least(self.min_x, o.min_x), F.least(self.min_y, o.min_y), F.greatest(self.max_x, o.max_x), F.greatest(self.max_y, o.max_y))

    def intersection(self, o: Rect) -> Rect:
        return Rect(F.greatest(self.min_x, o.min_x), F.greatest(self.min_y, o.min_y), F.least(self.max_x, o.max_x), F.least(self.max_y, o.max_y))

    def overlap_area(self, o: Rect) -> Column:
        return F.when(self.intersects(o), self.intersection(o).area()).otherwise(F.lit(0.0))

    def enlargement(self, o: Rect) -> Column:
        """Area by which this rectangle must grow to hold the other."""
        return self.union(o).area() - self.area()

    def distance(self, o: Rect) -> Column:
        """Between the nearest points; 0 if they meet."""
        dx = F.greatest(F.lit(0.0), o.min_x - self.max_x, self.min_x - o.max_x)
        dy = F.greatest(F.lit(0.0), o.min_y - self.max_y, self.min_y - o.max_y)
        return F.sqrt(dx * dx + dy * dy)
