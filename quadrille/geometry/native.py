"""Geometry predicates as plain Catalyst expressions over coordinate columns.

Points have columns x and y, boxes xmin, ymin, xmax and ymax. Everything here is pushed down, pruned and compiled like
any other expression. Contains and within leave out the boundary, intersects has it; a null operand gives null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


def _c(v: Column | str | float) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


@dataclass(frozen=True)
class Box:
    """An envelope given by columns, column names or numbers."""

    xmin: Column | str | float
    ymin: Column | str | float
    xmax: Column | str | float
    ymax: Column | str | float

    def bounds(self) -> tuple[Column, Column, Column, Column]:
        return _c(self.xmin), _c(self.ymin), _c(self.xmax), _c(self.ymax)

    def area(self) -> Column:
        x0, y0, x1, y1 = self.bounds()
        return (x1 - x0) * (y1 - y0)


@dataclass(frozen=True)
class Point:
    """A point given by columns, column names or numbers."""

    x: Column | str | float
    y: Column | str | float

    def bounds(self) -> tuple[Column, Column, Column, Column]:
        return _c(self.x), _c(self.y), _c(self.x), _c(self.y)


@dataclass(frozen=True)
class Wkb:
    """A geometry in a WKB column; its bounds come from one JTS call."""

    geom: Column | str

    def column(self) -> Column:
        return self.geom if isinstance(self.geom, Column) else F.col(self.geom)

    def bounds(self) -> tuple[Column, Column, Column, Column]:
        b = F.call_function("__jts_bounds", self.column())
        return tuple(F.get(b, F.lit(i)) for i in range(4))


Geometry = Box | Point | Wkb


def overlap(a: Geometry, b: Geometry, within: float = 0.0) -> Column:
    """Whether the envelopes meet, the first grown by ``within`` on each side."""
    ax0, ay0, ax1, ay1 = a.bounds()
    bx0, by0, bx1, by1 = b.bounds()
    return (ax0 - within <= bx1) & (bx0 <= ax1 + within) & (ay0 - within <= by1) & (by0 <= ay1 + within)


def inside(box: Geometry, p: Point) -> Column:
    """The point is in the interior of the box."""
    x0, y0, x1, y1 = box.bounds()
    x, y = _c(p.x), _c(p.y)
    return (x0 < x) & (x < x1) & (y0 < y) & (y < y1)


def distance(a: Point, b: Point) -> Column:
    return F.sqrt((_c(a.x) - _c(b.x)) * (_c(a.x) - _c(b.x)) + (_c(a.y) - _c(b.y)) * (_c(a.y) - _c(b.y)))


def exact(predicate: str, a: Geometry, b: Geometry, within: float | None = None) -> Column | None:
    """The predicate as a native expression, or None where it needs JTS."""
    point_a, point_b = isinstance(a, Point), isinstance(b, Point)
    box_a, box_b = isinstance(a, Box), isinstance(b, Box)
    if predicate == "dwithin" and point_a and point_b:
        return distance(a, b) <= within
    if predicate == "dwithin" and (box_a or point_a) and (box_b or point_b):
        (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.bounds(), b.bounds()
        dx = F.greatest(F.lit(0.0), ax0 - bx1, bx0 - ax1)
        dy = F.greatest(F.lit(0.0), ay0 - by1, by0 - ay1)
        return F.sqrt(dx * dx + dy * dy) <= within
    if predicate == "intersects" and (box_a or point_a) and (box_b or point_b):
        return overlap(a, b)
    if predicate == "contains" and box_a and point_b:
        return inside(a, b)
    if predicate == "within" and point_a and box_b:
        return inside(b, a)
    if predicate == "contains" and box_a and box_b:
        return _holds(a, b)
    if predicate == "within" and box_a and box_b:
        return _holds(b, a)
    if predicate == "equals" and type(a) is type(b) and not isinstance(a, Wkb):
        same = [p == q for p, q in zip(a.bounds(), b.bounds(), strict=True)]
        return same[0] & same[1] & same[2] & same[3]
    return None


def _holds(outer: Box, inner: Box) -> Column:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = outer.bounds(), inner.bounds()
    return (ax0 <= bx0) & (bx1 <= ax1) & (ay0 <= by0) & (by1 <= ay1)


def as_wkb(g: Geometry) -> Column:
    """The geometry as WKB, for operations that only JTS has."""
    if isinstance(g, Wkb):
        return g.column()
    if isinstance(g, Point):
        return F.call_function("__jts_point", _c(g.x), _c(g.y))
    return F.call_function("__jts_envelope", *g.bounds())
