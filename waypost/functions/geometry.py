"""Point in polygon with built-in expressions; points on an edge are inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(geometry: str) -> Column:
    """All edges of all rings of a MultiPolygon column, as structs ax, ay, bx, by."""
    rings = F.flatten(geometry)

    def of_ring(ring: Column) -> Column:
        starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
        return F.transform(
            starts,
            lambda a, i: F.struct(
                a[0].alias("ax"), a[1].alias("ay"), F.get(ring, i + 1)[0].alias("bx"), F.get(ring, i + 1)[1].alias("by")
            ),
        )

    return F.flatten(F.transform(rings, of_ring))


def bounds(edge_list: Column) -> Column:
    """Bounding box of edges as a struct; rings are closed, so first ends suffice."""
    x, y = F.transform(edge_list, lambda e: e["ax"]), F.transform(edge_list, lambda e: e["ay"])
    return F.struct(
        F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")
    )


def in_bounds(box: Column, px: Column, py: Column) -> Column:
    return px.between(box["x0"], box["x1"]) & py.between(box["y0"], box["y1"])


#: Relative error of the orientation test in doubles, (3 + 16 u) u for a unit u of 2^-53, and what splits a double in halves.
_ERROR, _SPLITTER = 3.3306690738754716e-16, 134217729.0


def _halves(a: Column) -> tuple[Column, Column]:
    high = a * _SPLITTER - (a * _SPLITTER - a)
    return high, a - high


def _product(a: Column, b: Column) -> list[Column]:
    """a * b as two doubles whose sum is exact, the rounding error first."""
    p, (ah, al), (bh, bl) = a * b, _halves(a), _halves(b)
    return [al * bl - (((p - ah * bh) - al * bh) - ah * bl), p]


def _with(expansion: Column, term: Column) -> Column:
    """An expansion, doubles of growing size that share no bits, with one more term."""

    def add(state: Column, x: Column) -> Column:
        total = state["q"] + x
        part = total - state["q"]
        error = (state["q"] - (total - part)) + (x - part)
        return F.struct(total.alias("q"), F.concat(state["h"], F.array(error)).alias("h"))

    start = F.struct(term.alias("q"), F.array().cast("array<double>").alias("h"))
    return F.aggregate(expansion, start, add, lambda s: F.concat(s["h"], F.array(s["q"])))


def orientation(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """A number with the exact sign of (b - a) x (p - a): positive if p is to the left of the way from a to b.

    Doubles decide wherever their rounding cannot change the sign; what is left,
    points on a line or within its rounding, is summed without any.
    """
    one, other = (bx - ax) * (py - ay), (px - ax) * (by - ay)
    det = one - other
    products = [(bx, py), (-bx, ay), (-ax, py), (-px, by), (px, ay), (ax, by)]
    terms = F.array(*(t for a, b in products for t in _product(a, b)))
    exact = F.aggregate(terms, F.array().cast("array<double>"), _with, lambda e: F.aggregate(e, F.lit(0.0), lambda last, x: F.when(x != 0, x).otherwise(last)))
    near = F.abs(det) <= (F.abs(one) + F.abs(other)) * _ERROR
    return F.when(near & ((one != 0) | (other != 0)), exact).otherwise(det)


def contains(edge_list: Column, px: Column, py: Column) -> Column:
    """Whether a point is on an edge or has an odd number of edges to its right."""

    def side(e: Column) -> Column:
        return orientation(e["ax"], e["ay"], e["bx"], e["by"], px, py)

    def touches(e: Column) -> Column:
        along = px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        return along & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])) & (side(e) == 0)

    def crosses(e: Column) -> Column:
        return ((e["ay"] > py) != (e["by"] > py)) & ((side(e) > 0) == (e["by"] > e["ay"]))

    odd = F.aggregate(edge_list, F.lit(False), lambda inside, e: inside != crosses(e))
    return F.exists(edge_list, touches) | odd
