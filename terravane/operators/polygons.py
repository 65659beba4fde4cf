"""Polygons as column expressions and cell joins.

A polygon is ``rings``: array<array<struct<x, y>>>, the border first, then holes; rings need no closing point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x: double, y: double>>>"
#: Ellipsoid (metres, squared eccentricity) and parallels of the equal-area projection of the 48 states, EPSG:5070.
GRS80 = (6378137.0, 0.00669438002290)
CONUS = {"south": 29.5, "north": 45.5, "lat0": 23.0, "lon0": -96.0}


def albers(lon: Column, lat: Column, ellipsoid=GRS80, south: float = 29.5, north: float = 45.5, lat0: float = 23.0, lon0: float = -96.0) -> tuple[Column, Column]:
    """Metres (x, y) of degrees in the Albers equal-area conic projection of an ellipsoid."""
    a, e2 = ellipsoid
    e = math.sqrt(e2)

    def q(s, log):
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    def at(degrees):
        s = math.sin(math.radians(degrees))
        return (1 - s * s) / (1 - e2 * s * s), q(s, math.log)

    (m1, q1), (m2, q2), (_, q0) = at(south), at(north), at(lat0)
    n = (m1 - m2) / (q2 - q1)
    c = m1 + n * q1
    rho = a * F.sqrt(c - n * q(F.sin(F.radians(lat)), F.log)) / n
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), a * math.sqrt(c - n * q0) / n - rho * F.cos(theta)


def _sides(ring: Column) -> Column:
    """Structs (a, b): each point and the next, the first after the last."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside, by the parity of sides to its right; of the border, left and lower sides are in."""

    def crosses(s):
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(_sides(ring), crosses)) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside the border and in none of the holes (X20). No rings: false."""
    holes = F.filter(rings, lambda r, i: i > 0)
    return F.coalesce(in_ring(x, y, F.get(rings, F.lit(0))), F.lit(False)) & ~F.exists(holes, lambda r: in_ring(x, y, r))


def spherical_area(rings: Column) -> Column:
    """Steradians between great-circle sides (X20): the border's area less the holes', whatever way they run.

    Sides add the signed excess between them and the equator, so a polygon mustn't hold a pole inside.
    """

    def excess(s):
        t1, t2 = (F.tan(F.radians(s[k]["y"]) / 2) for k in "ab")
        return 2 * F.atan2(F.tan(F.radians(s["b"]["x"] - s["a"]["x"]) / 2) * (t1 + t2), 1 + t1 * t2)

    areas = F.transform(rings, lambda r: F.abs(F.aggregate(_sides(r), F.lit(0.0), lambda out, s: out + excess(s))))
    return F.aggregate(F.transform(areas, lambda v, i: F.when(i == 0, v).otherwise(-v)), F.lit(0.0), lambda out, v: out + v)


def border_distance(x: Column, y: Column, rings: Column) -> Column:
    """Distance on the plane to the nearest side."""

    def to_side(s):
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return F.array_min(F.flatten(F.transform(rings, lambda r: F.transform(_sides(r), to_side))))


def line_inside(x1: Column, y1: Column, x2: Column, y2: Column, rings: Column) -> Column:
    """Whether a straight link lies in a polygon (J11): ends and middle are in it and no side crosses it; touching is allowed."""

    def turn(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def crosses(s):
        a, b = s["a"], s["b"]
        one = turn(x1, y1, x2, y2, a["x"], a["y"]) * turn(x1, y1, x2, y2, b["x"], b["y"])
        two = turn(a["x"], a["y"], b["x"], b["y"], x1, y1) * turn(a["x"], a["y"], b["x"], b["y"], x2, y2)
        return (one < 0) & (two < 0)

    inside = in_polygon(x1, y1, rings) & in_polygon(x2, y2, rings) & in_polygon((x1 + x2) / 2, (y1 + y2) / 2, rings)
    return inside & ~F.exists(rings, lambda r: F.exists(_sides(r), crosses))


def _cells(polygons: DataFrame, polygon_id: str, cell: float, more: float = 0.0) -> DataFrame:
    """(polygon_id, box, cell) for each grid cell that a polygon's box, ``more`` wider on each side, meets; without its rings."""
    border = F.get("rings", F.lit(0))
    ends = {k: (F.array_min(v) - more, F.array_max(v) + more) for k, v in (("x", F.transform(border, lambda p: p["x"])), ("y", F.transform(border, lambda p: p["y"])))}
    out = polygons.where(F.size(border) > 0).select(polygon_id, *(e.alias(f"__{k}{n}") for k, v in ends.items() for n, e in zip((1, 2), v)))
    for k in ("x", "y"):
        out = out.withColumn(f"__{k}", F.explode(F.sequence(F.floor(F.col(f"__{k}1") / cell), F.floor(F.col(f"__{k}2") / cell))))
    return out


def _met(own: DataFrame, polygons: DataFrame, polygon_id: str, cell: float, more: float = 0.0) -> DataFrame:
    """Points with the polygons, rings included, whose box they lie in: cells and boxes first, rings for what is left."""
    near = own.join(_cells(polygons, polygon_id, cell, more), ["__x", "__y"])
    near = near.where(F.col("x").between(F.col("__x1"), F.col("__x2")) & F.col("y").between(F.col("__y1"), F.col("__y2")))
    return near.drop("__x", "__y", "__x1", "__x2", "__y1", "__y2").join(polygons, polygon_id)


def locate(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, cell: float, within: float = 0.0) -> DataFrame:
    """(point_id, polygon_id, away) of each point (x, y) in a polygon, or at most ``within`` from one.

    A point in several takes the smallest id and away 0; one in none takes the nearest border, ties to the
    smaller id. Points meet only polygons whose box has their grid cell, in an equi join; the fallback runs
    for points without an answer. Cells should be about the size of small polygons.
    """
    own = points.select(point_id, "x", "y").withColumn("__x", F.floor(F.col("x") / cell)).withColumn("__y", F.floor(F.col("y") / cell))
    shapes = polygons.select(polygon_id, "rings")
    hits = _met(own, shapes, polygon_id, cell).where(in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    found = hits.groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id)).withColumn("away", F.lit(0.0))
    if within <= 0:
        return found
    near = _met(own.join(found.select(point_id), point_id, "left_anti"), shapes, polygon_id, cell, within)
    near = near.withColumn("away", border_distance(F.col("x"), F.col("y"), F.col("rings"))).where(F.col("away") <= within)
    best = near.groupBy(point_id).agg(F.min(F.struct("away", polygon_id)).alias("b"))
    return found.unionByName(best.select(point_id, f"b.{polygon_id}", "b.away"))
