"""Polygons against known values and plain geometry."""

import math

import pytest
from pyspark.sql import functions as F

from terravane.operators import polygons

L_SHAPE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)], [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]]


@pytest.fixture(scope="module")
def shapes(spark):
    square = [[(6.0, 6.0), (8.0, 6.0), (8.0, 8.0), (6.0, 8.0)]]
    return spark.createDataFrame([(1, L_SHAPE), (2, square), (3, square), (4, []), (5, None)], f"shape long, rings {polygons.RINGS}")


def test_projection_against_published_example(spark):
    east, north = polygons.albers(F.lit(-75.0), F.lit(35.0), ellipsoid=(6378206.4, 0.00676866))
    row = spark.range(1).select(east, north).head()
    assert row[0] == pytest.approx(1885472.7, abs=0.1) and row[1] == pytest.approx(1535925.0, abs=0.1)


def test_area(spark):
    rows = [("octant", [[(0.0, 0.0), (90.0, 0.0), (0.0, 90.0)]]), ("hole", [[(0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.0, 0.2)], [(0.05, 0.05), (0.05, 0.15), (0.15, 0.15), (0.15, 0.05)]]), ("none", [])]
    df = spark.createDataFrame(rows, f"k string, rings {polygons.RINGS}")
    got = {r[0]: r[1] for r in df.select("k", polygons.spherical_area(F.col("rings"))).collect()}
    assert got["octant"] == pytest.approx(math.pi / 2)
    assert got["hole"] == pytest.approx(math.radians(0.2) ** 2 - math.radians(0.1) ** 2, rel=1e-4)
    assert got["none"] == 0


def test_locate(spark, shapes):
    points = [(1, 0.5, 0.5), (2, 0.1, 0.1), (3, 3.0, 0.5), (4, 3.0, 3.0), (5, 7.0, 7.0), (6, 8.2, 7.0), (7, 1.1, 2.0), (8, None, 1.0), (2, 0.1, 0.1)]
    df = spark.createDataFrame(points, "p long, x double, y double")
    got = sorted(map(tuple, polygons.locate(df, shapes, "p", "shape", cell=1.0, within=0.3).collect()))
    assert [(p, s, round(a, 6)) for p, s, a in got] == [(1, 1, 0.25), (2, 1, 0.0), (3, 1, 0.0), (5, 2, 0.0), (6, 2, 0.2), (7, 1, 0.1)]
    assert polygons.locate(df.limit(0), shapes, "p", "shape", cell=1.0, within=1.0).count() == 0


def test_line_inside(spark, shapes):
    lines = [("along", 0.1, 3.0, 0.9, 0.9, True), ("corner", 3.0, 0.5, 0.5, 3.0, False), ("hole", 0.1, 0.5, 0.9, 0.5, False), ("out", 0.5, 2.0, 2.0, 2.0, False)]
    df = spark.createDataFrame(lines, "k string, x1 double, y1 double, x2 double, y2 double, want boolean").crossJoin(F.broadcast(shapes.where("shape = 1")))
    for k, want, got in df.select("k", "want", polygons.line_inside(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("rings"))).collect():
        assert got == want, k
