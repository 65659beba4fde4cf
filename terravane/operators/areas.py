"""People and places on areas: nearby people, centres, apportionment, road screens, medians of distances with no-route rows
(A14 to A16, A29, G11, G20, G22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .geo import flat_miles, nearest_in_widening_rings, radius_join

NO_ROUTE = 999


def people_near(points: DataFrame, units: DataFrame, point_id: str, unit_id: str, w: str, r: float, most: float = 500.0, rings: tuple[float, ...] = ()) -> DataFrame:
    """(point_id, people): weight of the units within r miles of a point.

    A point with none takes its nearest unit's weight, ``most`` of it at most; ``rings`` are radii in which that is
    looked for. Points with no unit at all have 0.
    """
    pairs = radius_join(points.select(point_id, "lat", "lon"), units.select(unit_id, w, "lat", "lon"), r)
    found = pairs.groupBy(point_id).agg(F.sum(w).alias("people"))
    rest = points.select(point_id, "lat", "lon").join(found, point_id, "left_anti")
    near = nearest_in_widening_rings(rest, units.select(unit_id, "lat", "lon"), point_id, unit_id, rings or (4 * r, 16 * r)).join(units.select(unit_id, F.col(w).alias("__w")), unit_id)
    near = near.select(point_id, F.least("__w", F.lit(most)).alias("people"))
    return points.select(point_id).join(found.unionByName(near), point_id, "left").select(point_id, F.coalesce("people", F.lit(0.0)).alias("people"))


def centres(parts: DataFrame, area: str, w: str, control: DataFrame, total: str, places: DataFrame, low: float = 0.5, high: float = 2.0, close: float = 1.0) -> DataFrame:
    """(area, lat, lon, coverage, source): weighted spherical centres of areas from their parts.

    coverage is the parts' weight as a share of the area's ``total`` in ``control`` (area, total, lat, lon). A centre
    counts if coverage is between low and high and a place of the area (area, lat, lon) lies within ``close`` miles, or
    the area has no place; else the area's own point stands. source tells which: parts, coverage or place.
    """
    lat, lon = stats.spherical_mean(F.col("lat"), F.col("lon"), F.col(w))
    own = parts.where(F.col(w) > 0).groupBy(area).agg(F.sum(w).alias("w"), lat.alias("clat"), lon.alias("clon"))
    base = control.select(area, F.col(total).alias("total"), F.col("lat").alias("plat"), F.col("lon").alias("plon")).join(own, area, "left")
    base = base.withColumn("coverage", F.try_divide(F.col("w"), F.col("total")))
    away = base.join(places.select(area, F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), area).groupBy(area).agg(F.min(flat_miles(F.col("clat"), F.col("clon"), F.col("qlat"), F.col("qlon"))).alias("away"))
    out = base.join(away, area, "left")
    covered = F.coalesce(F.col("coverage").between(low, high), F.lit(False))
    source = F.when(~covered, "coverage").when(F.col("away") > close, "place").otherwise("parts")
    ok = source == "parts"
    return out.select(area, F.when(ok, F.col("clat")).otherwise(F.col("plat")).alias("lat"), F.when(ok, F.col("clon")).otherwise(F.col("plon")).alias("lon"), "coverage", source.alias("source"))


def apportion(parts: DataFrame, people: DataFrame, target: str, source: str, land: str, w: str) -> DataFrame:
    """(target, w): people of source areas shared out to target areas by land (G22). parts: (target, source, land)."""
    total = parts.groupBy(source).agg(F.sum(land).alias("__land"))
    share = F.try_divide(F.col(land), F.col("__land"))
    return parts.join(total, source).join(people.select(source, w), source).groupBy(target).agg(F.sum(share * F.col(w)).alias(w))


def far_by_road(units: DataFrame, straight: str, road: str, area: str, w: str, excluded: tuple[str, ...] = (), near: float = 20.0, far: float = 60.0) -> DataFrame:
    """(area, units, w): units that something is near in a straight line and far from by road, or has no road to."""
    flagged = (F.col(straight) <= near) & (F.coalesce(F.col(road), F.lit(float("inf"))) > far)
    own = units.where(flagged & ~F.col(area).isin(*excluded)) if excluded else units.where(flagged)
    return own.groupBy(area).agg(F.count(F.lit(1)).alias("units"), F.sum(w).alias(w))


def routed_median(df: DataFrame, by: list[str], x: str, w: str, alias: str = "median") -> DataFrame:
    """Lower weighted median of distances over rows with a route, as whole miles, 999 for a group of none."""
    found = stats.lower_weighted_median(df.where(F.col(x) < NO_ROUTE), by, x, w, "__m")
    return df.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce(F.floor(F.col("__m") + 0.5), F.lit(NO_ROUTE)).cast("long").alias(alias))


def routed_median_or_plain(df: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    """(by, median, n_routed): as ``routed_median``, but the plain median of routed rows where these have no weight."""
    routed = df.where(F.col(x) < NO_ROUTE)
    found = stats.median_with_fallback(routed, by, x, w, "__m").join(routed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_routed")), by)
    out = df.select(*by).distinct().join(found, by, "left")
    return out.select(*by, F.coalesce(F.col("__m").cast("double"), F.lit(float(NO_ROUTE))).alias("median"), F.coalesce("n_routed", F.lit(0)).alias("n_routed"))


def routed_mode(df: DataFrame, by: list[str], x: str, w: str, routed: Column, alias: str = "mode") -> DataFrame:
    """Value of most weight among routed rows; the others count only where a group has none."""
    sums = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(F.when(routed, F.col(w))).alias("a"), F.sum(w).alias("b"))
    key = F.struct(F.col("a").isNull().alias("without"), (-F.coalesce("a", "b")).alias("w"), F.col(x).alias("x"))
    return sums.groupBy(*by).agg(F.min(key)["x"].alias(alias))
