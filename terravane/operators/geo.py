"""Distances and spatial joins on grid cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
#: Miles in a degree of latitude.
DEGREE = 69.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def flat_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Miles on a plane, scaled at the first point."""
    return F.hypot(DEGREE * (lat2 - lat1), DEGREE * F.cos(F.radians(lat1)) * (lon2 - lon1))


def flat_miles_round(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same across longitude 180: the shorter way round."""
    d = F.abs(lon2 - lon1)
    return F.hypot(DEGREE * (lat2 - lat1), DEGREE * F.cos(F.radians(lat1)) * F.least(d, 360 - d))


#: Cells of longitude are as wide as the radius is at a band's far latitude, for bands that end here (degrees).
BANDS = (30.0, 45.0, 55.0, 63.0, 70.0, 75.0, 80.0, 84.0, 87.0)


def radius_join(left: DataFrame, right: DataFrame, r: float, metric=flat_miles_round, alias: str = "mi") -> DataFrame:
    """Pairs within r miles: (all of left, all of right, mi). Columns lat, lon are lat_l, lon_l and lat_r, lon_r.

    Cells are r miles high. How many go round a parallel depends on the latitude's band, so they are r miles wide at the band's
    far end; beyond the last band there is one. The right side is copied to the cells around it, in each band that is within r of
    it, and met by an equi join; longitudes wrap. Rows without coordinates meet nothing.
    """
    step = r / DEGREE * 1.0001
    wide = [max(1, int(360.0 / (step / math.cos(math.radians(min(89.0, b + step)))))) for b in BANDS] + [1]
    number = lambda lat: sum((F.abs(lat) > b).cast("int") for b in BANDS)
    cells = F.array(*map(F.lit, wide))
    column = lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n), n)
    a = left.withColumnsRenamed({"lat": "lat_l", "lon": "lon_l"}).withColumn("__b", number(F.col("lat_l"))).withColumn("__y", F.floor(F.col("lat_l") / step))
    a = a.withColumn("__x", column(F.col("lon_l"), F.get(cells, F.col("__b"))))
    b = right.withColumnsRenamed({"lat": "lat_r", "lon": "lon_r"})
    low, high = F.greatest(F.abs(F.col("lat_r")) - step, F.lit(0.0)), F.abs(F.col("lat_r")) + step
    b = b.withColumn("__b", F.explode(F.sequence(number(low), number(high)))).withColumn("__y", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("lat_r") / step) + k)))
    n = F.get(cells, F.col("__b"))
    b = b.withColumn("__x", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.pmod(column(F.col("lon_r"), n) + k, n)))))
    return a.join(b, ["__b", "__y", "__x"]).drop("__b", "__y", "__x").withColumn(alias, metric(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r"))).where(F.col(alias) <= r)


def nearest(pairs: DataFrame, left_id: str, right_id: str, mi: str = "mi", k: int = 1) -> DataFrame:
    """The k nearest of a list of pairs, ties by the smaller id (J7, W9): (left_id, rank, right_id, mi).

    For one it is a grouped minimum, for more a rank with a limit on each side of the shuffle.
    """
    if k == 1:
        best = pairs.groupBy(left_id).agg(F.min(F.struct(mi, right_id)).alias("b"))
        return best.select(left_id, F.lit(1).alias("rank"), F.col(f"b.{right_id}"), F.col(f"b.{mi}"))
    place = F.row_number().over(Window.partitionBy(left_id).orderBy(mi, right_id))
    return pairs.select(left_id, right_id, mi).withColumn("rank", place).where(F.col("rank") <= k).select(left_id, "rank", right_id, mi)


def nearest_in_widening_rings(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radii: tuple[float, ...], metric=flat_miles_round, k: int = 1) -> DataFrame:
    """The k nearest right rows of each left one, by radius joins of growing radius over those that haven't k yet.

    A left row takes what the last radius holds where that is fewer than k: ``radii`` must end with the farthest that counts.
    """
    out, rest = None, left
    for i, r in enumerate(radii):
        got = nearest(radius_join(rest, right, r, metric), left_id, right_id, k=k)
        if i < len(radii) - 1:
            full = got.groupBy(left_id).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= k).select(left_id)
            got = got.join(full, left_id, "left_semi")
            rest = rest.join(full, left_id, "left_anti")
        out = got if out is None else out.unionByName(got)
    return out


def near_figures(places: DataFrame, place: str, targets: DataFrame, r: float, metric=flat_miles_round) -> DataFrame:
    """(place, n, least): how many targets lie within r miles of a place and how far the nearest is (J8, J9); places of none are left out.

    Places and targets of the same coordinates are one spot each: spots meet, with how many targets they stand for.
    """
    posts = targets.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("__k"))
    met = radius_join(places.select("lat", "lon").distinct(), posts, r, metric)
    figures = met.groupBy(F.col("lat_l").alias("lat"), F.col("lon_l").alias("lon")).agg(F.sum("__k").alias("n"), F.min("mi").alias("least"))
    return places.select(place, "lat", "lon").join(figures, ["lat", "lon"]).groupBy(place).agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def spot_covers(places: DataFrame, place: str, w: str, targets: DataFrame, target: str, r: float, metric=flat_miles_round) -> tuple[DataFrame, DataFrame]:
    """(covers (candidate, unit), weights (unit, w)) of greedy covering within r miles (G13), a row for each pair of spots.

    Places of one spot are one unit of their summed weight. Targets of one spot cover the same, so the smallest stands for
    them: it comes before the others on ties, and once it is taken they gain nothing.
    """
    units = places.groupBy("lat", "lon").agg(F.min(place).alias("unit"), F.sum(w).alias("w"))
    posts = targets.groupBy("lat", "lon").agg(F.min(target).alias("candidate"))
    return radius_join(units, posts, r, metric).select("candidate", "unit"), units.select("unit", "w")


def distinct_within(places: DataFrame, place: str, targets: DataFrame, target: str, items: DataFrame, item: str, r: float, bands: tuple[float, ...], metric=flat_miles_round, measure=lambda mi: mi, many: int = 16) -> DataFrame:
    """Different items at targets within each band of a place (A10, F18, G21): columns within_<band>, for places that have any.

    places: (place, lat, lon), a row each; targets: (target, lat, lon); items: (target, item). Bands are of ``measure`` of
    the miles, and hold nothing beyond r miles. Places and targets of the same coordinates are one spot each.

    An item counts at a place for the first of its spots, in their order, that is within the band. So a spot of an item
    stands for a class: the spot and those before it that are near enough to reach the same places. Classes are
    counted, and only they meet places: each adds its number to the bands that the spot is within and none before it is.
    Items at more than ``many`` spots would have long classes. Their sets of spots are counted instead, and ``_united`` unites them.
    """
    step = r / DEGREE * 1.0001
    sites = targets.where("lat is not null and lon is not null").select(target, "lat", "lon").distinct()
    near = radius_join(places.select("lat", "lon").distinct(), sites.select("lat", "lon").distinct(), r, metric).withColumn("__d", measure(F.col("mi"))).where(F.col("__d") <= max(bands))
    own = items.select(target, item).join(sites, target).select(item, F.struct("lat", "lon").alias("__at"))
    sets = own.repartition(item).groupBy(item).agg(F.array_sort(F.collect_set("__at")).alias("__set"))
    hot = F.size("__set") > many

    def meets(s: Column, t: Column) -> Column:
        far = F.abs(t["lat"]) + 2 * step
        turn = F.pmod(s["lon"] - t["lon"], F.lit(360.0))
        return (F.abs(s["lat"] - t["lat"]) <= 2 * step) & ((far >= 89) | (F.least(turn, 360 - turn) <= 2 * step / F.cos(F.radians(far))))

    before = lambda t, i: F.filter(F.slice("__set", F.lit(1), i), lambda s: meets(s, t))
    each = F.transform("__set", lambda t, i: F.struct(t.alias("t"), before(t, i).alias("s"), F.lit(1).alias("k")))
    whole = F.array(F.struct(F.get("__set", F.lit(0)).alias("t"), F.col("__set").alias("s"), F.lit(-1).alias("k")))
    parts = sets.select(F.explode(F.when(hot, whole).otherwise(each)).alias("__e"))
    # One table for both, numbers of classes positive, of whole sets negative. Spark shuffles it once: coordinates that can't be null and
    # explode_outer keep filters from being pushed below the sums on one way only.
    at = [F.coalesce(F.col(f"__e.t.{x}"), F.lit(0.0)).alias(f"{x}_r") for x in ("lat", "lon")]
    classes = parts.groupBy(*at, F.col("__e.s").alias("__s")).agg(F.sum("__e.k").alias("__k"))
    to = lambda p: measure(metric(F.col("lat_l"), F.col("lon_l"), p["lat"], p["lon"]))
    least = F.when(F.size("__s") == 1, to(F.get("__s", F.lit(0)))).when(F.size("__s") > 1, F.array_min(F.transform("__s", to)))
    met = classes.where("__k > 0").join(near, ["lat_r", "lon_r"]).select("lat_l", "lon_l", "__k", "__d", least.alias("__before"))
    within = lambda b: (F.col("__d") <= b) & ~F.coalesce(F.col("__before") <= b, F.lit(False))
    names = [f"within_{b:g}" for b in bands]
    counted = met.groupBy("lat_l", "lon_l").agg(*(F.sum(F.when(within(b), F.col("__k")).otherwise(0)).alias(n) for b, n in zip(bands, names)))
    both = counted.unionByName(_united(classes.where("__k < 0").select("__s", (-F.col("__k")).alias("__k")), near, step, bands, names))
    counts = both.groupBy(F.col("lat_l").alias("lat"), F.col("lon_l").alias("lon")).agg(*(F.sum(n).alias(n) for n in names))
    return places.select(place, "lat", "lon").distinct().join(counts.where(F.greatest(*names, F.lit(0)) > 0), ["lat", "lon"]).select(place, *names)


#: Spots of sets that are united at a time, and bytes of the table of their bits.
UNITED, BITS = 1_000_000, 1 << 25


def _united(sets: DataFrame, near: DataFrame, step: float, bands: tuple[float, ...], names: list[str]) -> DataFrame:
    """(lat_l, lon_l, a column a band): how many of the sets (__s: spots, __k: how many) have a spot within each band of a place.

    A table of bits has a row a spot and a column a set; a place unites the rows of the spots that are near it. Sets are dealt out
    by as many shares as their spots need, and by belts of latitude of the places that they reach; a share meets the spots of its belt.
    """
    high = 4 * step
    belt = lambda lat: F.floor(lat / high)
    # One figure; near spots are copied to no share if there are no sets.
    shares = F.broadcast(sets.agg(F.ceil(F.sum(F.size("__s")) / UNITED).alias("__n")).where("__n > 0"))
    flat = lambda rows, *fields: F.flatten(F.transform(rows, lambda x: F.array(*(x[f].cast("double") for f in fields))))
    reach = lambda x: F.sequence(belt(x["lat"] - step), belt(x["lat"] + step))
    a = sets.crossJoin(shares).withColumn("__share", F.pmod(F.xxhash64("__s"), F.col("__n")))
    a = a.withColumn("__belt", F.explode_outer(F.array_distinct(F.flatten(F.transform("__s", reach)))))
    a = a.select("__share", "__belt", "__k", flat(F.filter("__s", lambda x: F.array_contains(reach(x), F.col("__belt"))), "lat", "lon").alias("at"))
    b = near.groupBy("lat_l", "lon_l").agg(F.collect_list(F.struct("lat_r", "lon_r", "__d")).alias("__r"))
    b = b.select("lat_l", "lon_l", belt(F.col("lat_l")).alias("__belt"), flat(F.col("__r"), "lat_r", "lon_r", "__d").alias("at"))
    b = b.crossJoin(shares).withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")

    def unite(left: pa.Table, right: pa.Table) -> pa.Table:
        spots, ends = left["at"].combine_chunks(), right["at"].combine_chunks()
        points = spots.flatten().to_numpy().reshape(-1, 2).copy().view(complex).ravel()
        posts = ends.flatten().to_numpy().reshape(-1, 3)
        known, row = np.unique(posts[:, :2].copy().view(complex).ravel(), return_inverse=True)
        of, cut = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy()) // 2), (ends.offsets.to_numpy() - ends.offsets[0].as_py()) // 3
        at = np.minimum(np.searchsorted(known, points), max(len(known) - 1, 0))
        there = known[at] == points if len(known) else np.zeros(len(points), bool)
        at, of, k = at[there], of[there], left["__k"].to_numpy()
        counts, few = np.zeros((len(ends), len(bands)), np.int64), max(8, BITS // max(1, len(known)))
        for low in range(0, len(spots) if len(ends) else 0, few):
            here, n = slice(*np.searchsorted(of, (low, low + few))), min(few, len(spots) - low)
            bits = np.zeros((len(known), n), bool)
            bits[at[here], of[here] - low] = True
            bits = np.packbits(bits, axis=1)
            for p, (x, y) in enumerate(zip(cut, cut[1:])):
                for i, b in enumerate(bands):
                    if len(rows := row[x:y][posts[x:y, 2] <= b]):
                        counts[p, i] += k[low : low + n][np.unpackbits(np.bitwise_or.reduce(bits[rows], axis=0), count=n).view(bool)].sum()
        return pa.table({"lat_l": right["lat_l"], "lon_l": right["lon_l"]} | {c: counts[:, i] for i, c in enumerate(names)})

    keys = ("__belt", "__share")
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(unite, "lat_l double, lon_l double, " + ", ".join(f"`{c}` long" for c in names))
