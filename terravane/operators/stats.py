"""Weighted statistics (A9 to A30, W1 to W7). All are one or two grouped aggregations; sums come unrounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(mask: Column, w: Column) -> Column:
    """Percent of weight under a mask (A11); null where there is no weight."""
    return F.try_divide(100.0 * F.sum(F.when(mask, w).otherwise(0)), F.sum(w))


def weighted_mean(x: Column, w: Column) -> Column:
    """Over rows with value and positive weight."""
    ok = x.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)))


def coverage(x: Column, w: Column) -> Column:
    """Percent of weight that has a value."""
    return F.try_divide(100.0 * F.sum(F.when(x.isNotNull(), w).otherwise(0)), F.sum(w))


def lower_weighted_median(df: DataFrame, by: list[str], x: str, w: str, alias: str = "median") -> DataFrame:
    """First value at which the running weight reaches half (A14, W1); null values don't count.

    Equal values of a group are summed before the running sum, so a group's window has a row a value.
    """
    values = df.where(F.col(x).isNotNull() & (F.col(w) > 0)).groupBy(*by, x).agg(F.sum(w).alias("__w"))
    group = Window.partitionBy(*by)
    run = F.sum("__w").over(group.orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = values.withColumn("__run", run).withColumn("__all", F.sum("__w").over(group))
    return found.where(F.col("__run") >= F.col("__all") / 2).groupBy(*by).agg(F.min(x).alias(alias))


def median_with_fallback(df: DataFrame, by: list[str], x: str, w: str, alias: str = "median") -> DataFrame:
    """Lower weighted median; the plain median of the values where they have no weight (A15); a row for every group."""
    weighted = lower_weighted_median(df, by, x, w, "__weighted")
    plain = df.groupBy(*by).agg(F.median(x).alias("__plain"))
    return plain.join(weighted, by, "left").select(*by, F.coalesce("__weighted", "__plain").alias(alias))


def weighted_mode(df: DataFrame, by: list[str], x: str, w: str, alias: str = "mode") -> DataFrame:
    """Value of most weight, the first in order among ties (A16). Two sums, no window."""
    sums = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(w).alias("__w"))
    return sums.groupBy(*by).agg(F.min(F.struct((-F.col("__w")).alias("w"), F.col(x).alias("x")))["x"].alias(alias))


def top_shares(df: DataFrame, by: list[str], x: str, w: str, k: int = 3, alias: str = "shares") -> DataFrame:
    """The k values of most weight with percent of all weight, as an array of structs."""
    sums = df.groupBy(*by, x).agg(F.sum(w).alias("__w"))
    group = Window.partitionBy(*by)
    ranked = sums.withColumn("__all", F.sum("__w").over(group)).withColumn("rank", F.row_number().over(group.orderBy(F.desc("__w"), x)))
    item = F.struct("rank", F.col(x).alias("value"), (100.0 * F.col("__w") / F.col("__all")).alias("share"))
    return ranked.where((F.col("rank") <= k) & F.col(x).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias(alias))


def frequency_mode(df: DataFrame, by: list[str], x: str, *ties: Column, alias: str = "mode") -> DataFrame:
    """Most frequent value; ties by the given keys, then by value."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__n"))
    key = F.struct((-F.col("__n")).alias("n"), *(t.alias(f"t{i}") for i, t in enumerate(ties)), F.col(x).alias("x"))
    return counts.groupBy(*by).agg(F.min(key)["x"].alias(alias))


def largest_remainder(df: DataFrame, by: list[str], total: str, x: str, order: str, alias: str = "n") -> DataFrame:
    """Integers that sum to a group's total, in proportion to x (W7, G23): the largest remainders are rounded up."""
    group = Window.partitionBy(*by)
    quota = df.withColumn("__q", F.col(x) * F.col(total) / F.sum(x).over(group)).withColumn("__f", F.floor("__q"))
    short = F.col(total) - F.sum("__f").over(group)
    rank = F.row_number().over(group.orderBy(F.desc(F.col("__q") - F.col("__f")), order))
    return quota.withColumn(alias, F.col("__f") + (rank <= short).cast("long")).drop("__q", "__f")


def rollup(df: DataFrame, grains: dict[str, list[str]], aggs: list[Column], top: str = "all") -> DataFrame:
    """The same aggregates at several grains that needn't nest (A26): (grain, key, aggregates)."""
    out = None
    for name, keys in grains.items():
        key = F.concat_ws("/", *keys) if keys else F.lit(top)
        part = df.groupBy(key.cast("string").alias("key")).agg(*aggs).select(F.lit(name).alias("grain"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def spherical_mean(lat: Column, lon: Column, w: Column) -> tuple[Column, Column]:
    """(lat, lon) of the weighted mean of unit vectors."""
    a, b = F.radians(lat), F.radians(lon)
    x, y, z = F.sum(w * F.cos(a) * F.cos(b)), F.sum(w * F.cos(a) * F.sin(b)), F.sum(w * F.sin(a))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def one_hot_counts(df: DataFrame, by: str, labels: str, item: str, domain: list[str]) -> DataFrame:
    """Different items under each label of a list column, a column a label of the domain."""
    long = df.select(by, item, F.explode(labels).alias("__label"))
    return long.groupBy(by).pivot("__label", domain).agg(F.count_distinct(item)).na.fill(0)


def facets(df: DataFrame, x: str, domain: DataFrame) -> DataFrame:
    """Counts of a column's values, 0 for those of the domain that don't occur."""
    counts = df.groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    return domain.select(x).distinct().join(counts, x, "left").select(x, F.coalesce("n", F.lit(0)).alias("n"))


def enough(df: DataFrame, n: str, least: int) -> DataFrame:
    """Rows of groups that are large enough for their figures to be told."""
    return df.where(F.col(n) >= least)
