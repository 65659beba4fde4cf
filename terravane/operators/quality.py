"""Checks of a result before it is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checks(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check, failures, ok): rows that fail each condition, all counted in one pass; null fails."""
    counts = df.agg(*(F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in conditions.items()))
    pairs = ", ".join(f"'{n}', `{n}`" for n in conditions)
    return counts.selectExpr(f"stack({len(conditions)}, {pairs}) as (check, failures)").withColumn("ok", F.col("failures") == 0)


def accounting(df: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """(bucket, n): each row in the first bucket whose condition holds, the rest as ``kept``."""
    which = F.coalesce(*(F.when(c, F.lit(n)) for n, c in buckets.items()), F.lit("kept"))
    return df.groupBy(which.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def reconcile(parts: DataFrame, totals: DataFrame, key: str, value: str) -> DataFrame:
    """Sums of parts against published totals, with percent difference."""
    sums = parts.groupBy(key).agg(F.sum(value).alias("summed"))
    return totals.select(key, F.col(value).alias("published")).join(sums, key, "left").withColumn("pct", F.try_divide(100.0 * (F.col("summed") - F.col("published")), F.col("published")))


def falls(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows where a value that should rise falls."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("before", before).where(F.col("before") > F.col(value))


def passed(result: DataFrame) -> bool:
    return not result.where(~F.col("ok")).head(1)
