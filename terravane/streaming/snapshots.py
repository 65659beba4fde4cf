"""Snapshots that arrive as files, as a stream (an addition: the batch operators need none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def daily_counts(stream: DataFrame, ts: str, late: str = "1 day", by: str | None = None) -> DataFrame:
    """Rows a day under a watermark."""
    keys = [F.window(ts, "1 day").alias("day"), *([by] if by else [])]
    return stream.withWatermark(ts, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
