"""Evidence about rows from the other rows: majorities and rows that stand for no place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(rows: DataFrame, key: list[str], value: str, least: int = 2, share: tuple[int, int] = (2, 3)) -> DataFrame:
    """(key, value, n, total): the value that at least ``share`` of a key's rows have, of ``least`` rows or more.

    Null values count in neither. Counts per (key, value) come first, so a hot key is a few rows when its
    values meet. With a share of a half or less, ties go to the smaller value.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"))
    out = best.select(*key, F.col("b.v").alias(value), (-F.col("b.n")).alias("n"), "total")
    return out.where((F.col("total") >= least) & (share[1] * F.col("n") >= share[0] * F.col("total")))


def virtual_by_context(rows: DataFrame, item: str, name: str, state: str, virtual: str, least: int = 10) -> DataFrame:
    """``rows`` with by_context: an unmarked row whose name its item gives to ``least`` marked rows or more, while no
    other item has that name in the row's state (G18).

    ``virtual`` marks rows (boolean, null is false). Names and states are compared as they are; a row with a
    null item, name or state is never told by context.
    """
    marked = F.coalesce(F.col(virtual), F.lit(False))
    often = rows.where(marked).groupBy(F.col(item).alias("__i"), F.col(name).alias("__n")).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") >= least)
    items = rows.where(F.col(item).isNotNull()).groupBy(F.col(name).alias("__m"), F.col(state).alias("__s")).agg(F.min(item).alias("__lo"), F.max(item).alias("__hi"))
    alone = items.where("__lo = __hi").select("__m", "__s", "__lo")
    out = rows.join(often, (F.col(item) == F.col("__i")) & (F.col(name) == F.col("__n")), "left")
    out = out.join(alone, (F.col(name) == F.col("__m")) & (F.col(state) == F.col("__s")) & (F.col(item) == F.col("__lo")), "left")
    return out.withColumn("by_context", ~marked & F.col("__k").isNotNull() & F.col("__lo").isNotNull()).drop("__i", "__n", "__k", "__m", "__s", "__lo")
