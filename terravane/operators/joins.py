"""Joins, fallback ladders, snapshot comparison and set operations (J, U, R, M12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in a stated order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def ladder(df: DataFrame, steps: list[tuple[str, DataFrame, list[str], str]], value: str, method: str = "method") -> DataFrame:
    """Left joins tried in order: the first that has a value gives it, and ``method`` tells which.

    A step is (name, table, keys, its value's column); tables are unique in their keys.
    """
    found = []
    for i, (name, table, keys, column) in enumerate(steps):
        df = df.join(table.select(*keys, F.col(column).alias(f"__v{i}")), keys, "left")
        found.append((name, f"__v{i}"))
    out = df.withColumn(value, F.coalesce(*(F.col(c) for _, c in found)))
    out = out.withColumn(method, F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in found), F.lit("none")))
    return out.drop(*(c for _, c in found))


def bridge(left: DataFrame, across: DataFrame, on: str, w: str, share: str, alias: str = "w") -> DataFrame:
    """Many-to-many join in which a row's weight is split by shares."""
    return left.join(across, on).withColumn(alias, F.col(w) * F.col(share))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that were added, removed or changed, with the columns that changed (J6, U3, M12); null-safe."""
    a = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("__old"))
    b = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("__new"))
    both = a.join(b, keys, "full_outer")
    changed = F.filter(F.array(*(F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.size(changed) > 0, "changed")
    out = both.withColumn("change", kind).withColumn("fields", F.when(kind == "changed", changed).otherwise(F.array().cast("array<string>")))
    return out.where("change is not null").drop("__old", "__new")


def complete(df: DataFrame, keys: DataFrame, on: list[str], **fill) -> DataFrame:
    """Rows for missing keys, with stated values."""
    out = keys.select(*on).distinct().join(df.withColumn("__has", F.lit(True)), on, "left")
    for c, v in fill.items():
        out = out.withColumn(c, F.when(F.col("__has").isNull(), F.lit(v)).otherwise(F.col(c)))
    return out.drop("__has")


def splice(df: DataFrame, other: DataFrame, condition) -> DataFrame:
    """Rows under a condition replaced by another source's (U4)."""
    return df.where(~F.coalesce(condition, F.lit(False))).unionByName(other.select(*df.columns))


def subset_pairs(left: DataFrame, right: DataFrame, id_: str, tokens: str, least: int = 2) -> DataFrame:
    """(a_id, b_id): pairs of rows of which one's token set holds the other's, with ``least`` tokens in common."""
    sets = [subset_sets(d, tokens, least) for d in (left, right)]
    met = subset_classes(*sets)
    rows = [d.select(F.col(id_).alias(n), F.array_sort(F.array_distinct(tokens)).alias(t)) for d, n, t in ((left, "a_id", "a"), (right, "b_id", "b"))]
    return met.join(rows[0], "a").join(rows[1], "b").select("a_id", "b_id")


def subset_sets(df: DataFrame, tokens: str, least: int = 2) -> DataFrame:
    """(t): the different token sets of ``least`` tokens or more, in order."""
    return df.select(F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") >= least).distinct()


def subset_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): pairs of different token sets (t) of which one holds the other; rows of equal sets are one here.

    Candidates meet on the rarest token of the smaller set: a set inside another shares all its tokens, so each set is
    dealt out once by its rarest and the other side by all of its own.
    """
    every = left.unionByName(right).select(F.explode("t").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    def rarest(d):
        return d.select("t", F.explode("t").alias("k")).join(every, "k").groupBy("t").agg(F.min(F.struct("n", "k"))["k"].alias("k"))

    out = None
    for small, large, names in ((left, right, ("a", "b")), (right, left, ("b", "a"))):
        s = rarest(small).select(F.col("t").alias(names[0]), "k")
        g = large.select(F.col("t").alias(names[1]), F.explode("t").alias("k"))
        hit = s.join(g, "k").where(F.size(F.array_except(names[0], names[1])) == 0).select("a", "b")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def collect_index(df: DataFrame, key: str, values: str) -> DataFrame:
    """An inverted index: each value of a list column and its sorted keys.

    A value's keys are a row of the result, so this is for values of few keys, such as areas; ``value_pairs`` has no such bound.
    """
    return df.select(key, F.explode(values).alias("value")).groupBy("value").agg(F.sort_array(F.collect_set(key)).alias("keys"))


def value_pairs(df: DataFrame, key: str, values: str) -> DataFrame:
    """The same as rows (value, key)."""
    return df.select(F.explode(values).alias("value"), key).distinct()
