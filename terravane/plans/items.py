"""The tool over items such as trials (M5, T5): four scopes by five filters, with facets and a sample.

Items are (id, title, text, phase, group, labels array, primary label, least_age, updated); ``where`` is (id, area, state): the
areas in which an item has a site; ``near`` is (area, id): the items within reach of an area's centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compiler import QueryError

#: Labels that count only as an item's primary one.
CATCH_ALL = ("multi", "other_unclassified")
FILTERS = ("label", "phase", "group", "keyword", "least_age_at_most")


def in_scope(items: DataFrame, where: DataFrame, near: DataFrame, scope) -> DataFrame:
    """Items with a site in an area, within reach of one, with a site in a state, or all.

    A bare text is read as an area's id if it is digits, as all if it says so, else as a state.
    """
    if isinstance(scope, (str, int)):
        text = str(scope).strip()
        scope = {"area": text.zfill(5)} if text.isdigit() else {"all": True} if text.lower() in ("us", "usa", "all", "national") else {"state": text}
    if not isinstance(scope, dict) or len(scope) != 1:
        raise QueryError("a scope is one of area, near_area, state and all", ["area", "near_area", "state", "all"])
    ((kind, value),) = scope.items()
    if kind == "all":
        return items
    if kind == "area":
        ids = where.where(F.col("area") == value)
    elif kind == "near_area":
        ids = near.where(F.col("area") == value)
    elif kind == "state":
        ids = where.where(F.upper("state") == str(value).upper())
    else:
        raise QueryError(f"no scope {kind!r}", ["area", "near_area", "state", "all"])
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def passed(items: DataFrame, filters: dict) -> DataFrame:
    """Items that pass the filters; an item without a least age passes that one, catch-all labels must be primary."""
    for name, value in filters.items():
        if name not in FILTERS:
            raise QueryError(f"no filter {name!r}", list(FILTERS))
        if value in (None, ""):
            continue
        if name == "label":
            label = str(value).strip().lower()
            items = items.where(F.col("primary") == label if label in CATCH_ALL else F.array_contains("labels", label))
        elif name == "phase":
            items = items.where(F.upper("phase") == str(value).strip().upper().removeprefix("PHASE").strip().replace("/", "-"))
        elif name == "group":
            items = items.where(F.lower("group") == str(value).strip().lower())
        elif name == "keyword":
            items = items.where(F.contains(F.lower(F.concat_ws(" ", "title", "text")), F.lit(str(value).strip().lower())))
        else:
            items = items.where(F.col("least_age").isNull() | (F.col("least_age") <= float(value)))
    return items


def facets(items: DataFrame, phases: list[str], groups: list[str], most: int = 10) -> DataFrame:
    """(facet, value, n): counts by phase and group over their whole domains, and the most frequent labels, in one pass.

    Labels come by falling count, ties in order.
    """
    pairs = [F.struct(F.lit("phase").alias("facet"), F.col("phase").alias("value")), F.struct(F.lit("group").alias("facet"), F.col("group").alias("value"))]
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.struct(F.lit("label").alias("facet"), x.alias("value")))
    counts = items.select(F.explode(F.concat(F.array(*pairs), labels)).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))
    spark = items.sparkSession
    domain = spark.createDataFrame([("phase", p) for p in phases] + [("group", g) for g in groups], "facet string, value string")
    known = domain.join(counts, ["facet", "value"], "left").select("facet", "value", F.coalesce("n", F.lit(0)).alias("n"))
    top = counts.where("facet = 'label'").orderBy(F.desc("n"), "value").limit(most)
    return known.unionByName(top)


def sample(items: DataFrame, limit: int = 10) -> DataFrame:
    """The latest updated items, ties by id (T5); 25 at most."""
    return items.orderBy(F.col("updated").desc_nulls_last(), "id").limit(max(1, min(25, limit)))


def ask(items: DataFrame, where: DataFrame, near: DataFrame, spec: dict, phases: list[str], groups: list[str]) -> dict:
    """The answer of the tool: {count, in_scope, by_phase, by_group, by_label, sample, returned}."""
    scoped = in_scope(items, where, near, spec.get("scope"))
    hits = passed(scoped, {k: v for k, v in spec.items() if k not in ("scope", "limit")})
    try:
        limit = int(spec.get("limit") or 10)
    except (TypeError, ValueError):
        limit = 10
    told = [r.asDict() for r in facets(hits, phases, groups).collect()]
    by = {f: {r["value"]: r["n"] for r in told if r["facet"] == f} for f in ("phase", "group", "label")}
    rows = [r.asDict(True) for r in sample(hits, limit).collect()]
    count, whole = hits.count(), scoped.count()
    return {"count": count, "in_scope": whole, "by_phase": by["phase"], "by_group": by["group"], "by_label": by["label"], "sample": rows, "returned": len(rows)}
