"""Tables made of grouped rows: universes, groups, flags, audits, samples, leaderboards, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def audit(df: DataFrame, decision: Column, labels: dict[str, str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows on which something was decided, with its wording, in a stated order (R1). Decisions without a wording stay out."""
    words = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return df.withColumn("decision", F.element_at(words, decision)).where("decision is not null").orderBy("decision", *order).select("decision", *columns)


def blank_where(key: Column, method: Column, methods: list[str]) -> Column:
    """A row's own key, empty where the row was placed by other means (R2)."""
    return F.when(~F.coalesce(method.isin(*methods), F.lit(False)), key).otherwise("")


def usual_code(rows: DataFrame, key: list[str], code: str, kin: Column) -> DataFrame:
    """(key, code): the code of most rows that are kin, then of most rows of all keys, then the lowest."""
    own = rows.where(F.col(code).isNotNull())
    busy = own.groupBy(code).agg(F.count(F.lit(1)).alias("__busy"))
    counts = own.groupBy(*key, code).agg(F.count_if(kin).alias("__kin")).join(busy, code)
    best = F.min(F.struct((-F.col("__kin")).alias("a"), (-F.col("__busy")).alias("b"), F.col(code).alias("c")))
    return counts.groupBy(*key).agg(best["c"].alias(code))


def universe(rows: DataFrame, key: list[str], modes: list[str], item: str) -> DataFrame:
    """A row a key with the usual value of each of ``modes`` (ties to the smaller) and the number of different items.

    Counts by (key, value) come first, so a hot key is as many rows as it has values.
    """
    out = rows.groupBy(*key).agg(F.count_distinct(item).alias("n_items"))
    for m in modes:
        counts = rows.where(F.col(m).isNotNull()).groupBy(*key, m).agg(F.count(F.lit(1)).alias("__n"))
        out = out.join(counts.groupBy(*key).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(m).alias("v")))["v"].alias(m)), key, "left")
    return out


def members(df: DataFrame, key: list[str], value: str, alias: str = "members") -> DataFrame:
    """Sorted different values of each key, of a small domain such as states."""
    return df.where(F.col(value).isNotNull()).select(*key, value).distinct().groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias(alias))


def entries(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """A row for each combination of keys with its number of different items and the first and last of them.

    Null keys form combinations of their own.
    """
    return df.groupBy(*keys).agg(F.count_distinct(item).alias("n_items"), F.min(item).alias("first_item"), F.max(item).alias("last_item"))


def only_doubtful(df: DataFrame, key: list[str], flagged: Column) -> DataFrame:
    """(key, doubtful, n): whether all entries of a key are flagged and none is firm."""
    return df.groupBy(*key).agg(F.bool_and(F.coalesce(flagged, F.lit(False))).alias("doubtful"), F.count(F.lit(1)).alias("n"))


def doubt_note(rows: DataFrame, doubts: DataFrame, key: list[str], text: str) -> DataFrame:
    """``rows`` with note: ``text``, a format of the number of entries, where all of the key's entries are doubtful."""
    own = doubts.where("doubtful").select(*key, F.col("n").alias("__n"))
    return rows.join(own, key, "left").withColumn("note", F.when(F.col("__n").isNotNull(), F.format_string(text, "__n"))).drop("__n")


def contained_names(df: DataFrame, block: list[str], name: str, least: int = 8) -> DataFrame:
    """(block, shorter, longer): different names of a block of which one, of ``least`` letters, is a part of the other.

    They meet by the beginning of the shorter one, which the longer one has somewhere, so only pairs with that much
    in common are looked at.
    """
    own = df.select(*block, name).where(F.length(name) >= least).distinct()
    parts = F.transform(F.sequence(F.lit(1), F.length(name) - least + 1), lambda i: F.substring(F.col(name), i, F.lit(least)))
    longer = own.select(*block, F.col(name).alias("longer"), F.explode(F.array_distinct(parts)).alias("part"))
    shorter = own.select(*block, F.col(name).alias("shorter"), F.left(name, F.lit(least)).alias("part"))
    return shorter.join(longer, [*block, "part"]).where((F.col("shorter") != F.col("longer")) & F.contains("longer", "shorter")).select(*block, "shorter", "longer")


def map_units(rows: DataFrame, unit: Column) -> DataFrame:
    """Different ids of the map's units that rows stand on (R11); rows of none are left out."""
    return rows.select(unit.alias("unit")).where("unit is not null").distinct()


def remap(df: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """``df`` with old codes replaced by those that took their place; codes: (old, new), old is unique."""
    return df.join(codes.select(F.col("old").alias(code), F.col("new").alias("__new")), code, "left").withColumn(code, F.coalesce("__new", code)).drop("__new")


def mid_word(df: DataFrame, id_: str, text: str, rules: list[tuple[str, str]], allowed: DataFrame) -> DataFrame:
    """(id, label, word): matches of a label's pattern that begin inside a word, but for allowed words.

    allowed: (label, word). The word is the whole run of letters around the match, in lower case.
    """
    words = df.select(id_, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1))).alias("word"))
    hits = F.filter(F.array(*(F.when(F.col("word").rlike(rf"^\p{{L}}+(?:{p})"), F.lit(label)) for label, p in rules)), lambda x: x.isNotNull())
    found = words.select(id_, "word", F.explode(hits).alias("label"))
    return found.join(allowed, ["label", "word"], "left_anti").select(id_, "label", "word")


def seeded_sample(df: DataFrame, id_: str, n: int, seed: str) -> DataFrame:
    """The n rows of smallest digest of id and seed: the same at every run and on every cluster."""
    return df.orderBy(F.md5(F.concat(F.col(id_).cast("string"), F.lit(seed)).cast("binary")), id_).limit(n)


def terms(c: Column, pattern: str, most: int = 6) -> Column:
    """The first of a text's sorted different matches, in lower case."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), 1))), 1, most)


def term_shares(df: DataFrame, area: str, flags: dict[str, Column], weight: str) -> DataFrame:
    """For each area the percent of weight under each flag, all in one pass."""
    w = F.sum(weight)
    return df.groupBy(area).agg(w.alias("weight"), *(F.try_divide(100 * F.sum(F.when(c, F.col(weight)).otherwise(0)), w).alias(n) for n, c in flags.items()))


def leaderboard(df: DataFrame, value: str, name: str, n: int = 10) -> DataFrame:
    """The n rows of highest value, ties by name, nulls last."""
    return df.orderBy(F.col(value).desc_nulls_last(), name).limit(n)


def top_facets(df: DataFrame, labels: str, n: int = 10) -> DataFrame:
    """(label, n): the n most frequent labels of a list column, ties by label."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(n)


def place_of(df: DataFrame, by: list[str], value: str, order: str, alias: str = "place") -> DataFrame:
    """``df`` with places 1 to n of a group by falling value, equal values in the order that they came in."""
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), order)))


def history(snapshots: DataFrame, by: list[str], date: str, values: list[str]) -> DataFrame:
    """Snapshots with the change of each value since the one before and whether it is the current one."""
    along = Window.partitionBy(*by).orderBy(date)
    out = snapshots
    for v in values:
        out = out.withColumn(f"{v}_change", F.col(v) - F.lag(v).over(along))
    return out.withColumn("current", F.lead(date).over(along).isNull())


def to_do(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Items whose (id, update, version) isn't done yet."""
    return items.join(done.select(*key), key, "left_anti")


def global_ranks(df: DataFrame, value: str, spread: int = 200) -> DataFrame:
    """``df`` with overall (1 + rows of higher value) and ties (other rows of the same value).

    Values are counted, dealt out by ranges in falling order, counted up within each range, and the ranges' own
    counts, a row each, put before them: no row set meets in one task.
    """
    values = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    dealt = values.repartitionByRange(spread, F.desc(value)).withColumn("__part", F.spark_partition_id())
    own = F.sum("__n").over(Window.partitionBy("__part").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn("__own", F.coalesce(own, F.lit(0)))
    sums = dealt.groupBy("__part").agg(F.sum("__n").alias("__all"))  # ``spread`` rows at most
    before = F.coalesce(F.sum("__all").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.join(sums.select("__part", before.alias("__before")), "__part")
    ranked = ranked.select(value, (1 + F.col("__own") + F.col("__before")).alias("overall"), (F.col("__n") - 1).alias("ties"))
    return df.join(ranked, value)


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], spread: int = 64) -> DataFrame:
    """Interpolated quantiles of each group (A5, A23), exact, without all of a group's values in one place.

    Different values are counted, dealt out by ranges of (group, value), counted up within each range, and after
    the counts of the group's ranges before; the two values around each wanted place then meet.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    dealt = counts.repartitionByRange(spread, *by, value).withColumn("__part", F.spark_partition_id())
    along = Window.partitionBy("__part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("__run", F.sum("__n").over(along))
    sums = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__all"))  # a group has ``spread`` rows at most
    up = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__all").over(up), F.lit(0))).withColumn("__total", F.sum("__all").over(Window.partitionBy(*by)))
    sums = sums.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__{c}") for c in by), "__before", "__total")
    on = [F.col("__part") == F.col("__p"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)]
    placed = dealt.join(sums, on).select(*by, F.col(value).alias("v"), (F.col("__run") + F.col("__before")).alias("last"), "__n", "__total")
    aggs = []
    for name, q in shares.items():
        at = (F.col("__total") - 1) * F.lit(q)
        holds = lambda k: (F.col("last") > k) & (F.col("last") - F.col("__n") <= k)
        low, high = F.max(F.when(holds(F.floor(at)), F.col("v"))), F.max(F.when(holds(F.ceil(at)), F.col("v")))
        part = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*by).agg(*aggs)
