"""Text, place names and codes as column expressions (X1 to X9, P, F16, R18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that stand for each other at the start of a place name.
PREFIXES = (("saint ", "st "), ("mount ", "mt "), ("fort ", "ft "))


def norm(c: Column) -> Column:
    """Lower case, runs of other than letters and digits to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def zip5(c: Column) -> Column:
    """First five digits unless a sixth follows, or of nine digits; else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{5}(?!\d)"), F.substring(t, 1, 5)).when(t.rlike(r"^\d{9}$"), F.substring(t, 1, 5))


def age_years(c: Column) -> Column:
    """'18 Years', '6 Months' and the like in years; null if it isn't one."""
    n = F.try_to_number(F.nullif(F.regexp_extract(c, r"^\s*(\d+)", 1), F.lit("")), F.lit("999999")).cast("double")
    unit = F.lower(F.regexp_extract(c, r"^\s*\d+\s+(\p{L}+)", 1))
    per = F.when(unit.startswith("year"), 1.0).when(unit.startswith("month"), 12.0).when(unit.startswith("week"), 52.0).when(unit.startswith("day"), 365.0)
    return n / per


def spellings(c: Column) -> Column:
    """A normalised name and its other spellings, in order."""
    out = [c]
    for a, b in PREFIXES:
        out += [F.when(c.startswith(a), F.concat(F.lit(b), F.substring(c, len(a) + 1, 1 << 20))), F.when(c.startswith(b), F.concat(F.lit(a), F.substring(c, len(b) + 1, 1 << 20)))]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def digit_slips(c: Column, swaps_only: bool = False) -> Column:
    """All codes one wrong digit, or one swap of neighbours, from a five-digit code."""
    swap = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, F.lit(5))))
    if swaps_only:
        return F.array_remove(F.array_distinct(swap), c)
    one = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.substring(c, F.lit(1), i - 1), d.cast("string"), F.substring(c, i + 1, F.lit(5))))))
    return F.array_remove(F.array_distinct(F.concat(one, swap)), c)


def one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours apart (X6): levenshtein 1, or equal after one swap."""
    at = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))), F.lit(1))
    swapped = F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + 1, F.lit(1)), F.substring(a, at, F.lit(1)), F.substring(a, at + 2, F.length(a)))
    return (F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & (a != b) & (swapped == b))


def classify(c: Column, rules: list[tuple[str, str]], default: str = "unclassified") -> Column:
    """The first rule (label, pattern) that a text matches (X11 to X13): rules are data."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(label)) for label, p in rules), F.lit(default))


def labels(c: Column, rules: list[tuple[str, str]]) -> Column:
    """All labels whose pattern a text matches (X11)."""
    return F.filter(F.array(*(F.when(c.rlike(p), F.lit(label)) for label, p in rules)), lambda x: x.isNotNull())


def screen(c: Column, blank: str, keep: str) -> Column:
    """Whether a text matches ``keep`` after what matches ``blank`` is taken out (F16)."""
    return F.regexp_replace(c, blank, " ").rlike(keep)


def cut_parts(c: Column, sep: str = "; ", most: int = 200) -> Column:
    """Whole parts up to a length."""
    return F.aggregate(F.split(c, sep), F.lit(""), lambda out, x: F.when(out == "", F.substring(x, 1, most)).when(F.length(out) + len(sep) + F.length(x) <= most, F.concat(out, F.lit(sep), x)).otherwise(out))


def bucket(c: Column, broad: float = 100, limited: float = 20, few: float = 1) -> Column:
    """broad, limited, few or none; null stays null (P5)."""
    return F.when(c >= broad, "broad").when(c >= limited, "limited").when(c >= few, "few").when(c.isNotNull(), "none")


def both(a: Column, b: Column) -> Column:
    """AND that is null if either side is."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def non_crossing(mi: Column, *bounds: int) -> Column:
    """Whole miles that don't round down onto a bound which the distance is beyond."""
    r = F.floor(mi + 0.5)
    out = r
    for t in bounds:
        out = F.when((mi > t) & (r <= t), F.lit(t + 1)).otherwise(out)
    return out


def search_score(c: Column, asked: str, surname: bool = False) -> Column:
    """Points of a text for a search (M14): 6 for each asked word that it has, 4 for one that begins a word, 1 for a part, 10
    more if it is the same, and for names of people 12 more if its last word is the last one asked."""
    name = norm(c)
    words = F.split(name, " ")
    out = F.when(name == asked, 10).otherwise(0)
    for t in asked.split():
        out = out + F.when(F.array_contains(words, t), 6).when(F.contains(F.concat(F.lit(" "), name), F.lit(" " + t)), 4).when(F.contains(name, F.lit(t)), 1).otherwise(0)
    if surname and asked.split():
        out = out + F.when(F.element_at(words, -1) == asked.split()[-1], 12).otherwise(0)
    return out
