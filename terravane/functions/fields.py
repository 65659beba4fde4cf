"""Small derived fields: rates, classes, ids, roundings, dates, lists and maps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero: floor(x + 0.5) at a digit."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale


def bankers(c: Column, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(c, digits)


def rate(n: Column, population: Column, per: int = 100_000, digits: int = 1) -> Column:
    """Cases for so many people; null where nobody lives."""
    return F.when(population > 0, half_up(n * per / population, digits))


def presence(a: Column, b: Column) -> Column:
    """1: both, 2: only a, 3: only b, 4: neither; nulls count as absent."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return F.when(a & b, 1).when(a, 2).when(b, 3).otherwise(4)


def gated(value: Column, status: Column, most: int = 1) -> Column:
    """A value only where its status allows to publish it."""
    return F.when(status <= most, value)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st (P10)."""
    last, teens = n % 10, (n % 100).between(11, 13)
    end = F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def district_id(state: Column, number: Column, whole: tuple[int, ...] = (0, 98)) -> Column:
    """State and two digits; the numbers of ``whole`` mean the whole state and are written 00 (P10)."""
    return F.concat(state, F.lit("-"), F.when(number.isin(*whole), "00").otherwise(F.lpad(number.cast("string"), 2, "0")))


def district_name(name: Column, number: Column, whole: tuple[int, ...] = (0, 98)) -> Column:
    return F.concat(name, F.lit(" "), F.when(number.isin(*whole), "at large").otherwise(ordinal(number)))


def location_key(lat: Column, lon: Column, digits: int = 4) -> Column:
    """Both rounded, as text without trailing zeros."""
    return F.concat_ws(",", half_up(lat, digits).cast("string"), half_up(lon, digits).cast("string"))


def exact_or_share(exact: Column, population: Column, share: Column, close: float = 0.06) -> Column:
    """The exact count where it agrees with the published share, else the share of the population."""
    agrees = (population > 0) & (F.abs(100 * exact / population - share) <= close)
    return F.when(agrees, exact.cast("double")).otherwise(half_up(population * share / 100))


def eligible(max_age: Column, least: float = 55, none: float = 999) -> Column:
    """Whether an upper age limit, where there is one, lets people of ``least`` years in."""
    return F.coalesce(max_age, F.lit(none)) >= least


def matches_pattern(c: Column, pattern: str) -> Column:
    """A flag that is never null: the row stays, whatever it tells."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def day(c: Column) -> Column:
    """The date part of an ISO time as text; null where it isn't one."""
    return F.nullif(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def days_since(c: Column, today: Column) -> Column:
    return F.datediff(F.try_to_timestamp(today).cast("date"), F.try_to_timestamp(day(c)).cast("date"))


def quarter_label(c: Column) -> Column:
    """1998-04-09 as ``1998 Q2``."""
    return F.concat(F.substring(c, 1, 4), F.lit(" Q"), F.floor((F.substring(c, 6, 2).cast("int") + 2) / 3).cast("string"))


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def index_of(c: Column, value) -> Column:
    """Zero-based place in a list, -1 where it isn't there."""
    return F.coalesce(F.array_position(c, value), F.lit(0)) - 1


def zero_filled(counts: Column, keys: list) -> Column:
    """A map with all keys of a domain, 0 where it has none."""
    domain = F.array(*map(F.lit, keys))
    return F.map_from_arrays(domain, F.transform(domain, lambda k: F.coalesce(F.element_at(counts, k), F.lit(0))))


_STEP = re.compile(r"`([^`]+)`|\[(\d+)\]|\[([^=\]]+)=([^\]]*)\]|([^.\[\]`]+)")


def _has(key: str, value: str):
    return lambda x: F.get_json_object(x, f"$['{key}']") == value


def json_path(c: Column, path: str) -> Column:
    """Text at a path of JSON (X24): keys with dots between, keys that have dots in backticks, ``[2]``, ``[key=value]`` (the
    first element that has it), and ``.length`` at the end, of a list or text. Null where the path leads nowhere."""
    steps = [m.groups() for m in _STEP.finditer(path)]
    for i, (quoted, at, key, value, plain) in enumerate(steps):
        if key is not None:
            own = F.from_json(F.when(F.substring(F.ltrim(c), 1, 1) == "[", c), "array<string>")
            c = F.get(F.filter(own, _has(key, value)), F.lit(0))
        elif at is not None:
            c = F.get_json_object(c, f"$[{at}]")
        elif plain == "length" and i == len(steps) - 1 and i:
            c = F.coalesce(F.json_array_length(F.when(F.substring(F.ltrim(c), 1, 1) == "[", c)), F.char_length(c)).cast("string")
        else:
            c = F.get_json_object(c, f"$['{quoted or plain}']")
    return c


#: Number words (fixed values).
NUMBER_WORDS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}


def numbers_in(c: Column) -> Column:
    """Numbers of a text in order, as doubles (X25): digits with commas between thousands, and small number words."""
    words = "|".join(NUMBER_WORDS)
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?|\b(?:{words})\b)"), 1)
    value = F.create_map(*(F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, float(n))))
    return F.transform(found, lambda x: F.coalesce(F.element_at(value, x), F.replace(x, F.lit(","), F.lit("")).try_cast("double")))


def same_number(a: Column, b: Column, digits: int = 3) -> Column:
    """Whether two numbers agree in so many significant digits."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs(a), F.abs(b)))) - digits + 1)
    return F.when((a == 0) & (b == 0), True).otherwise(F.abs(a - b) <= size / 2)
