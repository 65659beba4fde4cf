"""Typed tables for structured queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

NUMBERS, KINDS = ("integer", "number"), ("string", "integer", "number", "boolean", "array", "date")


@dataclass(frozen=True)
class Field:
    """A path of a table: its kind, and what a query may do with it."""

    path: str
    kind: str = "string"
    unit: str = ""
    groupable: bool = False
    enum: tuple = ()
    state: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.path}: {self.kind}")


@dataclass(frozen=True)
class Table:
    """Fields of a table, those of every result, the weight of its rows, and where its rows come from."""

    name: str
    fields: tuple[Field, ...]
    base: tuple[str, ...] = ("id", "name")
    default: tuple[str, ...] = ()
    weight: str | None = None
    source: str = ""
    #: Tables whose rows stand beside those of a comparison: (table, own field that has their id; empty: all rows).
    references: tuple[tuple[str, str], ...] = ()
    #: Related rows of a profile: (name, table, own field, their field); either may be a list.
    relations: tuple[tuple[str, str, str, str], ...] = ()
    by_path: dict = field(init=False, compare=False, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "by_path", {f.path: f for f in self.fields})

    def schema(self) -> T.StructType:
        """Spark types with unit, enum and groupable as metadata; no type is ever inferred."""
        kinds = {"string": T.StringType(), "date": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}
        return T.StructType([T.StructField(f.path, kinds[f.kind], True, {"unit": f.unit, "groupable": f.groupable, "enum": list(f.enum)}) for f in self.fields])


def distance(a: str, b: str, most: int = 99) -> int:
    """Edits with transpositions of neighbours, up to ``most`` + 1."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        rows.append(row)
        if min(row) > most:
            return most + 1
    return rows[-1][-1]


def nearest(table: Table, path: str, n: int = 12) -> list[str]:
    """Fields like a path: those that hold it or that it holds, then by edits."""
    key = path.lower()
    return sorted(table.by_path, key=lambda p: (not (key in p.lower() or p.lower() in key), distance(key, p.lower()), p))[:n]
