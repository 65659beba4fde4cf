"""JSON conditions to Column predicates, with loose equality by the field's kind."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import NUMBERS, Field, Table, nearest

OPS = ("=", "!=", ">", ">=", "<", "<=", "in", "not_in", "is_null", "not_null", "contains", "includes", "intersects", "between")


class QueryError(ValueError):
    """A request that can't be met, with a hint."""

    def __init__(self, message: str, hint=None):
        super().__init__(message)
        self.hint = hint

    def as_dict(self) -> dict:
        return {"error": str(self), "hint": self.hint}


@dataclass
class Where:
    """A compiled filter: the predicate, its part that sets the scope, the fields it names, and warnings."""

    predicate: Column
    scope: Column
    fields: list[str]
    warnings: list[str]


def find(table: Table, path) -> Field:
    if path not in table.by_path:
        raise QueryError(f"no field {path!r} in {table.name}", nearest(table, str(path)))
    return table.by_path[path]


def _literal(f: Field, value):
    """A value as the field's kind, or None where it can't be compared."""
    try:
        if f.kind in NUMBERS:
            return float(value) if not isinstance(value, bool) else None
        if f.kind == "boolean":
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
    except (TypeError, ValueError):
        return None
    return str(value).lower() if not isinstance(value, bool) else str(value).lower()


def _typed(f: Field) -> Column:
    c = F.col(f.path)
    return c if f.kind in (*NUMBERS, "boolean") else F.lower(c) if f.kind != "array" else F.transform(c, F.lower)


def _equal(f: Field, value) -> Column:
    """False where the two can't be compared; a list is no scalar."""
    v = None if f.kind == "array" else _literal(f, value)
    return F.lit(False) if v is None else _typed(f) == F.lit(v)


def _sort_of(f: Field) -> str:
    return "number" if f.kind in NUMBERS else "text" if f.kind in ("string", "date") else f.kind


def _two_columns(f: Field, other: Field, op: str) -> Column:
    """Columns of one sort compare as they are; a number and a text as numbers where the text is one, else they don't."""
    kinds = {_sort_of(f), _sort_of(other)}
    if "array" in kinds or len(kinds) == 2 and kinds != {"number", "text"}:
        return F.lit(op == "!=") & F.col(f.path).isNotNull() & F.col(other.path).isNotNull()
    a, b = (_typed(x).try_cast("double") if len(kinds) == 2 else _typed(x) for x in (f, other))
    if op == "!=":
        return F.col(f.path).isNotNull() & F.col(other.path).isNotNull() & ~F.coalesce(a == b, F.lit(False))
    return {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _condition(table: Table, node: dict, states: dict[str, str], fields: list[str], warnings: list[str]) -> Column:
    f, op = find(table, node.get("field")), node.get("op", "=")
    if op not in OPS:
        raise QueryError(f"no operator {op!r}", list(OPS))
    fields.append(f.path)
    c, value = F.col(f.path), node.get("value")
    if op == "=" and "value" in node and value is None:
        op = "is_null"
    if op in ("is_null", "not_null"):
        return c.isNull() if op == "is_null" else c.isNotNull()
    if "value" not in node or value is None:
        raise QueryError(f"{op} on {f.path} needs a value")
    if isinstance(value, dict):  # another column
        other = find(table, value.get("field"))
        fields.append(other.path)
        if op not in ("=", "!=", ">", ">=", "<", "<="):
            raise QueryError(f"{op} doesn't compare columns", ["=", "!=", ">", ">=", "<", "<="])
        return _two_columns(f, other, op)
    if f.state:
        fix = lambda v: states.get(str(v).lower(), v)
        value = [fix(v) for v in value] if isinstance(value, list) else fix(value)
    if f.enum and op in ("=", "!=", "in", "not_in"):
        known = {str(x).lower() for x in f.enum}
        warnings += [f"{v!r} is no value of {f.path}" for v in (value if isinstance(value, list) else [value]) if str(v).lower() not in known]
    if op in ("=", "!="):
        return _equal(f, value) if op == "=" else c.isNotNull() & ~_equal(f, value)
    if op in ("in", "not_in"):
        any_of = reduce(or_, (_equal(f, v) for v in (value if isinstance(value, list) else [value])), F.lit(False))
        return any_of if op == "in" else c.isNotNull() & ~any_of
    if op == "contains":
        part = F.lit(str(value).lower())
        return F.exists(c, lambda x: F.contains(F.lower(x), part)) if f.kind == "array" else F.contains(F.lower(c.cast("string")), part)
    if op in ("includes", "intersects"):
        if f.kind != "array":
            raise QueryError(f"{op} is for lists; {f.path} is none")
        own = [str(v).lower() for v in (value if isinstance(value, list) else [value])]
        return F.arrays_overlap(_typed(f), F.array(*map(F.lit, own))) if own else F.lit(False)
    bounds = value if op == "between" else [value]
    if op == "between" and not (isinstance(value, list) and len(value) == 2):
        raise QueryError("between needs two values")
    own = [None if f.kind == "array" else _literal(f, v) for v in bounds]
    if None in own:
        return F.lit(False)
    a = _typed(f)
    return a.between(*own) if op == "between" else {">": a > own[0], ">=": a >= own[0], "<": a < own[0], "<=": a <= own[0]}[op]


def compile_where(table: Table, where, states: dict[str, str] | None = None) -> Where:
    """An AND-list of conditions and ``any_of`` lists (two deep), or one bare condition.

    Comparisons with null are false, and so is ``!=``. The scope is set by top-level ``=`` and ``in`` on
    state fields.
    """
    nodes = [where] if isinstance(where, dict) else list(where or [])
    fields: list[str] = []
    warnings: list[str] = []

    def tree(node, depth: int) -> Column:
        if not isinstance(node, dict):
            raise QueryError("a condition is an object with field, op and value")
        if "any_of" in node:
            if depth >= 2:
                raise QueryError("any_of nests two deep at most")
            return reduce(or_, (tree(x, depth + 1) for x in node["any_of"]), F.lit(False))
        return F.coalesce(_condition(table, node, states or {}, fields, warnings), F.lit(False))

    predicates = [tree(n, 0) for n in nodes]
    scoped = [p for p, n in zip(predicates, nodes) if "any_of" not in n and table.by_path[n["field"]].state and n.get("op", "=") in ("=", "in") and not isinstance(n.get("value"), dict)]
    return Where(reduce(and_, predicates, F.lit(True)), reduce(and_, scoped, F.lit(True)), list(dict.fromkeys(fields)), warnings)
