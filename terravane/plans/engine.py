"""The tools of the query engine: query, aggregate, profile, compare, places, items, topics and named methods (M1 to M9)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import items as item_tool
from . import library, places
from .catalog import NUMBERS, Table
from .compiler import QueryError, compile_where, find

STATS = ("count", "count_not_null", "sum", "mean", "weighted_mean", "median", "min", "max", "share_true", "share_eq")
LIMIT, MOST = 20, 50


def order_columns(table: Table, order_by) -> tuple[list[Column], list[str]]:
    """Sort keys, nulls last either way, descending unless told, then weight and name."""
    keys, named = [], []
    for x in order_by if isinstance(order_by, list) else [order_by] if order_by else []:
        path, way = (x, "desc") if isinstance(x, str) else (x.get("field"), x.get("dir", "desc"))
        find(table, path)
        named.append(path)
        keys.append(F.col(path).asc_nulls_last() if way == "asc" else F.col(path).desc_nulls_last())
    if table.weight:
        keys.append(F.coalesce(F.col(table.weight), F.lit(0)).desc())
    keys += [F.col(c).asc_nulls_last() for c in ("name", "id") if c in table.by_path]
    return keys, named


def clamp(limit, default: int = LIMIT, most: int = MOST) -> int:
    """A limit of 1 to ``most``; anything else is the default."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        return default
    return min(n, most) if n >= 1 else default


def query_frame(table: Table, df: DataFrame, spec: dict, states=None, limited: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows of the answer, one row of its counts, columns) of a query.

    Both are lazy: one sort with a limit, and one pass of conditional counts (count, in_scope, nulls by
    field within the scope, sum of weight).
    """
    w = compile_where(table, spec.get("where"), states)
    keys, ordered = order_columns(table, spec.get("order_by"))
    wanted = spec.get("columns") or list(table.default)
    for c in wanted:
        find(table, c)
    columns = list(dict.fromkeys([*table.base, *wanted, *w.fields, *ordered]))
    rows = df.where(w.predicate).orderBy(*keys).select(*(F.col(c).alias(c) for c in columns))
    rows = rows.limit(clamp(spec.get("limit"))) if limited else rows
    weigh = F.sum(F.when(w.predicate, F.col(table.weight))) if table.weight else F.lit(None).cast("double")
    counts = df.agg(
        F.count(F.when(w.predicate, 1)).alias("count"),
        F.count(F.when(w.scope, 1)).alias("in_scope"),
        weigh.alias("sum_weight_matching"),
        *(F.count(F.when(w.scope & F.col(f).isNull(), 1)).alias(f"nulls_{f}") for f in dict.fromkeys([*w.fields, *ordered])),
    )
    return rows, counts, columns


def rounded(c: Column, stat: str) -> Column:
    """As figures are told: sums, means and shares to one decimal, halves up; counts, medians and extremes as they are."""
    return F.floor(c * 10 + 0.5) / 10 if stat in ("sum", "mean", "weighted_mean", "share_true", "share_eq") else c


def measure(table: Table, m: dict) -> tuple[str, Column]:
    """(name, aggregate) of a measure; results are unrounded."""
    stat, path = m.get("stat"), m.get("field")
    if stat not in STATS:
        raise QueryError(f"no statistic {stat!r}", list(STATS))
    if path is None and stat != "count":
        raise QueryError(f"{stat} needs a field")
    f = find(table, path) if path is not None else None
    name = f"{path or '*'}:{stat}"
    if stat == "count":
        return name, F.count(F.lit(1))
    c = F.col(path)
    if stat == "count_not_null":
        return name, F.count(c)
    if stat == "share_true":
        return name, 100 * F.avg(c.cast("boolean").cast("int"))
    if stat == "share_eq":
        if "value" not in m:
            raise QueryError("share_eq needs a value")
        eq = (F.lower(c.cast("string")) == str(m["value"]).lower()) if f.kind not in NUMBERS else c == float(m["value"])
        return name, 100 * F.avg(eq.cast("int"))
    if f.kind not in NUMBERS:
        raise QueryError(f"{stat} needs numbers; {path} is {f.kind}")
    if stat == "weighted_mean":
        by = m.get("weight") or table.weight
        if not by:
            raise QueryError("weighted_mean needs a weight")
        find(table, by)
        ok = c.isNotNull() & (F.col(by) > 0)
        return name, F.try_divide(F.sum(F.when(ok, c * F.col(by))), F.sum(F.when(ok, F.col(by))))
    return name, {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[stat](c)


def aggregate_frame(table: Table, df: DataFrame, spec: dict, states=None, told: bool = False) -> DataFrame:
    """Groups (group, n, sum_weight, measures) in order, the null group last. No row gives no group, also ungrouped.

    With told, measures are rounded as ``rounded`` does.
    """
    w = compile_where(table, spec.get("where"), states)
    by = spec.get("group_by")
    if by is not None and not find(table, by).groupable:
        raise QueryError(f"{by} isn't for grouping", [f.path for f in table.fields if f.groupable])
    asked = spec.get("measures") or [{"stat": "count"}]
    own = [(n, rounded(c, m["stat"]) if told else c) for m in asked for n, c in [measure(table, m)]]
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(table.weight).alias("sum_weight")] if table.weight else []), *(c.alias(n) for n, c in own)]
    rows = df.where(w.predicate)
    if by is None:
        return rows.agg(*aggs).where("n > 0").select(F.lit(None).cast("string").alias("group"), "*")
    return rows.groupBy(F.col(by).alias("group")).agg(*aggs).orderBy(F.col("group").asc_nulls_last())


def size_of(answer) -> int:
    return len(json.dumps(answer, default=str).encode())


def fitted(answer: dict, most: int = 22_000) -> dict:
    """An answer cut to so many bytes (T7): its longest list is halved until it fits, and what was cut is told."""

    def lists(x):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            if isinstance(v, list) and len(v) > 1:
                yield size_of(v), x, k
            if isinstance(v, (dict, list)):
                yield from lists(v)

    while size_of(answer) > most:
        found = max(lists(answer), key=lambda t: t[0], default=None)
        if found is None:
            break
        _, holder, k = found
        before = len(holder[k])
        holder[k] = holder[k][: before // 2]
        if isinstance(holder, dict):
            holder["truncated"] = f"{k} cut to {before // 2}"
    return answer


WORDS = {"=": "is", "!=": "isn't", ">": "is over", ">=": "is at least", "<": "is under", "<=": "is at most", "in": "is one of", "not_in": "is none of", "is_null": "is unknown", "not_null": "is known", "contains": "has the text", "includes": "includes", "intersects": "has any of", "between": "is between"}


def explained(tool: str, spec: dict) -> str:
    """A call in plain English (M9)."""

    def condition(c) -> str:
        if "any_of" in c:
            return "(" + " or ".join(map(condition, c["any_of"])) + ")"
        v = c.get("value")
        value = v["field"] if isinstance(v, dict) else " and ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v)
        return f"{c.get('field')} {WORDS.get(c.get('op', '='), c.get('op'))} {value}".strip()

    where = spec.get("where") or []
    where = [where] if isinstance(where, dict) else where
    out = {"query": "Rows of", "aggregate": "Figures of", "profile": "All about", "compare": "Side by side in"}.get(tool, tool) + f" {spec.get('table', '')}".rstrip()
    out += f" {spec['id']}" if "id" in spec else ""
    out += f": {', '.join(map(str, spec['ids']))}" if "ids" in spec else ""
    out += " where " + " and ".join(map(condition, where)) if where else ""
    if spec.get("measures"):
        out += ": " + ", ".join(f"{m.get('stat')} of {m.get('field') or 'rows'}" for m in spec["measures"])
    out += f" by {spec['group_by']}" if spec.get("group_by") else ""
    order = spec.get("order_by") or []
    for x in order if isinstance(order, list) else [order]:
        field, way = (x, "desc") if isinstance(x, str) else (x.get("field"), x.get("dir", "desc"))
        out += f", {'lowest' if way == 'asc' else 'highest'} {field} first"
    return out + (f", the first {clamp(spec.get('limit'))}" if tool == "query" else "") + "."


class Engine:
    """Tables and tools; answers are dictionaries, errors come with a hint and are never raised.

    Only the rows of an answer (50 at most; of groups 1,000) and one row of counts come to the driver. Results stay
    known by call number, as lazy frames.
    """

    TOOLS = ("query", "aggregate", "profile", "compare", "find_places", "trials", "site_info", "method")
    MOST_GROUPS = 1_000

    def __init__(self, states: dict[str, str] | None = None, choices: dict[str, list[str]] | None = None):
        """states: code by lower-case name or code; choices: allowed values of methods' parameters."""
        self.tables: dict[str, tuple[Table, DataFrame]] = {}
        self.states, self.calls, self.methods = states or {}, {}, {}
        self.ranked: dict[int, list | None] = {}
        self.library, self.choices, self.topics = dict(library.METHODS), choices or {}, {}
        self.places, self.items = None, None

    def with_places(self, frame: DataFrame) -> None:
        """Places to search, as of ``places.index``."""
        self.places = places.index(frame)

    def with_items(self, frame: DataFrame, where: DataFrame, near: DataFrame, phases: list[str], groups: list[str]) -> None:
        """Items such as trials, as of ``items``."""
        self.items = frame, where, near, phases, groups

    def topic(self, name: str, title: str, text: str, numbers: Callable | None = None) -> None:
        """A text about the site, with figures that ``numbers`` (of this engine) reads when asked (M7)."""
        self.topics[name] = title, text, numbers

    def register(self, table: Table, df: DataFrame) -> None:
        self.tables[table.name] = table, df

    def method(self, name: str, **params: Callable):
        """Decorator: a named query, a function of (engine, params, previous answers) for each step."""

        def keep(f):
            self.methods[name] = params, f
            return f

        return keep

    def _table(self, spec: dict) -> tuple[Table, DataFrame]:
        if spec.get("table") not in self.tables:
            raise QueryError(f"no table {spec.get('table')!r}", sorted(self.tables))
        return self.tables[spec["table"]]

    def run(self, tool: str, spec: dict) -> dict:
        try:
            if tool not in self.TOOLS:
                raise QueryError(f"no tool {tool!r}", list(self.TOOLS))
            return getattr(self, f"_{tool}")(spec)
        except QueryError as e:
            return e.as_dict()

    def highlighted(self, call: int) -> DataFrame:
        """(id) of what a call's answer is about (T4): the rows told of a ranking, all matching rows of a filter."""
        if call not in self.calls:
            raise QueryError(f"no call {call}", sorted(self.calls))
        ids = self.calls[call].select("id")
        return ids if self.ranked[call] is None else ids.where(F.col("id").isin(self.ranked[call]))

    def _find_places(self, spec: dict) -> dict:
        if self.places is None:
            raise QueryError("no places are known")
        return places.find(self.places, str(spec.get("query") or ""), self.states, spec.get("kind"), spec.get("state"), clamp(spec.get("limit"), 10, 10))

    def _trials(self, spec: dict) -> dict:
        if self.items is None:
            raise QueryError("no items are known")
        frame, where, near, phases, groups = self.items
        return item_tool.ask(frame, where, near, spec, phases, groups)

    def _site_info(self, spec: dict) -> dict:
        if spec.get("topic") not in self.topics:
            raise QueryError(f"no topic {spec.get('topic')!r}", sorted(self.topics))
        title, text, numbers = self.topics[spec["topic"]]
        return {"topic": spec["topic"], "title": title, "text": text} | ({"numbers": numbers(self)} if numbers else {})

    def _query(self, spec: dict) -> dict:
        table, df = self._table(spec)
        rows, counts, columns = query_frame(table, df, spec, self.states)
        w = compile_where(table, spec.get("where"), self.states)
        got, c = [r.asDict(True) for r in rows.collect()], counts.head().asDict()
        self.calls[len(self.calls) + 1] = query_frame(table, df, spec, self.states, limited=False)[0]
        self.ranked[len(self.calls)] = [r["id"] for r in got if "id" in r] if spec.get("order_by") else None
        out = {"table": table.name, "call": len(self.calls), "count": c["count"], "in_scope": c["in_scope"], "returned": len(got), "columns": columns, "rows": got, "nulls": {k[6:]: v for k, v in c.items() if k.startswith("nulls_")}, "ids_truncated": c["count"] > len(got), "sum_weight_matching": c["sum_weight_matching"], "source": table.source}
        return out | ({"warnings": w.warnings} if w.warnings else {})

    def _aggregate(self, spec: dict) -> dict:
        table, df = self._table(spec)
        groups = [r.asDict(True) for r in aggregate_frame(table, df, spec, self.states, told=bool(spec.get("rounded"))).limit(self.MOST_GROUPS + 1).collect()]
        if len(groups) > self.MOST_GROUPS:
            raise QueryError(f"{spec.get('group_by')} has over {self.MOST_GROUPS} values", [f.path for f in table.fields if f.groupable])
        own = {"group", "n", "sum_weight"}
        return {"table": table.name, "count": sum(g["n"] for g in groups), "group_by": spec.get("group_by"), "groups": [{k: v for k, v in g.items() if k in own} | {"measures": {k: v for k, v in g.items() if k not in own}} for g in groups], "source": table.source}

    def _row(self, table: Table, df: DataFrame, key) -> dict:
        """A row by id: as given, upper case, padded to five digits, a whole state's district as XX-AL; by geoid, or by name."""
        text = str(key).strip()
        keys = list(dict.fromkeys([text, text.upper(), text.zfill(5), text.upper().replace("-AL", "-00")]))
        hit = F.col("id").isin(keys) | (F.lower("name") == text.lower())
        geoid = F.col("geoid").isin(keys) if "geoid" in table.by_path else F.lit(False)
        rank = F.when(F.col("id").isin(keys), 0).when(geoid, 1).otherwise(2)
        row = df.where(hit | geoid).orderBy(rank, "id").head()
        if row is None:
            raise QueryError(f"no {key!r} in {table.name}")
        return row.asDict(True)

    def _related(self, table: Table, row: dict) -> dict:
        """Rows of other tables, by their ``<table>_id`` or as the table's relations tell."""
        plan = [(name, name, "id", f"{table.name}_id") for name, (other, _) in self.tables.items() if f"{table.name}_id" in other.by_path]
        out = {}
        for name, other_name, own, theirs in (*plan, *table.relations):
            if other_name not in self.tables:
                continue
            other, rows = self.tables[other_name]
            value = row.get(own) if own else None
            if own and value in (None, []):
                out[name] = []
                continue
            if not own:
                hit = F.lit(True)
            elif other.by_path[theirs].kind == "array":
                hit = F.arrays_overlap(F.col(theirs), F.array(*map(F.lit, value if isinstance(value, list) else [value])))
            else:
                hit = F.col(theirs).isin(value if isinstance(value, list) else [value])
            columns = dict.fromkeys([*other.base, *other.default])
            out[name] = [r.asDict(True) for r in rows.where(hit).orderBy("id").select(*(F.col(c).alias(c) for c in columns)).limit(MOST).collect()]
        return out

    def _profile(self, spec: dict) -> dict:
        table, df = self._table(spec)
        row = self._row(table, df, spec.get("id"))
        return {"table": table.name, "row": row, "related": self._related(table, row), "source": table.source}

    def _compare(self, spec: dict) -> dict:
        table, df = self._table(spec)
        ids = spec.get("ids") or []
        if not isinstance(ids, list) or not 2 <= len(ids) <= 6:
            raise QueryError("compare takes 2 to 6 ids")
        for c in spec.get("columns") or []:
            find(table, c)
        columns = list(dict.fromkeys([*table.base, *(spec.get("columns") or table.default)]))
        rows = [self._row(table, df, i) for i in ids]
        reference: list[dict] = []
        for name, own in table.references:  # the rows' states, the nation (J18)
            if name in self.tables:
                other, frame = self.tables[name]
                wanted = list(dict.fromkeys(r[own] for r in rows if r.get(own) is not None)) if own else []
                kept = [c for c in columns if c in other.by_path]
                found = frame.where(F.col("id").isin(wanted)) if own else frame
                reference += [{"table": name} | r.asDict(True) for r in found.orderBy("id").select(*(F.col(c).alias(c) for c in kept)).limit(MOST).collect()]
        value = lambda r, path: r if not path or r is None else value(r.get(path[0]), path[1:])
        told = [{c: value(r, c.split(".")) if c not in r else r[c] for c in columns} for r in rows]
        return {"table": table.name, "columns": columns, "rows": told, "reference": reference, "source": table.source}

    def _method(self, spec: dict) -> dict:
        if spec.get("name") in self.library:
            own = self.library[spec["name"]]
            params = library.checked(own, spec["name"], spec.get("params") or {}, self.states, self.choices)
            results = library.run(own, params, self.run)
            return fitted({"method": spec["name"], "title": own.title, "params": params, "results": results})
        if spec.get("name") not in self.methods:
            raise QueryError(f"no method {spec.get('name')!r}", sorted([*self.methods, *self.library]))
        checks, steps = self.methods[spec["name"]]
        params = spec.get("params") or {}
        for name, check in checks.items():
            if name not in params or not check(params[name]):
                raise QueryError(f"{spec['name']} needs a valid {name}")
        results: list[dict] = []
        for tool, make in steps:
            results.append(self.run(tool, make(params, results)))
            if "error" in results[-1]:
                return results[-1]
        return {"method": spec["name"], "results": results}
