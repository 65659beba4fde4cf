"""The engine's tools: methods of the library, places, items, topics, comparisons, errors and limits."""

import pytest

from terravane.plans import library, places
from terravane.plans.catalog import Field, Table
from terravane.plans.compiler import QueryError
from terravane.plans.engine import Engine, explained, fitted, size_of

STATES = {"texas": "TX", "tx": "TX", "ohio": "OH", "oh": "OH"}
#: All fields that methods name, by table: kind from the name.
KINDS = {"pop55": "number", "date": "string", "bill": "string", "party": "string", "role": "string", "district_id": "string", "full_name": "string", "tier": "string", "nearest_nci": "string", "s4440": "string", "cosponsor_date": "string", "member.name": "string", "member.party": "string", "member.ctma_hr3521": "string", "high_incidence_low_access": "boolean", "high_deaths_low_access": "boolean", "districts": "array"}


def _fields():
    """By table: the fields that the library's templates name."""
    out = {}

    def names(x, p):
        x = library.filled(x, p)
        for c in [*x.get("columns", []), *(w["field"] for w in x.get("where", []) if isinstance(w, dict)), *(o["field"] for o in x.get("order_by", []))]:
            if isinstance(x.get("table"), str):
                out.setdefault(x["table"], {})[c] = None

    for m in library.METHODS.values():
        for measure in library.MEASURES:
            p = library.derived({"measure": measure, "state": "TX", "cancer_type": "lung", "site": "all", "place": "US", "county": "48215", "district": "TX-34"})
            for c in m.calls:
                names(c["spec"], p)
    return out


@pytest.fixture(scope="module")
def engine(spark):
    own = Engine(STATES, {"cancer_type": ["lung"], "site": ["all", "lung"]})
    ids = {"counties": ["48215", "48201", "39035"], "districts": ["TX-34", "TX-00", "OH-01"], "states": ["TX", "OH"], "national": ["US"], "cosponsors": ["a", "b"], "senators": ["s1", "s2"], "nci_centers": ["c1"]}
    for table, fields in _fields().items():
        kinds = {f: KINDS.get(f, "number") for f in fields} | {"id": "string", "name": "string", "state": "string", "pop55": "number"}
        kinds.pop("oncologists.class", None)
        if table == "counties":
            kinds["oncologists.class"] = "integer"
        flat = {f: k for f, k in kinds.items() if "." not in f}
        nested = {}
        for f, k in kinds.items():
            if "." in f:
                nested.setdefault(f.split(".")[0], []).append((f.split(".", 1)[1], k))
        rows = []
        for i, key in enumerate(ids[table]):
            state = key[:2] if table in ("states", "districts") else "OH" if key.startswith("39") else "TX"
            row = {f: {"string": "ctma_hr" if f == "bill" else f"{f}{i}", "number": 60.0 + 50 * i, "integer": 2, "boolean": True, "array": ["TX-34"]}[k] for f, k in flat.items()}
            row |= {"id": key, "name": f"name {key}", "state": state, "pop55": 10.0 - i}
            row["trials_within_60rdmi_of_center"] = 0.0
            rows.append(row)
        flat.setdefault("trials_within_60rdmi_of_center", "number")
        kind = {"string": "string", "number": "double", "integer": "int", "boolean": "boolean", "array": "array<string>"}
        df = spark.createDataFrame([tuple(r[f] for f in flat) for r in rows], ", ".join(f"{f} {kind[k]}" for f, k in flat.items()))
        for top, subs in nested.items():
            inner = [g for g, _ in subs]
            deep = {g.split(".")[0] for g in inner if "." in g}
            cells = [f"'{g}', cast({2 if k == 'integer' else chr(39) + 'm' + chr(39) if k == 'string' else 'pop55'} as {kind[k]})" for g, k in subs if "." not in g]
            cells += [f"'{t}', named_struct({', '.join(f'{chr(39)}{g.split(chr(46), 1)[1]}{chr(39)}, cast(pop55 as double)' for g in inner if g.startswith(t + '.'))})" for t in deep]
            df = df.selectExpr("*", f"named_struct({', '.join(cells)}) as {top}")
        fields = tuple(Field(f, k, groupable=f == "party", state=f == "state") for f, k in (kinds | flat).items())
        refs = {"counties": (("states", "state"), ("national", "")), "districts": (("states", "state"), ("national", "")), "states": (("national", ""),)}.get(table, ())
        relations = (("districts_here", "districts", "districts", "id"), ("nation", "national", "", "id")) if table == "counties" else ()
        own.register(Table(table, fields, base=("id", "name"), weight="pop55", references=refs, relations=relations), df)
    own.with_places(spark.createDataFrame([("county", "counties", "48215", "Hidalgo", "TX", 10.0), ("county", "counties", "35023", "Hidalgo", "NM", 1.0), ("town", "counties", "48201", "Houston", "TX", 500.0), ("county", "counties", "48225", "Houston", "TX", 9.0), ("state", "states", "TX", "Texas", "TX", 900.0), ("zip", "counties", "48215", "78501", "TX", 0.0)], "kind string, table string, id string, name string, state string, score double"))
    items = spark.createDataFrame([("n1", "a", "x", "3", "ind", ["lung"], "lung", 18.0, "2024-01-02"), ("n2", "b", "y", "1", "aca", ["lung", "multi"], "lung", None, "2024-03-01"), ("n3", "c", "lungs", "3", "ind", ["multi"], "multi", 60.0, None)], "id string, title string, text string, phase string, group string, labels array<string>, primary string, least_age double, updated string")
    where = spark.createDataFrame([("n1", "48215", "TX"), ("n2", "48201", "TX"), ("n3", "39035", "OH"), ("n1", "39035", "OH")], "id string, area string, state string")
    own.with_items(items, where, spark.createDataFrame([("48215", "n2")], "area string, id string"), ["1", "2", "3"], ["aca", "ind"])
    own.topic("bills", "Bills", "text", lambda e: {"tables": len(e.tables)})
    return own


PARAMS = {"state": "texas", "county": "48215", "district": "TX 34", "place": "48215", "query": "78501", "cancer_type": "lung", "measure": "none", "n": 2, "site": "all", "phase": "3"}


@pytest.mark.parametrize("name", sorted(library.METHODS))
def test_methods(engine, name):
    own = library.METHODS[name]
    for given in (own.needs, (*own.needs, *own.takes)):
        got = engine.run("method", {"name": name, "params": {k: PARAMS[k] for k in given}})
        assert got.get("results") and all("error" not in r for r in got["results"]), got


def test_method_results_and_errors(engine):
    got = engine.run("method", {"name": "counties_worst_access", "params": {"state": "TX"}})
    assert [r["id"] for r in got["results"][0]["rows"]] == ["48201", "48215"]
    best = engine.run("method", {"name": "counties_best_access", "params": {}})
    assert [r["id"] for r in best["results"][0]["rows"]] == ["48215", "48201", "39035"]
    found = engine.run("method", {"name": "my_representative", "params": {"query": "78501"}})
    assert [r.get("table") for r in found["results"]] == [None, "counties"] and found["results"][1]["row"]["id"] == "48215"
    for params in ({}, {"state": "nowhere"}, {"state": "TX", "x": 1}):
        assert "error" in engine.run("method", {"name": "need_vs_access_state", "params": params})
    assert "error" in engine.run("method", {"name": "none", "params": {}})
    assert len(library.METHODS) == 32 or len(library.METHODS) == 31


def test_places(engine, spark):
    find = lambda q, **k: engine.run("find_places", {"query": q} | k)
    assert find("Hidalgo")["ambiguous"] and [m["id"] for m in find("Hidalgo County, Texas")["matches"]] == ["48215"]
    assert find("Houston")["matches"][0]["kind"] == "town" and not find("Houston")["ambiguous"]
    assert [m["id"] for m in find("Houston", kind="county")["matches"]] == ["48225"]
    assert find("Texas")["matches"][0]["id"] == "TX" and find("78501")["matches"][0]["id"] == "48215"
    assert {m["how"] for m in find("Hidlago TX")["matches"]} == {"misspelt"} and find("zzzz")["matches"] == []
    assert "error" in find("  ")
    assert places.read_question("Hidalgo tx", STATES)[1] is None and places.read_question("Hidalgo TX", STATES)[1] == "TX"


def test_items(engine):
    ask = lambda **k: engine.run("trials", k)
    got = ask(scope={"state": "tx"})
    assert (got["count"], got["in_scope"], got["by_phase"], got["by_label"]) == (2, 2, {"1": 1, "2": 0, "3": 1}, {"lung": 2, "multi": 1})
    assert [r["id"] for r in got["sample"]] == ["n2", "n1"]
    assert ask(scope={"all": True}, label="multi")["count"] == 1 and ask(scope="us", label="lung")["count"] == 2
    assert ask(scope={"near_area": "48215"})["count"] == 1 and ask(scope="48215", phase="Phase 3", group="IND", keyword="X")["count"] == 1
    assert ask(scope={"all": True}, least_age_at_most=30)["count"] == 2
    assert "error" in ask(scope={"x": 1}) and "error" in ask(scope={"all": True}, colour=1)


def test_profile_compare_topics(engine):
    got = engine.run("profile", {"table": "districts", "id": "tx-al"})
    assert got["row"]["id"] == "TX-00"
    related = engine.run("profile", {"table": "counties", "id": "48215"})["related"]
    assert [r["id"] for r in related["districts_here"]] == ["TX-34"] and [r["id"] for r in related["nation"]] == ["US"]
    got = engine.run("compare", {"table": "counties", "ids": ["48215", "39035"]})
    assert [(r["table"], r["id"]) for r in got["reference"]] == [("states", "OH"), ("states", "TX"), ("national", "US")]
    assert engine.run("site_info", {"topic": "bills"})["numbers"]["tables"] == 7 and "error" in engine.run("site_info", {"topic": "x"})
    assert "error" in engine.run("compare", {"table": "counties", "ids": "48215"})


def test_incomparable_is_false_and_never_raises(engine):
    for where in ([{"field": "districts", "op": "=", "value": "TX-34"}], [{"field": "districts", "op": ">", "value": 1}], [{"field": "name", "op": ">", "value": {"field": "pop55"}}], [{"field": "districts", "op": "=", "value": {"field": "name"}}]):
        assert engine.run("query", {"table": "counties", "where": where})["count"] == 0
    assert engine.run("query", {"table": "counties", "where": [{"field": "districts", "op": "!=", "value": {"field": "name"}}]})["count"] == 3


def test_highlighted(engine):
    ranking = engine.run("query", {"table": "counties", "order_by": "pop55", "limit": 1})["call"]
    matching = engine.run("query", {"table": "counties", "where": {"field": "state", "op": "=", "value": "TX"}, "limit": 1})["call"]
    assert [r["id"] for r in engine.highlighted(ranking).collect()] == ["48215"]
    assert {r["id"] for r in engine.highlighted(matching).collect()} == {"48215", "48201"}


def test_fitted_and_explained():
    answer = {"rows": [{"x": "y" * 100} for _ in range(500)], "more": {"list": list(range(50))}}
    assert size_of(fitted(answer, 5_000)) <= 5_000 and answer["truncated"].startswith("rows cut to") and len(answer["more"]["list"]) == 50
    assert fitted({"x": "y" * 100}, 10) == {"x": "y" * 100}
    said = explained("query", {"table": "counties", "where": [{"field": "a", "op": ">=", "value": 5}, {"any_of": [{"field": "b", "op": "is_null"}, {"field": "c", "value": "x"}]}], "order_by": [{"field": "a", "dir": "asc"}], "limit": 3})
    assert said == "Rows of counties where a is at least 5 and (b is unknown or c is x), lowest a first, the first 3."


def test_place_ids():
    assert [library.place_table(x) for x in ("48215", "TX-34", "us", "TX")] == ["counties", "districts", "national", "states"]
    with pytest.raises(QueryError):
        library.place_table("x y")
