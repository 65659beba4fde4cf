import pytest

from terravane.plans.catalog import Field, Table, distance
from terravane.plans.engine import Engine, clamp

T = Table("places", (Field("id"), Field("name"), Field("state", groupable=True, state=True), Field("pop", "integer"), Field("rate", "number"), Field("open", "boolean", groupable=True), Field("tags", "array"), Field("kind", enum=("a", "b"))), default=("rate",), weight="pop", source="test")
STATES = {"texas": "TX", "ohio": "OH"}


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("00001", "Ada", "TX", 100, 1.0, True, ["X", "y"], "a"), ("2", "Bo", "TX", 50, None, False, [], "b"), ("3", "Cy", "OH", 70, 3.0, None, ["z"], None), ("4", "Di", None, None, 2.0, True, None, "a")]
    e = Engine(STATES)
    e.register(T, spark.createDataFrame(rows, "id string, name string, state string, pop long, rate double, open boolean, tags array<string>, kind string"))
    e.method("in_state", state=lambda s: s.lower() in STATES)([("query", lambda p, _: {"table": "places", "where": {"field": "state", "op": "=", "value": p["state"]}})])
    return e


def ids(engine, *where, **more):
    return [r["id"] for r in engine.run("query", {"table": "places", "where": list(where), **more})["rows"]]


def c(field, op, *value):
    return {"field": field, "op": op} | ({"value": value[0]} if value else {})


def test_predicates(engine):
    assert ids(engine, c("name", "=", "ADA")) == ["00001"]
    assert ids(engine, c("pop", "=", "50")) == ["2"]
    assert ids(engine, c("open", "=", "true")) == ["00001", "4"]
    assert ids(engine, c("kind", "!=", "a")) == ["2"]
    assert ids(engine, c("state", "=", "Texas")) == ["00001", "2"]
    assert ids(engine, c("state", "not_in", ["ohio"])) == ["00001", "2"]
    assert ids(engine, c("rate", "=", None)) == ["2"] and ids(engine, c("rate", "is_null")) == ["2"]
    assert ids(engine, c("rate", "between", [2, 3])) == ["3", "4"]
    assert ids(engine, c("tags", "includes", "Y")) == ["00001"] and ids(engine, c("tags", "intersects", ["Z", "q"])) == ["3"] and ids(engine, c("tags", "contains", "x")) == ["00001"]
    assert ids(engine, c("pop", ">", {"field": "rate"})) == ["00001", "3"]
    assert ids(engine, {"any_of": [c("name", "=", "bo"), {"any_of": [c("rate", ">", 2.5)]}]}) == ["3", "2"]
    assert ids(engine, c("rate", ">", "many")) == []


def test_order_limit_and_envelope(engine):
    assert ids(engine, order_by=[{"field": "rate"}]) == ["3", "4", "00001", "2"]
    assert ids(engine, order_by=[{"field": "rate", "dir": "asc"}]) == ["00001", "4", "3", "2"]
    out = engine.run("query", {"table": "places", "where": [c("state", "in", ["TX"]), c("rate", ">", 0)], "limit": 1})
    assert (out["count"], out["in_scope"], out["returned"], out["nulls"], out["sum_weight_matching"]) == (1, 2, 1, {"state": 0, "rate": 1}, 100)
    assert (clamp(0), clamp(99), clamp("x"), clamp(7.9)) == (20, 50, 20, 7)
    assert engine.run("query", {"table": "places", "where": c("kind", "=", "q")})["warnings"]


def test_errors_have_hints(engine):
    assert engine.run("query", {"table": "place"})["hint"] == ["places"]
    assert engine.run("query", {"table": "places", "where": c("rat", "=", 1)})["hint"][0] == "rate"
    assert "error" in engine.run("query", {"table": "places", "where": c("rate", "between", [1])})
    assert "error" in engine.run("aggregate", {"table": "places", "group_by": "rate"})
    assert "error" in engine.run("aggregate", {"table": "places", "measures": [{"field": "name", "stat": "sum"}]})
    assert "error" in engine.run("compare", {"table": "places", "ids": ["2"]}) and "error" in engine.run("nothing", {})
    assert distance("abcd", "abdc") == 1


def test_aggregate(engine):
    out = engine.run("aggregate", {"table": "places", "group_by": "state", "measures": [{"field": "rate", "stat": "weighted_mean"}, {"field": "open", "stat": "share_true"}]})
    assert [g["group"] for g in out["groups"]] == ["OH", "TX", None]
    assert out["groups"][1]["measures"] == {"rate:weighted_mean": 1.0, "open:share_true": 50.0}
    assert engine.run("aggregate", {"table": "places", "where": c("pop", ">", 1e9)})["groups"] == []


def test_profile_compare_method(engine):
    assert engine.run("profile", {"table": "places", "id": "1"})["row"]["name"] == "Ada"
    assert [r["name"] for r in engine.run("compare", {"table": "places", "ids": ["2", "cy"]})["rows"]] == ["Bo", "Cy"]
    assert engine.run("method", {"name": "in_state", "params": {"state": "Ohio"}})["results"][0]["count"] == 1
    assert "error" in engine.run("method", {"name": "in_state"})
