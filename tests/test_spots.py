"""Places, targets and items in large numbers at few coordinates, and items at many."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terravane.operators import geo, graph
from terravane.queries import QUERIES, SQL

SPOTS = (0, 5, 10)  # keys that differ by 3000 lie at one spot


def most_joined(df):
    """The rows of ``df`` and the most rows that a join of its last run made."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in kind:
            most = max(most, node.metrics().get("numOutputRows").get().value())
    return rows, most


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    d, rng = str(tmp_path_factory.mktemp("crowd")), random.Random(3)
    keys = [s + 3000 * i for s in SPOTS for i in range(400)]
    spark.createDataFrame([(k, rng.randrange(-500, 9000) + 0.25) for k in keys], "c_custkey long, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k,) for k in keys if k < 300000], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    lines = [(rng.randrange(500), rng.choice(keys[:100] + keys[400:500]), float(rng.randrange(1, 51))) for _ in range(2000)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d


def as_sql(name, d, rows, columns):
    con = duckdb.connect()
    for t in ("customer", "supplier", "lineitem"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = con.sql(SQL[name])
    assert sorted(map(tuple, rows)) == sorted(want.select(*columns).fetchall())
    return len(rows)


@pytest.mark.parametrize("name", ["a10_distinct_within", "a10_distinct_within_whole", "g21_finder_whole", "g21_finder", "j8_radius_join"])
def test_rows_of_one_spot_meet_once(spark, crowd, name):
    df = QUERIES[name](spark, crowd)
    rows, most = most_joined(df)
    assert as_sql(name, crowd, rows, df.columns) > 400 and most < 5000  # pairs of keys: over 80,000


@pytest.mark.parametrize("many", [0, 3, 32])
def test_items_at_few_and_many_spots(spark, many):
    rng = random.Random(8)
    point = lambda: (rng.choice((-89.5, -40.25, 10.5, 10.75, 11.0, 59.5, 60.0)), rng.choice((-179.75, -179.5, 0.25, 0.5, 1.0, 179.5, 179.9)))
    places, targets = [(i, *point()) for i in range(60)], [(i, *point()) for i in range(50)]
    items = [(rng.randrange(50), rng.choice((None, *range(25)))) for _ in range(120)] + [(t, 99) for t in range(50)]
    p, t, i = (spark.createDataFrame(x, s) for x, s in ((places, "p int, lat double, lon double"), (targets, "t int, lat double, lon double"), (items, "t int, i int")))
    bands = (20.0, 60.0, 120.0)
    pairs = geo.radius_join(p, t, 120.0).select("p", "t", "mi").join(i, "t").groupBy("p", "i").agg(F.min("mi").alias("mi"))
    want = {tuple(r) for r in pairs.groupBy("p").agg(*(F.count_if(F.col("mi") <= b) for b in bands)).collect()}
    got = geo.distinct_within(p, "p", t, "t", i, "i", 120.0, bands, many=many).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 30


@pytest.mark.parametrize("united, bits", [(geo.UNITED, geo.BITS), (300, 1 << 11)])
def test_sets_of_many_spots_are_united(spark, monkeypatch, united, bits):
    monkeypatch.setattr(geo, "UNITED", united)
    monkeypatch.setattr(geo, "BITS", bits)
    rng = random.Random(6)
    grid = [(lat + 0.0, lon + 0.0) for lat in range(-7, 8) for lon in (*range(-180, -173), *range(172, 180))]
    places = [(i, *at) for i, at in enumerate(grid)] + [(len(grid), 89.0, 0.0), (len(grid) + 1, None, 0.0)]
    few = rng.sample(range(len(grid)), 50)
    items = [(t, i) for i in (None, *range(30)) for t in rng.sample(range(len(grid)), 60)] + [(t, i) for i in range(100, 105) for t in few] + [(t, 200) for t in few[:3]]
    p, t, i = (spark.createDataFrame(x, s) for x, s in ((places, "p int, lat double, lon double"), (places, "t int, lat double, lon double"), (items, "t int, i int")))
    bands = (60.0, 120.0)
    pairs = geo.radius_join(p, t, 120.0).select("p", "t", "mi").join(i, "t").groupBy("p", "i").agg(F.min("mi").alias("mi"))
    want = {tuple(r) for r in pairs.groupBy("p").agg(*(F.count_if(F.col("mi") <= b) for b in bands)).collect()}
    got, most = most_joined(geo.distinct_within(p, "p", t, "t", i, "i", 120.0, bands))
    assert {tuple(r) for r in got} == want and len(got) == len(want) == len(grid)
    assert most < 5000  # a row for each item, spot and place: over 15,000


def test_gains_that_differ_by_rounding_are_ties(spark, crowd):
    covers = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "candidate string, unit int")
    weights = spark.createDataFrame([(1, 5.00001), (2, 5.0), (3, 4.0)], "unit int, w double")
    assert [r["candidate"] for r in graph.greedy_cover(spark, covers, weights).orderBy("step").collect()] == ["a", "b", "c"]
    df = QUERIES["g13_greedy_cover"](spark, crowd)
    assert as_sql("g13_greedy_cover", crowd, df.collect(), df.columns) == 3
