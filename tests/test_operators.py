"""Operators against plain recomputations."""

import heapq
import random

from pyspark.sql import functions as F

from terravane.functions import text as X
from terravane.operators import geo, graph, joins, quality, stats
from terravane.queries import QUERIES
from terravane.sources import readers, sinks
from terravane.streaming import snapshots


def test_shortest_distances(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 9)), rng.random()) for _ in range(70)]
    near: dict = {}
    for u, v, mi, hr in edges:
        near.setdefault(u, []).append((v, mi, hr))
        near.setdefault(v, []).append((u, mi, hr))
    best, heap = {}, [(0.0, 0.0, s, s) for s in (1, 2)]
    while heap:
        mi, hr, src, n = heapq.heappop(heap)
        if n not in best:
            best[n] = (mi, hr, src)
            for v, a, b in near.get(n, []):
                heapq.heappush(heap, (mi + a, hr + b, src, v))
    df = spark.createDataFrame(edges, "u long, v long, mi double, hr double")
    src = spark.createDataFrame([(1,), (2,)], "node long")
    got = {r["node"]: (r["mi"], r["src"]) for r in graph.nearest_source(spark, df, src).collect()}
    assert got == {n: (d[0], d[2]) for n, d in best.items()}
    pairs = graph.many_to_many(spark, df, src, 12.0).collect()
    assert {r["node"] for r in pairs if r["mi"] <= 12} == {n for n, d in best.items() if d[0] <= 12}
    leaf = graph.attach(graph.nearest_source(spark, df, src), spark.createDataFrame([(9, 1, 3.5), (8, 1, 40.0)], "leaf long, node long, access double"))
    assert {r["leaf"]: (r["mi"], r["has_route"]) for r in leaf.collect()} == {9: (3.5, True), 8: (None, False)}


def test_greedy_cover(spark):
    covers = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4)], "candidate string, unit long")
    w = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 5.0), (4, 2.0), (5, 7.0)], "unit long, w double")
    assert [tuple(r)[:4] for r in graph.greedy_cover(spark, covers, w).orderBy("step").collect()] == [(1, "a", 6.0, 6.0), (2, "b", 5.0, 11.0), (3, "c", 2.0, 13.0)]


def test_nearest_in_rings_is_nearest(spark):
    rng = random.Random(8)
    a = [(i, rng.uniform(30, 34), rng.uniform(-100, -95)) for i in range(30)]
    b = [(i, rng.uniform(30, 34), rng.uniform(-100, -95)) for i in range(12)]
    left, right = spark.createDataFrame(a, "a long, lat double, lon double"), spark.createDataFrame(b, "b long, lat double, lon double")
    got = {r["a"]: r["b"] for r in geo.nearest_in_widening_rings(left, right, "a", "b", (20.0, 100.0, 600.0)).collect()}
    every = left.crossJoin(right.withColumnsRenamed({"lat": "la", "lon": "lo"})).withColumn("mi", geo.flat_miles(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")))
    assert got == {r["a"]: r["b"] for r in geo.nearest(every, "a", "b").collect()}


def test_text(spark):
    df = spark.createDataFrame([("12345-678", "18 Years", "abcd", "abdc"), ("123456", "6 Months", "abc", "abcd"), ("123456789", "x", "abc", "abc")], "z string, a string, s string, t string")
    got = df.select(X.zip5(F.col("z")).alias("z"), X.age_years(F.col("a")).alias("y"), X.one_edit(F.col("s"), F.col("t")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("12345", 18.0, True), (None, 0.5, True), ("12345", None, False)]
    one = spark.range(1).select(F.lit("12345").alias("c"), F.lit("saint paul").alias("n"))
    r = one.select(F.size(X.digit_slips(F.col("c"))), F.size(X.digit_slips(F.col("c"), True)), X.spellings(F.col("n")), X.cut_parts(F.lit("aa; bb; cc"), most=6), X.non_crossing(F.lit(60.2), 30, 60)).head()
    assert tuple(r) == (49, 4, ["saint paul", "st paul"], "aa; bb", 61)
    assert spark.range(1).select(X.both(F.lit(None).cast("boolean"), F.lit(False))).head()[0] is None


def test_joins_and_quality(spark):
    t = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "y"])], "id long, t array<string>")
    u = spark.createDataFrame([(7, ["b", "a"]), (8, ["x", "y", "z"]), (9, ["a", "q"])], "id long, t array<string>")
    assert {tuple(r) for r in joins.subset_pairs(t, u, "id", "t").collect()} == {(1, 7), (2, 8)}
    assert {r["value"]: r["keys"] for r in joins.collect_index(u, "id", "t").collect()}["a"] == [7, 9]
    assert not quality.passed(quality.checks(t, {"one": F.col("id") == 1})) and quality.passed(quality.checks(t, {"some": F.col("id") > 0}))
    assert joins.splice(t, u, F.col("id") == 1).count() == 4
    assert stats.facets(t, "id", u.select("id")).where("n = 0").count() == 3


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,phase\n007,NA\n008,\n")
    assert [tuple(r) for r in readers.keyed_csv(spark, str(tmp_path / "a.csv"), "id string, phase string").collect()] == [("007", "NA"), ("008", None)]
    (tmp_path / "b.txt").write_text("k|x|y\nUS01|1|2\nCA02|5|5\nUS03|-9|4\n")
    got = lambda strict: {r[0]: r[1] for r in readers.prefixed(spark, str(tmp_path / "b.txt"), "k string, x long, y long", "k", "US", ["x", "y"], (-9,), strict).collect()}
    assert got(True) == {"01": 3, "03": None} and got(False) == {"01": 3, "03": 4}
    (tmp_path / "c.js").write_text('window.X = {"n": 3};\n')
    assert readers.assignment_json(spark, str(tmp_path / "c.js"), "n int").head()[0] == 3
    (tmp_path / "d.csv").write_text("Report\n01001,2.5\nnote\n")
    assert [tuple(r) for r in readers.report(spark, str(tmp_path / "d.csv"), r"^\d{5},", "k string, v double").collect()] == [("01001", 2.5)]
    assert readers.aliases(["First Name", "ZIP"], {"zip": ("zip_code", "zip")}) == {"zip": "ZIP"}
    df = spark.range(2)
    assert [sinks.archive(spark, df, str(tmp_path / "s"), "2020-01-01") for _ in range(2)] == ["2020-01-01", "2020-01-01-2"]


def test_stream_of_snapshots(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    counts = snapshots.daily_counts(snapshots.arrivals(spark, str(tmp_path / "in"), events.schema).withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    q = counts.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("daily").agg(F.sum("n")).head()[0] == events.count()


def test_queries_without_sql_run(spark):
    assert QUERIES["g4_nearest_source"](spark, "/root/testdata/sf0.001").count() > 0
    assert QUERIES["g13_greedy_cover"](spark, "/root/testdata/sf0.001").count() == 5


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    label = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for u, v in edges:
            low = min(label[u], label[v])
            moved |= label[u] != low or label[v] != low
            label[u] = label[v] = low
    got = dict(map(tuple, graph.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == label


def test_components_of_the_whole_graph(spark):
    data = "/root/testdata/sf0.001"
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey", "l_partkey").collect():
        low, high = sorted((find(u), find(v + 1000000)))
        root[high] = low
    got = {r["node"]: r["component"] for r in QUERIES["g2_components_whole"](spark, data).collect()}
    assert got == {x: find(x) for x in root}


def test_whole_queries_take_every_row(spark):
    data = "/root/testdata/sf0.001"
    assert QUERIES["p3_code_map_whole"](spark, data).count() == spark.read.parquet(f"{data}/orders.parquet").count()
    for name, column in (("g21_finder", "items"), ("a10_distinct_within", "within_120")):
        few, all_rows = ({r["c_id"]: r[column] for r in QUERIES[n](spark, data).collect()} for n in (name, f"{name}_whole"))
        assert few.keys() <= all_rows.keys() and sum(all_rows.values()) > 2 * sum(few.values()) > 0
