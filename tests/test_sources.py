"""Readers and writers on small files, networks and spatial joins on small graphs."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from terravane.operators import geo, graph, network
from terravane.sources import readers, sinks


def test_pages():
    pages = {None: ([{"a": 1}], "t", 2), "t": ([{"a": 2}], None, 2)}
    assert [json.loads(x)["a"] for x in readers.pull_pages(pages.__getitem__)] == [1, 2]
    with pytest.raises(ValueError):
        list(readers.pull_pages({None: ([{"a": 1}], None, 2)}.__getitem__))


def test_zip_bom_and_headers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("f.txt", "﻿KEY \t NAME  \n01\tÉlk \n02\t\n")
    got = [r["row"] for r in readers.delimited_in_zip(spark, str(tmp_path / "x.zip")).collect()]
    assert got == [{"KEY": "01", "NAME": "Élk"}, {"KEY": "02", "NAME": None}]


def test_xml_and_fallback(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<bills><bill><no>1</no><m><n>a</n></m><m><n>b</n><w>2024</w></m></bill></bills>")
    schema = "no string, m array<struct<n: string, w: string>>"
    read = lambda name: lambda: readers.signed_on(spark, str(tmp_path / name), "bill", schema, "m", "w")
    assert [r["member"]["n"] for r in readers.first_that_works(read("none.xml"), read("b.xml")).collect()] == ["a"]


def test_aliases():
    assert readers.aliases(["Org Name", "ZIP-Code"], {"zip": ("zip5", "zip_code"), "name": ("orgname",), "x": ("y",)}) == {"zip": "ZIP-Code", "name": "Org Name", "x": None}


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body + struct.pack(">2i", 2, 2) + struct.pack("<i", 0)
    dbf = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, 2, 65, 5) + b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([4]) + bytes(15) + b"\r" + b" abcd ef  "
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("a.shp", shp)
        z.writestr("a.dbf", dbf)
    got = readers.shapes(spark, str(tmp_path / "s.zip")).collect()
    assert [(r["kind"], r["attributes"]["NAME"], [[tuple(p) for p in x] for x in r["rings"]]) for r in got] == [(5, "abcd", [ring]), (0, "ef", [])]


def test_release_and_completeness(spark, tmp_path):
    made = []

    def make(n):
        def f():
            made.append(n)
            return spark.range(n)

        return f

    path = str(tmp_path / "t")
    assert readers.of_release(spark, path, "2022", make(3)).count() == 3
    assert readers.of_release(spark, path, "2022", make(9)).count() == 3
    assert readers.of_release(spark, path, "2023", make(4)).count() == 4 and made == [3, 4]
    kept = spark.range(10)
    assert readers.whole_or_kept(spark.range(9), kept, "id")[1] and not readers.whole_or_kept(spark.range(5), kept, "id")[1]
    assert readers.whole_or_kept(spark.range(5), kept.limit(0), "id")[1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "level string, id long, v string")
    sinks.keyed_json(df, str(tmp_path / "j"), "level", "id")
    assert spark.read.json(str(tmp_path / "j/all")).count() == 2 and spark.read.json(str(tmp_path / "j/index")).count() == 2
    sinks.csv(df, str(tmp_path / "c"))
    assert readers.keyed_csv(spark, str(tmp_path / "c"), "level string, id string, v string").where("v is null").count() == 1
    assert sinks.packed(b"x", str(tmp_path / "p.gz")) and not sinks.packed(b"x", str(tmp_path / "p.gz"))
    assert sinks.archive(spark, df, str(tmp_path / "arch"), "2024-01-01") == "2024-01-01"
    assert sinks.archive(spark, df, str(tmp_path / "arch"), "2024-01-01", "p", "p") == "2024-01-01-2"
    with pytest.raises(ValueError):
        sinks.archive(spark, df, str(tmp_path / "arch"), "2024-01-02", "p", "q")
    out, seen = sinks.logged(df, {"none": F.col("v").isNull()})
    out.write.mode("overwrite").parquet(str(tmp_path / "o"))
    assert seen.get == {"rows": 2, "none": 1}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["component"] for r in graph.components(spark, edges).collect()} == {0}
    far = graph.nearest_source(spark, edges.where("u < 40").withColumns({"mi": F.lit(1.0), "hr": F.lit(0.5)}), spark.range(1).select(F.col("id").alias("node")))
    assert {r["node"]: r["mi"] for r in far.collect()} == {i: float(i) for i in range(41)}


def test_bridges_and_eligible(spark):
    line = lambda i, *pts: (i, "road", [{"x": x, "y": y} for x, y in pts])
    rows = [line(1, (0.0, 0.0), (4000.0, 0.0)), line(2, (4000.0, 0.0), (4000.0, 4000.0)), line(3, (200.0, 4000.0), (4000.0, 4000.0)), line(4, (90_000.0, 0.0), (91_000.0, 0.0)), line(5, (5000.0, 0.0), (9000.0, 0.0))]
    lines = spark.createDataFrame(rows, "line long, kind string, points array<struct<x: double, y: double>>")
    nodes, edges = network.edges_of(lines, {"road": 50.0})
    assert edges.count() == 30 + 3 + 10 and nodes.where("degree = 1").count() == 6
    gaps = network.bridges(spark, nodes, edges, within=4_100.0)
    pairs = {tuple(sorted(((a["x"], a["y"]), (b["x"], b["y"])))) for a, b in _ends(nodes, gaps)}
    assert ((0.0, 0.0), (200.0, 4000.0)) not in pairs  # the way round is under 3.6 times the gap
    marked, new = network.eligible(spark, nodes, edges, least=5, within=1_100.0)
    assert {(r["size"], r["eligible"]) for r in marked.collect()} == {(31, True), (4, False), (11, True)} and new.count() == 1


def _ends(nodes, edges):
    at = {r["node"]: r for r in nodes.collect()}
    return [(at[e["u"]], at[e["v"]]) for e in edges.collect()]


def test_radius_join_everywhere(spark):
    import random

    rng = random.Random(3)
    a = [(i, rng.choice([rng.uniform(-89, 89), rng.uniform(69, 89.5)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 181) % 360 - (360 if rng.random() < 0.5 else 0)])) for i in range(300)]
    a = [(i, la, (lo + 180) % 360 - 180) for i, la, lo in a]
    left = spark.createDataFrame(a, "i long, lat double, lon double")
    right = spark.createDataFrame([(i + 1000, la + rng.uniform(-2, 2) if abs(la) < 86 else la, (lo + rng.uniform(-3, 3) + 180) % 360 - 180) for i, la, lo in a], "j long, lat double, lon double")
    for r in (60.0, 200.0):
        got = {(x["i"], x["j"]) for x in geo.radius_join(left, right, r).select("i", "j").collect()}
        every = left.withColumnsRenamed({"lat": "a", "lon": "b"}).crossJoin(right)
        want = {(x["i"], x["j"]) for x in every.where(geo.flat_miles_round(F.col("a"), F.col("b"), F.col("lat"), F.col("lon")) <= r).select("i", "j").collect()}
        assert got == want and want
