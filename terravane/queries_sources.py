"""Queries of what readers and writers derive, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import _shapes
from .registry import query
from .registry import table as _t
from .sources import readers, sinks


@query("select p_partkey from part where regexp_matches(p_name, '(?i)RED|PLATE') or regexp_matches(p_type, '(?i)promo')")
def s8_matching(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which a column matches."""
    p = _t(spark, d, "part")
    return readers.matching(p, ["p_name"], "RED|PLATE").select("p_partkey").union(readers.matching(p, ["p_type"], "promo").select("p_partkey")).distinct()


@query("""with w as (select p_partkey, p_brand as c1, p_type as c2, string_split(p_name, ' ')[1] as c3, p_size % 2 = 0 as y2, p_size % 3 = 0 as y3 from part),
l as (select p_partkey, unnest([{'r': 1, 'c': c1}, {'r': case when y2 then 0 else 1 end, 'c': c2}, {'r': case when y3 then 0 else 1 end, 'c': c3}]) as x from w),
k as (select p_partkey, x.c as c, min(x.r) as r from l where x.c in ('PROMO', 'SMALL', 'red', 'hot', 'Brand#12') group by 1, 2)
select p_partkey, string_agg(c, ',' order by r, c) as codes from k group by 1""")
def s9_primary_first(spark: SparkSession, d: str) -> DataFrame:
    """Wanted codes of a family of columns, primary ones first."""
    p = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("c1"), F.col("p_type").alias("c2"), F.get(F.split("p_name", " "), F.lit(0)).alias("c3"), F.lit("N").alias("s1"), F.when(F.col("p_size") % 2 == 0, "Y").alias("s2"), F.when(F.col("p_size") % 3 == 0, "Y").alias("s3"))
    codes = readers.primary_first(["c1", "c2", "c3"], ["s1", "s2", "s3"], ["PROMO", "SMALL", "red", "hot", "Brand#12"])
    return p.select("p_partkey", F.array_join(codes, ",").alias("codes")).where("codes <> ''")


@query("""select s_suppkey::varchar as key, 'id,name,big' as cols, '[' || s_suppkey || ',"' || s_name || '",' || case when s_suppkey % 5 = 0 then 'null' else (s_acctbal > 5000)::varchar end || ']' as row from supplier""")
def k3_compact_rows(spark: SparkSession, d: str) -> DataFrame:
    """K3: rows as arrays, with the columns' names once for each."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") > 5000).alias("big"))
    return sinks.compact_rows(s, "id").select("key", F.array_join("cols", ",").alias("cols"), "row")


@query("""with p as (select distinct l_suppkey, l_partkey from lineitem), i as (select l_partkey, row_number() over (order by l_partkey) - 1 as code from (select distinct l_partkey from p)),
r as (select l_suppkey, count(*) as n, min(code) as first, max(code) as last from p join i using (l_partkey) group by 1)
select l_suppkey, (sum(n) over (order by l_suppkey) - n)::bigint as at, n, first, last from r""")
def k4_sparse_rows(spark: SparkSession, d: str) -> DataFrame:
    """K4: a many-to-many table as codes one after another."""
    _, rows = sinks.sparse_rows(_t(spark, d, "lineitem"), "l_suppkey", "l_partkey")
    return rows.select("l_suppkey", "at", F.col("n").cast("long").alias("n"), F.array_min("codes").cast("long").alias("first"), F.array_max("codes").cast("long").alias("last"))


@query("select n_nationkey::bigint as nation, 2 as rings, 6 + 4 as points, true as closed from nation")
def k8_geojson(spark: SparkSession, d: str) -> DataFrame:
    """K8: polygons as GeoJSON, with rings that end where they begin."""
    out = sinks.geojson(_shapes(spark, d), "nation", close=0.2, least=0.1)
    rings = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")
    points = F.aggregate(F.transform(rings, F.size), F.lit(0), lambda a, x: a + x)
    closed = F.forall(rings, lambda r: F.get(r, F.lit(0)) == F.element_at(r, -1))
    return out.select("nation", F.size(rings).alias("rings"), points.alias("points"), closed.alias("closed"))
