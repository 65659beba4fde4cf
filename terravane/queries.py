"""The operators on the driver tables, with the same in SQL; keys carry the operators' ids.

Analogies: a customer is a place of weight c_acctbal where positive, a nation and a region are the areas above
it, an order is an item, a supplier a site; coordinates are made from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import entities, evidence, geo, graph, joins, polygons, quality, stats, tables
from .plans.catalog import Field, Table
from .plans.engine import aggregate_frame, query_frame
from .registry import QUERIES, SQL, query
from .registry import table as _t


def _places(spark, d) -> DataFrame:
    """A row a customer with positive weight and its number of orders."""
    n = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderkey").alias("n"))
    rows = _t(spark, d, "customer").where("c_acctbal > 0").join(n, "c_custkey", "left")
    return rows.select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("w"), F.coalesce("n", F.lit(0)).alias("n"))


_PLACES = "places as (select c_custkey, c_nationkey::bigint as nation, c_mktsegment as segment, c_acctbal as w, coalesce(n, 0) as n from customer left join (select o_custkey, count(distinct o_orderkey) as n from orders group by 1) o on o_custkey = c_custkey where c_acctbal > 0)"

NATIONS = Table("nations", (Field("id"), Field("name"), Field("region", groupable=True, state=True), Field("weight", "number"), Field("items", "integer"), Field("pct_lt10", "number"), Field("people_lt10", "number")), default=("items",), weight="weight", source="customer, orders, nation, region")


def _nations(spark, d) -> DataFrame:
    p = _places(spark, d)
    few = F.col("n") < 10
    rows = p.groupBy("nation").agg(F.sum("w").alias("weight"), F.sum("n").alias("items"), stats.share(few, F.col("w")).alias("pct_lt10"), F.sum(F.when(few, F.col("w")).otherwise(0.0)).alias("people_lt10"))
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return n.join(rows, "nation").select(F.col("nation").cast("string").alias("id"), "name", "region", "weight", "items", "pct_lt10", "people_lt10")


_NATIONS = _PLACES + """, nations as (
  select n_nationkey::varchar as id, n_name as name, r_name as region, sum(w) as weight, sum(n)::bigint as items,
         100.0 * sum(case when n < 10 then w else 0 end) / sum(w) as pct_lt10, sum(case when n < 10 then w else 0 end) as people_lt10
  from places join nation on n_nationkey = nation join region on r_regionkey = n_regionkey group by 1, 2, 3)"""

_ROUND = "round({c}, 6) as {c}"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"with {_NATIONS} select id, name, round(pct_lt10, 6) as pct_lt10, round(people_lt10, 4) as people_lt10, region from nations where lower(region) = 'asia' order by pct_lt10 desc nulls last limit 10")
def m1_query_worst_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of weight with fewer than 10 items in a region, worst first."""
    spec = {"where": [{"field": "region", "op": "=", "value": "asia"}], "order_by": [{"field": "pct_lt10", "dir": "desc"}], "columns": ["pct_lt10", "people_lt10"], "limit": 10}
    return _rounded(_rounded(query_frame(NATIONS, _nations(spark, d), spec)[0], "pct_lt10"), "people_lt10", digits=4)


@query(f"""with {_NATIONS}, q as (select *, (region = 'ASIA' or region = 'EUROPE') as scope from nations)
select count(*) filter (where scope and (items > 100 or pct_lt10 between 40 and 60) and name <> 'NATION_3') as count, count(*) filter (where scope) as in_scope,
       round(sum(weight) filter (where scope and (items > 100 or pct_lt10 between 40 and 60) and name <> 'NATION_3'), 4) as sum_weight_matching from q""")
def f_scope_and_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a filter and of its scope in one pass."""
    spec = {"where": [{"field": "region", "op": "in", "value": ["asia", "Europe"]}, {"any_of": [{"field": "items", "op": ">", "value": "100"}, {"field": "pct_lt10", "op": "between", "value": [40, 60]}]}, {"field": "name", "op": "!=", "value": "nation_3"}]}
    return _rounded(query_frame(NATIONS, _nations(spark, d), spec)[1].select("count", "in_scope", "sum_weight_matching"), "sum_weight_matching", digits=4)


@query(f"""with {_NATIONS} select region as "group", count(*) as n, round(sum(weight), 4) as sum_weight, round(avg(pct_lt10), 6) as mean_pct, round(sum(pct_lt10 * weight) / sum(weight), 6) as wmean_pct,
round(median(items), 6) as median_items, min(items) as least, max(items) as most, round(100.0 * avg((name = 'NATION_7')::int), 6) as share_7 from nations group by 1""")
def m2_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """All statistics by a groupable field."""
    m = [{"field": "pct_lt10", "stat": "mean"}, {"field": "pct_lt10", "stat": "weighted_mean"}, {"field": "items", "stat": "median"}, {"field": "items", "stat": "min"}, {"field": "items", "stat": "max"}, {"field": "name", "stat": "share_eq", "value": "nation_7"}]
    out = aggregate_frame(NATIONS, _nations(spark, d), {"group_by": "region", "measures": m})
    out = out.select("group", "n", F.round("sum_weight", 4).alias("sum_weight"), F.round(F.col("`pct_lt10:mean`"), 6).alias("mean_pct"), F.round(F.col("`pct_lt10:weighted_mean`"), 6).alias("wmean_pct"), F.round(F.col("`items:median`"), 6).alias("median_items"), F.col("`items:min`").alias("least"), F.col("`items:max`").alias("most"), F.round(F.col("`name:share_eq`"), 6).alias("share_7"))
    return out


@query(f"""with {_PLACES}, v as (select nation, n, sum(w) as w from places group by 1, 2), r as (select *, sum(w) over (partition by nation order by n) as run, sum(w) over (partition by nation) as total from v)
select nation, min(n) as median from r where run >= total / 2 group by 1""")
def a14_lower_weighted_median(spark: SparkSession, d: str) -> DataFrame:
    """A14, W1."""
    return stats.lower_weighted_median(_places(spark, d), ["nation"], "n", "w")


@query(f"with {_PLACES}, s as (select nation, segment, sum(w) as w from places group by 1, 2) select nation, segment as mode from (select *, row_number() over (partition by nation order by w desc, segment) as k from s) where k = 1")
def a16_weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return stats.weighted_mode(_places(spark, d), ["nation"], "segment", "w")


@query(f"""with {_PLACES}, s as (select nation, segment, sum(w) as w from places group by 1, 2), r as (select *, row_number() over (partition by nation order by w desc, segment) as rank, 100.0 * w / sum(w) over (partition by nation) as share from s)
select nation, rank, segment as value, round(share, 6) as share from r where rank <= 3""")
def a17_top_shares(spark: SparkSession, d: str) -> DataFrame:
    """The three values of most weight."""
    out = stats.top_shares(_places(spark, d), ["nation"], "segment", "w")
    return out.select("nation", F.explode("shares").alias("s")).select("nation", F.col("s.rank").alias("rank"), F.col("s.value").alias("value"), F.round("s.share", 6).alias("share"))


@query("select l_suppkey, mode from (select l_suppkey, l_partkey as mode, row_number() over (partition by l_suppkey order by count(*) desc, l_partkey) as k from lineitem group by 1, 2) where k = 1")
def a21_frequency_mode(spark: SparkSession, d: str) -> DataFrame:
    """A20, A21."""
    return stats.frequency_mode(_t(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")


@query(f"""with {_PLACES}, j as (select p.*, r_name as region from places p join nation on n_nationkey = nation join region on r_regionkey = n_regionkey)
select 'nation' as grain, nation::varchar as key, round(sum(w), 4) as w, round(sum(w * n) / sum(w), 6) as mean_n, round(100.0 * sum(case when n = 0 then w else 0 end) / sum(w), 6) as pct_none from j group by 2
union all select 'region', region, round(sum(w), 4), round(sum(w * n) / sum(w), 6), round(100.0 * sum(case when n = 0 then w else 0 end) / sum(w), 6) from j group by 2
union all select 'all', 'all', round(sum(w), 4), round(sum(w * n) / sum(w), 6), round(100.0 * sum(case when n = 0 then w else 0 end) / sum(w), 6) from j""")
def a26_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The same figures at three grains."""
    names = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("nation"), F.col("r_name").alias("region"))
    rows = _places(spark, d).join(names, "nation")
    w, n = F.col("w"), F.col("n")
    aggs = [F.round(F.sum(w), 4).alias("w"), F.round(stats.weighted_mean(n, w), 6).alias("mean_n"), F.round(stats.share(n == 0, w), 6).alias("pct_none")]
    return stats.rollup(rows, {"nation": ["nation"], "region": ["region"], "all": []}, aggs)


@query("select p_size, red, plate from (select p_size, count(distinct p_partkey) filter (where list_contains(string_split(p_name, ' '), 'red')) as red, count(distinct p_partkey) filter (where list_contains(string_split(p_name, ' '), 'plate')) as plate from part group by 1)")
def a25_one_hot(spark: SparkSession, d: str) -> DataFrame:
    """Different items under each label, zero-filled."""
    p = _t(spark, d, "part").withColumn("labels", F.split("p_name", " "))
    out = stats.one_hot_counts(p, "p_size", "labels", "p_partkey", ["red", "plate"])
    return p.select("p_size").distinct().join(out, "p_size", "left").na.fill(0)


@query("select v.o_orderpriority, v.o_orderstatus, coalesce(n, 0) as n from (select * from (select distinct o_orderpriority from orders), (select distinct o_orderstatus from orders)) v left join (select o_orderpriority, o_orderstatus, count(*) as n from orders where o_totalprice > 300000 group by 1, 2) c using (o_orderpriority, o_orderstatus)")
def a30_facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a filtered set over the whole domain of two columns."""
    o = _t(spark, d, "orders")
    keys = o.groupBy().agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set("o_orderstatus").alias("b")).select(F.explode("a").alias("o_orderpriority"), "b").select("o_orderpriority", F.explode("b").alias("o_orderstatus"))
    counts = o.where("o_totalprice > 300000").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return joins.complete(counts, keys, ["o_orderpriority", "o_orderstatus"], n=0)


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) as p10, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(median(l_quantity), 4) as med from lineitem group by 1")
def a23_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact, interpolated."""
    li = _t(spark, d, "lineitem")
    price = tables.exact_quantiles(li, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p90": 0.9})
    out = price.join(tables.exact_quantiles(li, ["l_returnflag"], "l_quantity", {"med": 0.5}), "l_returnflag")
    return _rounded(out, "p10", "p90", "med", digits=4).select("l_returnflag", "p10", "p90", "med")


@query("select p_size < 25 as small, p_retailprice < 1400 as cheap, count(*) as n from part group by 1, 2")
def a24_cross_tab(spark: SparkSession, d: str) -> DataFrame:
    """A24."""
    return _t(spark, d, "part").groupBy((F.col("p_size") < 25).alias("small"), (F.col("p_retailprice") < 1400).alias("cheap")).agg(F.count(F.lit(1)).alias("n"))


@query("""with b as (select distinct l_partkey, l_suppkey from lineitem), s as (select *, 1.0 / count(*) over (partition by l_partkey) as share from b)
select l_suppkey, round(sum(p_retailprice * share), 4) as apportioned from s join part on p_partkey = l_partkey group by 1""")
def j3_bridge(spark: SparkSession, d: str) -> DataFrame:
    """A part's price shared among its suppliers."""
    b = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().withColumn("share", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("l_partkey")))
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return joins.bridge(parts, b, "l_partkey", "p_retailprice", "share").groupBy("l_suppkey").agg(F.round(F.sum("w"), 4).alias("apportioned"))


@query("select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity >= 50) and not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_discount > 0.099 and l_quantity < 2)")
def j4_j5_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """J4, J5."""
    li = _t(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    s = _t(spark, d, "supplier").select("s_suppkey")
    return s.join(li.where("l_quantity >= 50"), "s_suppkey", "left_semi").join(li.where("l_discount > 0.099 and l_quantity < 2"), "s_suppkey", "left_anti")


@query("""with o as (select o_custkey as k, max(o_orderpriority) as p, count(*) as n from orders where o_orderdate < timestamp '1998-01-01' group by 1), w as (select o_custkey as k, max(o_orderpriority) as p, count(*) as n from orders where o_orderdate >= timestamp '1997-01-01' group by 1)
select k, case when o.n is null then 'added' when w.n is null then 'removed' else 'changed' end as change, case when o.n is null or w.n is null then '' else concat_ws(',', case when o.p is distinct from w.p then 'p' end, case when o.n is distinct from w.n then 'n' end) end as fields
from o full outer join w using (k) where o.n is null or w.n is null or o.p is distinct from w.p or o.n is distinct from w.n""")
def m12_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots compared."""
    o = _t(spark, d, "orders")
    cut = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("n"))
    out = joins.snapshot_diff(cut("o_orderdate < timestamp_ntz '1998-01-01'"), cut("o_orderdate >= timestamp_ntz '1997-01-01'"), ["k"], ["p", "n"])
    return out.select("k", "change", F.concat_ws(",", "fields").alias("fields"))


@query("""select c_custkey, coalesce(a.v, b.v, c.v) as v, case when a.v is not null then 'large' when b.v is not null then 'recent' when c.v is not null then 'segment' else 'none' end as method
from customer left join (select o_custkey as k, max(o_totalprice) as v from orders where o_totalprice > 400000 group by 1) a on a.k = c_custkey
left join (select o_custkey as k, max(o_totalprice) as v from orders where o_orderdate >= timestamp '2001-01-01' group by 1) b on b.k = c_custkey
left join (select c_mktsegment as k, max(c_acctbal) as v from customer where c_nationkey < 12 group by 1) c on c.k = c_mktsegment""")
def j12_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first of three tables that knows."""
    o, c = _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), _t(spark, d, "customer")
    top = lambda x: x.groupBy("c_custkey").agg(F.max("o_totalprice").alias("v"))
    seg = c.where("c_nationkey < 12").groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("v"))
    steps = [("large", top(o.where("o_totalprice > 400000")), ["c_custkey"], "v"), ("recent", top(o.where("o_orderdate >= timestamp_ntz '2001-01-01'")), ["c_custkey"], "v"), ("segment", seg, ["c_mktsegment"], "v")]
    return joins.ladder(c.select("c_custkey", "c_mktsegment"), steps, "v").select("c_custkey", "v", "method")


def _points(spark, d, name: str) -> DataFrame:
    t, key = (("supplier", "s_suppkey") if name == "s" else ("customer", "c_custkey"))
    k = F.col(key)
    return _t(spark, d, t).select(k.alias(f"{name}_id"), (30 + (k * 7919 % 1500) / 100.0).alias("lat"), (-100 + (k * 104729 % 3000) / 100.0).alias("lon"))


_PAIRS = """s as (select s_suppkey as s_id, 30 + (s_suppkey * 7919 % 1500) / 100.0 as lat, -100 + (s_suppkey * 104729 % 3000) / 100.0 as lon from supplier),
c as (select c_custkey as c_id, 30 + (c_custkey * 7919 % 1500) / 100.0 as lat, -100 + (c_custkey * 104729 % 3000) / 100.0 as lon from customer),
pairs as (select c_id, s_id, sqrt(pow(69 * (s.lat - c.lat), 2) + pow(69 * cos(radians(c.lat)) * (s.lon - c.lon), 2)) as mi from c, s)"""


@query(f"with {_PAIRS} select c_id, count(*) as n, round(min(mi), 5) as least from pairs where mi <= 120 group by 1")
def j8_radius_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within 120 miles by grid cells."""
    return _rounded(geo.near_figures(_points(spark, d, "c"), "c_id", _points(spark, d, "s"), 120.0), "least", digits=5)


@query(f"with {_PAIRS} select c_id, k as rank, s_id, round(mi, 5) as mi from (select *, row_number() over (partition by c_id order by mi, s_id) as k from pairs where mi <= 400) where k <= 3")
def w9_three_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest within 400 miles."""
    found = geo.nearest_in_widening_rings(_points(spark, d, "c"), _points(spark, d, "s"), "c_id", "s_id", (60.0, 120.0, 400.0), k=3)
    return _rounded(found, "mi", digits=5)


@query(f"with {_PAIRS}, i as (select distinct l_suppkey as s_id, l_orderkey as o from lineitem where l_quantity > 45), best as (select c_id, o, min(mi) as mi from pairs join i using (s_id) where mi <= 120 group by 1, 2) select c_id, count(*) filter (where mi <= 30) as within_30, count(*) filter (where mi <= 60) as within_60, count(*) as within_120 from best group by 1")
def a10_distinct_within(spark: SparkSession, d: str) -> DataFrame:
    """Different items within three bands."""
    return _distinct_within(spark, d, _t(spark, d, "lineitem").where("l_quantity > 45"))


def _distinct_within(spark, d, li) -> DataFrame:
    items = li.select(F.col("l_suppkey").alias("s_id"), F.col("l_orderkey").alias("o"))
    return geo.distinct_within(_points(spark, d, "c"), "c_id", _points(spark, d, "s"), "s_id", items, "o", 120.0, (30.0, 60.0, 120.0))


@query(SQL["a10_distinct_within"].replace(" where l_quantity > 45", ""))
def a10_distinct_within_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same over all of lineitem."""
    return _distinct_within(spark, d, _t(spark, d, "lineitem"))


@query("""select c_nationkey, round(degrees(atan2(sum(w * sin(radians(lat))), sqrt(pow(sum(w * cos(radians(lat)) * cos(radians(lon))), 2) + pow(sum(w * cos(radians(lat)) * sin(radians(lon))), 2)))), 6) as lat,
round(degrees(atan2(sum(w * cos(radians(lat)) * sin(radians(lon))), sum(w * cos(radians(lat)) * cos(radians(lon))))), 6) as lon
from (select c_nationkey, c_acctbal as w, 30 + (c_custkey * 7919 % 1500) / 100.0 as lat, -100 + (c_custkey * 104729 % 3000) / 100.0 as lon from customer where c_acctbal > 0) group by 1""")
def a28_spherical_mean(spark: SparkSession, d: str) -> DataFrame:
    """A28."""
    c = _t(spark, d, "customer").where("c_acctbal > 0")
    k = F.col("c_custkey")
    lat, lon = stats.spherical_mean(30 + (k * 7919 % 1500) / 100.0, -100 + (k * 104729 % 3000) / 100.0, F.col("c_acctbal"))
    return c.groupBy("c_nationkey").agg(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("""select s_nationkey, s_suppkey, rank() over (partition by s_nationkey order by s_acctbal desc) as in_nation, rank() over (order by s_acctbal desc) as overall, count(*) over (partition by s_acctbal) - 1 as ties from supplier""")
def w5_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Competition ranks and ties."""
    s = _t(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    out = tables.global_ranks(s, "s_acctbal").withColumn("in_nation", F.rank().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))))
    return out.select("s_nationkey", "s_suppkey", F.col("in_nation").cast("long").alias("in_nation"), "overall", "ties")


@query("""with q as (select s_suppkey, s_nationkey, 1 + s_suppkey % 7 as x, (1 + s_suppkey % 7) * 100.0 / sum(1 + s_suppkey % 7) over (partition by s_nationkey) as q from supplier),
r as (select *, floor(q) as f, 100 - sum(floor(q)) over (partition by s_nationkey) as short, row_number() over (partition by s_nationkey order by round(q - floor(q), 9) desc, s_suppkey) as k from q)
select s_nationkey, sum(f + case when k <= short then 1 else 0 end)::bigint as total, max(f + case when k <= short then 1 else 0 end)::bigint as most from r group by 1""")
def w7_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    """W7, G23."""
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", (1 + F.col("s_suppkey") % 7).cast("double").alias("x"), F.lit(100).cast("long").alias("total"))
    return stats.largest_remainder(s, ["s_nationkey"], "total", "x", "s_suppkey").groupBy("s_nationkey").agg(F.sum("n").alias("total"), F.max("n").alias("most"))


@query("""with e as (select date_trunc('day', ts) as day, event_type, count(*) as n from events group by 1, 2), l as (select *, lag(n) over (partition by event_type order by day) as before from e)
select event_type, count(*) filter (where before > n) as falls, sum(n)::bigint as n from l group by 1""")
def w8_falls(spark: SparkSession, d: str) -> DataFrame:
    """How often a daily count falls."""
    e = _t(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    falls = quality.falls(e, "event_type", "day", "n").groupBy("event_type").agg(F.count(F.lit(1)).alias("falls"))
    return e.groupBy("event_type").agg(F.sum("n").alias("n")).join(falls, "event_type", "left").select("event_type", F.coalesce("falls", F.lit(0)).alias("falls"), "n")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1")
def s3_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """S3, W3."""
    return joins.first_wins(_t(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("select (json_extract_string(props, '$.k'))::bigint as k, count(*) as n from events group by 1")
def p1_json_path(spark: SparkSession, d: str) -> DataFrame:
    """A path in JSON."""
    return _t(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, case when n >= 100 then 'broad' when n >= 20 then 'limited' when n >= 1 then 'few' else 'none' end as menu, case when n > 8 and w >= 5000 then true else false end as both from (with " + _PLACES + " select * from places)")
def p5_buckets(spark: SparkSession, d: str) -> DataFrame:
    """P5, P6."""
    return _places(spark, d).select("c_custkey", X.bucket(F.col("n")).alias("menu"), X.both(F.col("n") > 8, F.col("w") >= 5000).alias("both"))


@query(r"""select doc_id, case when regexp_matches(text, '\|') then 'table' when regexp_matches(text, '[%$#&*]{3}') then 'marks' when regexp_matches(text, '[A-Za-z]') then 'prose' else 'unclassified' end as kind, len(list_filter([regexp_matches(text, '\|'), regexp_matches(text, '[%$#&*]{3}'), regexp_matches(text, '[0-9]')], lambda x: x)) as labels from documents""")
def x11_classify(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules, and all labels."""
    t = F.col("text")
    rules = [("table", r"\|"), ("marks", r"[%$#&*]{3}"), ("prose", "[A-Za-z]")]
    return _t(spark, d, "documents").select("doc_id", X.classify(t, rules).alias("kind"), F.size(X.labels(t, [*rules[:2], ("digits", "[0-9]")])).cast("long").alias("labels"))


@query(r"select s_suppkey, trim(regexp_replace(lower(s_name), '[^\p{L}\p{N}]+', ' ', 'g')) as norm, length(s_name)::bigint as n from supplier")
def x1_norm(spark: SparkSession, d: str) -> DataFrame:
    """X1."""
    return _t(spark, d, "supplier").select("s_suppkey", X.norm(F.col("s_name")).alias("norm"), F.length("s_name").cast("long").alias("n"))


@query("""with b as (select case when p_size > 45 then 'large' when p_retailprice < 1000 then 'cheap' else 'kept' end as bucket from part) select bucket, count(*) as n from b group by 1""")
def r5_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Closed accounting of exclusions."""
    return quality.accounting(_t(spark, d, "part"), {"large": F.col("p_size") > 45, "cheap": F.col("p_retailprice") < 1000})


@query("""select 'discount in range' as "check", count(*) filter (where not (l_discount between 0 and 0.1)) as failures, count(*) filter (where not (l_discount between 0 and 0.1)) = 0 as ok from lineitem
union all select 'quantity whole', count(*) filter (where l_quantity <> floor(l_quantity)), count(*) filter (where l_quantity <> floor(l_quantity)) = 0 from lineitem
union all select 'small line', count(*) filter (where not l_quantity < 40), count(*) filter (where not l_quantity < 40) = 0 from lineitem""")
def m13_checks(spark: SparkSession, d: str) -> DataFrame:
    """Data-quality checks, all counted in one pass."""
    q = F.col("l_quantity")
    return quality.checks(_t(spark, d, "lineitem"), {"discount in range": F.col("l_discount").between(0, 0.1), "quantity whole": q == F.floor(q), "small line": q < 40})


@query("""with recursive e as (select distinct l_suppkey as u, 1000000 + l_partkey as v from lineitem where l_quantity >= 50), b as (select u, v from e union all select v, u from e),
r(n, c) as (select u, u from b union select v, c from r join b on u = n) select n as node, min(c) as component from r group by 1""")
def g2_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of a supplier and part graph."""
    return _components(spark, _t(spark, d, "lineitem").where("l_quantity >= 50"))


def _components(spark, li) -> DataFrame:
    return graph.components(spark, li.select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v")))


@query()
def g2_components_whole(spark: SparkSession, d: str) -> DataFrame:
    """Components over all of lineitem, without SQL."""
    return _components(spark, _t(spark, d, "lineitem"))


def _roads(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v")).agg(F.min("l_quantity").alias("mi")).withColumn("hr", F.col("mi") / 64)


@query("""with recursive e as (select l_suppkey as u, l_partkey + 1000000 as v, min(l_quantity) as mi from lineitem group by 1, 2), b as (select u, v, mi from e union all select v, u, mi from e),
s as (select s_suppkey as node from supplier where s_acctbal > 5000),
r(node, mi) as (select node, 0.0::double from s union select b.v, r.mi + b.mi from r join b on b.u = r.node where r.mi + b.mi <= 60), best as (select node, min(mi) as mi from r group by 1),
t(node, src) as (select node, node from s union select b.v, t.src from t join best x on x.node = t.node join b on b.u = t.node join best y on y.node = b.v where y.mi = x.mi + b.mi)
select node, mi, mi / 64 as hr, min(src) as src from best join t using (node) group by 1, 2""")
def g4_nearest_source(spark: SparkSession, d: str) -> DataFrame:
    """Miles and hours to the nearest of the suppliers of large balance, within 60 miles."""
    sources = _t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("node"))
    return graph.nearest_source(spark, _roads(spark, d), sources, within=60.0)


def _greedy_sql(steps: int) -> str:
    """The steps one after another: u<k> are the pairs of customers not covered by the first k."""
    parts = [f"{_PAIRS}, u0 as (select s_id, c_id, c_acctbal as w from pairs join customer on c_custkey = c_id where mi <= 120 and c_acctbal > 0)"]
    for k in range(1, steps + 1):
        parts.append(f"s{k} as (select s_id, sum(w) as gain from u{k - 1} group by 1 order by round(gain, 4) desc, s_id limit 1)")
        parts.append(f"u{k} as (select * from u{k - 1} where c_id not in (select c_id from u{k - 1} where s_id = (select s_id from s{k})))")
    rows = " union all ".join(f"select {k} as step, s_id as candidate, round(gain, 4) as gain from s{k} where gain > 0" for k in range(1, steps + 1))
    return f"with {', '.join(parts)} {rows}"


@query(_greedy_sql(5))
def g13_greedy_cover(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that cover most weight of customers within 120 miles."""
    weights = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("c_id"), F.col("c_acctbal").alias("w"))
    places = _points(spark, d, "c").distinct().join(weights, "c_id")
    out = graph.greedy_cover(spark, *geo.spot_covers(places, "c_id", "w", _points(spark, d, "s"), "s_id", 120.0), steps=5)
    return out.select("step", "candidate", F.round("gain", 4).alias("gain"))


@query(f"""with {_PLACES}, g as (select nation, n, case when nation % 5 = 0 then 0.0 else w end as w from places), v as (select nation, n, sum(w) as w from g where w > 0 group by 1, 2),
r as (select *, sum(w) over (partition by nation order by n) as run, sum(w) over (partition by nation) as total from v), m as (select nation, min(n) as wm from r where run >= total / 2 group by 1)
select nation, coalesce(wm, plain)::double as median from (select nation, median(n) as plain from g group by 1) p left join m using (nation)""")
def a15_median_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Groups without weight take the plain median."""
    p = _places(spark, d).withColumn("w", F.when(F.col("nation") % 5 == 0, 0.0).otherwise(F.col("w")))
    return stats.median_with_fallback(p, ["nation"], "n", "w").withColumn("median", F.col("median").cast("double"))


@query(f"""with {_PLACES}, g as (select *, case when n between 8 and 12 then n end as x from places) select nation, round(sum(x * w) filter (where x is not null) / sum(w) filter (where x is not null), 6) as mean, round(100.0 * sum(case when x is not null then w else 0 end) / sum(w), 6) as covered from g group by 1""")
def a13_mean_with_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Mean of known values and the weight that they cover."""
    x, w = F.when(F.col("n").between(8, 12), F.col("n")), F.col("w")
    return _places(spark, d).groupBy("nation").agg(F.round(stats.weighted_mean(x, w), 6).alias("mean"), F.round(stats.coverage(x, w), 6).alias("covered"))


@query("""with t as (select l_suppkey, sum(l_extendedprice * l_discount) as a, sum(l_extendedprice) as b from lineitem group by 1) select s_nationkey, round(sum(a) / sum(b), 8) as rate from t join supplier on s_suppkey = l_suppkey group by 1""")
def a19_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    """Numerators and denominators are summed before they are divided."""
    li = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("a"), F.sum("l_extendedprice").alias("b"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(s, "l_suppkey").groupBy("s_nationkey").agg(F.round(F.sum("a") / F.sum("b"), 8).alias("rate"))


@query("""select 'both' as part, count(*) as n from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O')
union all select 'first', count(*) from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O')
union all select 'either', count(*) from (select o_custkey from orders where o_orderstatus = 'F' union select o_custkey from orders where o_orderstatus = 'O')""")
def u_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """One grouped pass tells in which sets each key is."""
    o = _t(spark, d, "orders").where("o_orderstatus in ('F', 'O')")
    keys = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    n = keys.agg(F.count_if(F.col("f") & F.col("o")).alias("both"), F.count_if(F.col("f") & ~F.col("o")).alias("first"), F.count(F.lit(1)).alias("either"))
    return n.selectExpr("stack(3, 'both', both, 'first', first, 'either', either) as (part, n)")


@query("""with p as (select p_partkey, lower(p_name) as name from part), s as (select p_partkey, case when name = 'red pla' then 10 else 0 end
  + case when list_contains(string_split(name, ' '), 'red') then 6 when contains(' ' || name, ' red') then 4 when contains(name, 'red') then 1 else 0 end
  + case when list_contains(string_split(name, ' '), 'pla') then 6 when contains(' ' || name, ' pla') then 4 when contains(name, 'pla') then 1 else 0 end
  + case when name like '% pla%' and split_part(name, ' ', -1) = 'pla' then 12 else 0 end as score from p)
select p_partkey, score from s where score > 0 order by score desc, p_partkey limit 25""")
def m14_search(spark: SparkSession, d: str) -> DataFrame:
    """The 25 best of a text search."""
    p = _t(spark, d, "part").select("p_partkey", X.search_score(F.col("p_name"), "red pla", surname=True).alias("score"))
    return p.where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(25)


@query(f"""with {_PAIRS}, h as (select c_id, s_id, 2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) * 1.2 as mi from c, s)
select c_id, count(distinct l_orderkey) as items from h join lineitem on l_suppkey = s_id where floor(mi + 0.5) <= 50 and l_quantity > 48 group by 1""")
def g21_finder(spark: SparkSession, d: str) -> DataFrame:
    """Different items within 50 miles, 1.2 times the great-circle distance, rounded."""
    return _finder(spark, d, _t(spark, d, "lineitem").where("l_quantity > 48"))


def _finder(spark, d, li) -> DataFrame:
    items = li.where("l_orderkey is not null").select(F.col("l_suppkey").alias("s_id"), "l_orderkey")
    whole = lambda mi: F.floor(mi * 1.2 + 0.5)
    found = geo.distinct_within(_points(spark, d, "c"), "c_id", _points(spark, d, "s"), "s_id", items, "l_orderkey", 44.0, (50,), geo.haversine, whole)
    return found.select("c_id", F.col("within_50").alias("items"))


@query(SQL["g21_finder"].replace(" and l_quantity > 48", ""))
def g21_finder_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same over all of lineitem."""
    return _finder(spark, d, _t(spark, d, "lineitem"))


@query("""select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as label from orders where o_totalprice > 450000""")
def p3_code_map(spark: SparkSession, d: str) -> DataFrame:
    """Codes mapped with a default."""
    return _labels(_t(spark, d, "orders").where("o_totalprice > 450000"))


def _labels(orders) -> DataFrame:
    known = F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))
    return orders.select("o_orderkey", F.coalesce(known[F.col("o_orderstatus")], F.lit("other")).alias("label"))


@query(SQL["p3_code_map"].replace(" where o_totalprice > 450000", ""))
def p3_code_map_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same over all orders."""
    return _labels(_t(spark, d, "orders"))


#: A concave shape with a hole around each nation's centre: offsets of its points by ring.
_SHAPE = (((-3.0, -1.5), (3.0, -1.5), (2.0, 0.25), (3.0, 1.5), (-3.0, 1.5)), ((-1.0, -0.5), (0.5, -0.5), (0.0, 0.75)))


def _shapes(spark, d) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    x, y = -97 + (k % 5) * 6.0, 31.5 + F.floor(k / 5) * 3.0
    rings = F.array(*(F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ring)) for ring in _SHAPE))
    return _t(spark, d, "nation").select(k.alias("nation"), rings.alias("rings"))


_SIDES = (
    "sides as (select n_nationkey::bigint as nation, r, -97 + (n_nationkey % 5) * 6.0 + x1 as x1, 31.5 + (n_nationkey // 5) * 3.0 + y1 as y1, -97 + (n_nationkey % 5) * 6.0 + x2 as x2, 31.5 + (n_nationkey // 5) * 3.0 + y2 as y2 from nation, (values "
    + ", ".join(f"({r}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for r, ring in enumerate(_SHAPE) for a, b in zip(ring, ring[1:] + ring[:1]))
    + ") t(r, x1, y1, x2, y2))"
)
_XY = "p as (select c_custkey as c_id, -100 + (c_custkey * 104729 % 3000) / 100.0 as x, 30 + (c_custkey * 7919 % 1500) / 100.0 as y from customer)"


@query(f"""with {_SIDES}, {_XY},
odd as (select c_id, nation, r, count(*) filter (where (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 as hit from p, sides group by 1, 2, 3),
inside as (select c_id, min(nation) as nation from (select c_id, nation from odd group by 1, 2 having bool_or(hit and r = 0) and not bool_or(hit and r = 1)) group by 1),
foot as (select c_id, nation, x, y, x1, y1, x2 - x1 as dx, y2 - y1 as dy, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as t from p, sides where c_id not in (select c_id from inside)),
near as (select c_id, nation, min(sqrt(pow(x - x1 - t * dx, 2) + pow(y - y1 - t * dy, 2))) as away from foot group by 1, 2)
select c_id, nation, 0.0::double as away from inside
union all select c_id, nation, round(away, 6) as away from (select *, row_number() over (partition by c_id order by away, nation) as k from near where away <= 0.3) where k = 1""")
def j10_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """The nation's shape that a customer lies in, or at most 0.3 from."""
    points = _points(spark, d, "c").withColumnsRenamed({"lon": "x", "lat": "y"})
    return _rounded(polygons.locate(points, _shapes(spark, d), "c_id", "nation", cell=1.5, within=0.3), "away")


@query(f"""with {_SIDES}, e as (select nation, r, abs(sum(2 * atan2(tan(radians(x2 - x1) / 2) * (tan(radians(y1) / 2) + tan(radians(y2) / 2)), 1 + tan(radians(y1) / 2) * tan(radians(y2) / 2)))) as a from sides group by 1, 2)
select nation, round(sum(case when r = 0 then a else -a end) * 3958.8 * 3958.8, 3) as square_miles from e group by 1""")
def x20_spherical_area(spark: SparkSession, d: str) -> DataFrame:
    """Areas on the sphere, holes taken out."""
    return _shapes(spark, d).select("nation", F.round(polygons.spherical_area(F.col("rings")) * geo.EARTH_MILES**2, 3).alias("square_miles"))


@query(f"""with {_XY}, k as (select sqrt(0.00669438002290) as e, 0.00669438002290 as e2),
s as (select c_id, x, sin(radians(v)) as s, w from (select c_id, x, y as v, 'p' as w from p union all select null, null, 29.5, '1' union all select null, null, 45.5, '2' union all select null, null, 23.0, '0')),
q as (select c_id, x, w, (1 - s * s) / (1 - e2 * s * s) as m, (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) as q from s, k),
c as (select a.m as m1, a.q as q1, z.q as q0, (a.m - b.m) / (b.q - a.q) as n from q a, q b, q z where a.w = '1' and b.w = '2' and z.w = '0'),
r as (select c_id, x, n, 6378137.0 * sqrt(m1 + n * q1 - n * q) / n as rho, 6378137.0 * sqrt(m1 + n * q1 - n * q0) / n as rho0 from q, c where w = 'p')
select c_id, round(rho * sin(n * radians(x + 96)), 3) as east, round(rho0 - rho * cos(n * radians(x + 96)), 3) as north from r""")
def x19_equal_area(spark: SparkSession, d: str) -> DataFrame:
    """customers' places in metres of the equal-area projection."""
    east, north = polygons.albers(F.col("lon"), F.col("lat"))
    return _points(spark, d, "c").select("c_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("""with recursive p as (select p_partkey as id, p_size as block, list_sort(list_distinct(string_split(case when p_partkey % 7 = 0 then left(p_name, 1) else '' end || p_name, ' '))) as words from part),
k as (select min(id) as id, block, words from p group by 2, 3),
w as (select a.id as u, b.id as v, list_filter(a.words, lambda x: not list_contains(b.words, x)) as one, list_filter(b.words, lambda x: not list_contains(a.words, x)) as two from k a join k b on a.block = b.block and len(a.words) = len(b.words) and a.id <> b.id),
e as (select u, v from w where len(one) = 1 and len(two) = 1 and greatest(length(one[1]), length(two[1])) >= 5 and damerau_levenshtein(one[1], two[1]) = 1),
r(n, c) as (select id, id from k union select v, c from r join e on u = n)
select p.id::bigint as p_partkey, min(c)::bigint as entity from p join k on p.block = k.block and p.words = k.words join r on n = k.id group by 1""")
def g19_entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one size whose names are one but for case, order, punctuation or a letter; some names get such slips."""
    slip = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.left("p_name", F.lit(1)), "p_name")).otherwise(F.col("p_name"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper(slip), F.lit("."))).otherwise(slip)
    return entities.resolve(spark, _t(spark, d, "part").withColumn("name", name), "p_partkey", ["p_size"], "name")


@query("""with c as (select l_suppkey, l_returnflag as flag, count(*) as n from lineitem where l_returnflag is not null group by 1, 2),
b as (select *, row_number() over (partition by l_suppkey order by n desc, flag) as k, sum(n) over (partition by l_suppkey) as total from c)
select l_suppkey, flag, n::bigint as n, total::bigint as total from b where k = 1 and total >= 2 and 20 * n >= 7 * total""")
def g17_majority(spark: SparkSession, d: str) -> DataFrame:
    """The return flag of 7 in 20 or more of a supplier's lines."""
    rows = _t(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("flag"))
    return evidence.majority(rows, ["l_suppkey"], "flag", share=(7, 20))


# the other modules of queries, which use this one's tables
from . import queries_fields, queries_sites, queries_sources, queries_tables  # noqa: E402, F401
