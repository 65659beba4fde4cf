"""Queries of tables made of grouped rows, of people and places on areas, and of road graphs, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import areas, graph, network, stats, tables
from .queries import _PAIRS, _PLACES, _places, _points
from .registry import query
from .registry import table as _t


@query("select case o_orderstatus when 'F' then 'kept' when 'P' then 'flagged' end as decision, o_orderkey, o_custkey from orders where o_orderstatus in ('F', 'P')")
def r1_audit(spark: SparkSession, d: str) -> DataFrame:
    """The rows on which something was decided, with its wording."""
    o = _t(spark, d, "orders")
    return tables.audit(o, F.col("o_orderstatus"), {"F": "kept", "P": "flagged"}, ["o_orderkey"], ["o_orderkey", "o_custkey"])


@query("select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then '' else c_nationkey::varchar end as key from customer")
def r2_blank_where(spark: SparkSession, d: str) -> DataFrame:
    """R2: own keys, empty for some methods."""
    c = _t(spark, d, "customer")
    return c.select("c_custkey", tables.blank_where(F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("key"))


@query("""with b as (select l_partkey, count(*) as busy from lineitem group by 1), c as (select l_suppkey, l_partkey, count(*) filter (where l_returnflag = 'R') as kin from lineitem group by 1, 2)
select l_suppkey, l_partkey from (select c.*, row_number() over (partition by l_suppkey order by kin desc, busy desc, l_partkey) as k from c join b using (l_partkey)) where k = 1""")
def r3_usual_code(spark: SparkSession, d: str) -> DataFrame:
    """The part of most returned lines of a supplier, ties to the busiest, then the lowest."""
    return tables.usual_code(_t(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", F.col("l_returnflag") == "R")


@query("""with m as (select c_nationkey, c_mktsegment as seg, row_number() over (partition by c_nationkey order by count(*) desc, c_mktsegment) as k from customer group by 1, 2)
select c_nationkey, count(distinct c_custkey) as n_items, any_value(seg) as c_mktsegment from customer join (select c_nationkey, seg from m where k = 1) using (c_nationkey) group by 1""")
def r4_universe(spark: SparkSession, d: str) -> DataFrame:
    """A row a nation with its usual segment and number of customers."""
    return tables.universe(_t(spark, d, "customer"), ["c_nationkey"], ["c_mktsegment"], "c_custkey")


@query("select l_partkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags from lineitem group by 1")
def r6_members(spark: SparkSession, d: str) -> DataFrame:
    """Sorted different flags of a part."""
    return tables.members(_t(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", "flags").select("l_partkey", F.array_join("flags", ",").alias("flags"))


@query("select l_suppkey, l_returnflag, l_linestatus, l_linenumber, l_quantity, l_tax, count(distinct l_orderkey) as n_items, min(l_orderkey) as first_item, max(l_orderkey) as last_item from lineitem group by 1, 2, 3, 4, 5, 6")
def r7_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries by six keys."""
    return tables.entries(_t(spark, d, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_tax"], "l_orderkey")


@query("""with x as (select l_orderkey, bool_and(l_returnflag = 'R') as doubtful, count(*) as n from lineitem group by 1)
select o_orderkey, case when doubtful then 'all ' || n || ' lines were returned' end as note from orders left join x on l_orderkey = o_orderkey""")
def r8_r9_doubts(spark: SparkSession, d: str) -> DataFrame:
    """Orders of which every line is flagged, and the note on them."""
    doubts = tables.only_doubtful(_t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], F.col("l_returnflag") == "R")
    return tables.doubt_note(_t(spark, d, "orders").select("o_orderkey"), doubts, ["o_orderkey"], "all %d lines were returned")


@query("""with n as (select distinct p_size, case when p_partkey % 5 = 0 then p_name || ' PLATED' else p_name end as name from part)
select a.p_size, a.name as shorter, b.name as longer from n a join n b on a.p_size = b.p_size and a.name <> b.name and length(a.name) >= 8 and contains(b.name, a.name)""")
def r10_contained_names(spark: SparkSession, d: str) -> DataFrame:
    """Names within names of the same size."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" PLATED"))).otherwise(F.col("p_name"))
    return tables.contained_names(_t(spark, d, "part").withColumn("name", name), ["p_size"], "name")


@query("select distinct case when c_mktsegment = 'BUILDING' then 'N' || c_nationkey when c_mktsegment = 'MACHINERY' then 'N' || c_nationkey || '-' || lpad((c_custkey % 7)::varchar, 2, '0') end as unit from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def r11_map_units(spark: SparkSession, d: str) -> DataFrame:
    """The units of a map that rows stand on, states or districts."""
    nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    unit = F.when(F.col("c_mktsegment") == "BUILDING", nation).when(F.col("c_mktsegment") == "MACHINERY", F.concat(nation, F.lit("-"), F.lpad((F.col("c_custkey") % 7).cast("string"), 2, "0")))
    return tables.map_units(_t(spark, d, "customer"), unit)


@query("select c_custkey, case c_nationkey when 3 then 30 when 7 then 31 else c_nationkey end as nation from customer")
def r14_remap(spark: SparkSession, d: str) -> DataFrame:
    """Old codes replaced by new ones."""
    codes = spark.createDataFrame([(3, 30), (7, 31)], "old int, new int")
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return tables.remap(c, "nation", codes).select("c_custkey", "nation")


@query(r"""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) as word from documents)
select doc_id, 'tion' as label, word from w where regexp_matches(word, '^\p{L}+tion') and word not in ('station', 'nation')""")
def r15_mid_word(spark: SparkSession, d: str) -> DataFrame:
    """Matches inside words, but for allowed words."""
    allowed = spark.createDataFrame([("tion", "station"), ("tion", "nation")], "label string, word string")
    return tables.mid_word(_t(spark, d, "documents"), "doc_id", "text", [("tion", "tion")], allowed)


@query("select c_custkey, c_mktsegment from customer order by md5(c_custkey::varchar || '7'), c_custkey limit 40")
def r16_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample that is the same at every run."""
    return tables.seeded_sample(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 40, "7")


@query("select doc_id, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]*tion'))), 1, 6), ',') as terms from documents")
def r17_terms(spark: SparkSession, d: str) -> DataFrame:
    """The first six different terms of whole texts."""
    return _t(spark, d, "documents").select("doc_id", F.array_join(tables.terms(F.col("text"), "[a-z]*tion"), ",").alias("terms"))


@query(f"with {_PLACES} select nation, round(sum(w), 4) as weight, round(100 * sum(case when n < 5 then w else 0 end) / sum(w), 6) as few, round(100 * sum(case when segment = 'BUILDING' then w else 0 end) / sum(w), 6) as building from places group by 1")
def r20_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of weight under flags, by area."""
    out = tables.term_shares(_places(spark, d), "nation", {"few": F.col("n") < 5, "building": F.col("segment") == "BUILDING"}, "w")
    return out.select("nation", F.round("weight", 4).alias("weight"), F.round("few", 6).alias("few"), F.round("building", 6).alias("building"))


@query(f"with {_PLACES} select nation, round(sum(w), 4) as w from places group by 1 order by w desc, nation limit 10")
def r21_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The ten nations of most weight."""
    return tables.leaderboard(_places(spark, d).groupBy("nation").agg(F.round(F.sum("w"), 4).alias("w")), "w", "nation")


@query("select label, count(*) as n from (select unnest(string_split(p_name, ' ')) as label from part) group by 1 order by n desc, label limit 10")
def a30_top_facets(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent labels."""
    return tables.top_facets(_t(spark, d, "part").withColumn("labels", F.split("p_name", " ")), "labels")


@query("select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by floor(s_acctbal / 1000) desc, s_suppkey) as place from supplier")
def w4_places(spark: SparkSession, d: str) -> DataFrame:
    """Places 1 to n, equal values in the order that they came in."""
    s = _t(spark, d, "supplier").withColumn("v", F.floor(F.col("s_acctbal") / 1000))
    return tables.place_of(s, ["s_nationkey"], "v", "s_suppkey").select("s_nationkey", "s_suppkey", F.col("place").cast("long").alias("place"))


@query("""with e as (select event_type, date_trunc('day', ts) as day, count(*) as n from events group by 1, 2)
select event_type, strftime(day, '%Y-%m-%d') as day, n, n - lag(n) over w as n_change, lead(day) over w is null as current from e window w as (partition by event_type order by day)""")
def w10_history(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts with their change and the current one marked."""
    e = _t(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return tables.history(e, ["event_type"], "day", ["n"])


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = 1 and l_returnflag = 'R')")
def m15_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Items that aren't done yet."""
    done = _t(spark, d, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.to_do(_t(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


_ROUTED = f"{_PLACES}, r as (select c_custkey, nation, segment, w, case when c_custkey % 9 = 0 or nation = 4 then 999.0 else (c_custkey * 37 % 400) / 3.0 end as mi, case when nation % 6 = 5 then 0.0 else w end as v from places)"


def _routed(spark, d) -> DataFrame:
    mi = F.when((F.col("c_custkey") % 9 == 0) | (F.col("nation") == 4), 999.0).otherwise((F.col("c_custkey") * 37 % 400) / 3.0)
    return _places(spark, d).withColumn("mi", mi).withColumn("v", F.when(F.col("nation") % 6 == 5, 0.0).otherwise(F.col("w")))


@query(f"""with {_ROUTED}, s as (select nation, mi, sum(w) as w from r where mi < 999 group by 1, 2), t as (select *, sum(w) over (partition by nation order by mi) as run, sum(w) over (partition by nation) as total from s)
select n.nation, coalesce(floor(m + 0.5), 999)::bigint as median from (select distinct nation from r) n left join (select nation, min(mi) as m from t where run >= total / 2 group by 1) x using (nation)""")
def a14_routed_median(spark: SparkSession, d: str) -> DataFrame:
    """Medians of routed rows, 999 for areas of none."""
    return areas.routed_median(_routed(spark, d), ["nation"], "mi", "w")


@query(f"""with {_ROUTED}, s as (select nation, mi, sum(v) as v from r where mi < 999 and v > 0 group by 1, 2), t as (select *, sum(v) over (partition by nation order by mi) as run, sum(v) over (partition by nation) as total from s),
a as (select nation, min(mi) as m from t where run >= total / 2 group by 1), p as (select nation, median(mi) as m, count(*) as n from r where mi < 999 group by 1)
select n.nation, round(coalesce(a.m, p.m, 999), 6) as median, coalesce(p.n, 0) as n_routed from (select distinct nation from r) n left join a using (nation) left join p using (nation)""")
def a15_routed_median(spark: SparkSession, d: str) -> DataFrame:
    """The same with the plain median where routed rows have no weight, and how many there are."""
    return areas.routed_median_or_plain(_routed(spark, d), ["nation"], "mi", "v").withColumn("median", F.round("median", 6))


@query(f"""with {_ROUTED}, s as (select nation, segment, sum(w) filter (where mi < 100) as a, sum(w) as b from r group by 1, 2)
select nation, segment as mode from (select *, row_number() over (partition by nation order by a is null, coalesce(a, b) desc, segment) as k from s) where k = 1""")
def a16_routed_mode(spark: SparkSession, d: str) -> DataFrame:
    """The segment of most weight among rows of a route, of the others only where there is none."""
    return areas.routed_mode(_routed(spark, d), ["nation"], "segment", "w", F.col("mi") < 100)


@query(f"""with {_PAIRS}, w as (select c_custkey as c_id, c_acctbal as w from customer where c_acctbal > 0),
near as (select s_id, sum(w) as people from (select p.s_id, p.c_id, sqrt(pow(69 * (c.lat - s.lat), 2) + pow(69 * cos(radians(s.lat)) * (c.lon - s.lon), 2)) as mi from pairs p join s using (s_id) join c using (c_id)) join w using (c_id) where mi <= 25 group by 1),
one as (select s_id, w, row_number() over (partition by s_id order by mi, c_id) as k from (select p.s_id, p.c_id, sqrt(pow(69 * (c.lat - s.lat), 2) + pow(69 * cos(radians(s.lat)) * (c.lon - s.lon), 2)) as mi from pairs p join s using (s_id) join c using (c_id)) join w using (c_id) where mi <= 400)
select s.s_id, round(coalesce(n.people, least(o.w, 500), 0), 4) as people from s left join near n using (s_id) left join one o on o.s_id = s.s_id and o.k = 1""")
def a29_people_near(spark: SparkSession, d: str) -> DataFrame:
    """Weight of customers within 25 miles of a supplier, else of the nearest."""
    c = _points(spark, d, "c").join(_t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("c_id"), F.col("c_acctbal").alias("w")), "c_id")
    return areas.people_near(_points(spark, d, "s"), c, "s_id", "c_id", "w", 25.0).select("s_id", F.round("people", 4).alias("people"))


@query(f"""with {_PLACES}, {_PAIRS}, u as (select c_id, min(mi) as mi from pairs group by 1), j as (select nation, w, mi, case when c_custkey % 8 = 0 then null else mi * (1 + c_custkey % 5) end as road from places join u on c_id = c_custkey)
select nation, count(*) as units, round(sum(w), 4) as w from j where mi <= 20 and (road is null or road > 60) and nation not in (2, 15) group by 1""")
def g11_far_by_road(spark: SparkSession, d: str) -> DataFrame:
    """Customers near a supplier in a straight line and far by road."""
    from .operators import geo

    near = geo.nearest_in_widening_rings(_points(spark, d, "c"), _points(spark, d, "s"), "c_id", "s_id", (20.0,)).select(F.col("c_id").alias("c_custkey"), "mi")
    road = F.when(F.col("c_custkey") % 8 != 0, F.col("mi") * (1 + F.col("c_custkey") % 5))
    units = _places(spark, d).join(near, "c_custkey").withColumn("road", road)
    return areas.far_by_road(units, "mi", "road", "nation", "w", excluded=(2, 15)).withColumn("w", F.round("w", 4))


@query("""with k as (select c_nationkey as area, case when c_custkey % 4 = 0 then 0 else c_acctbal end as w, 30 + (c_custkey * 7919 % 1500) / 100.0 as lat, -100 + (c_custkey * 104729 % 3000) / 100.0 as lon from customer),
p as (select area, sum(w) as w, sum(w * cos(radians(lat)) * cos(radians(lon))) as x, sum(w * cos(radians(lat)) * sin(radians(lon))) as y, sum(w * sin(radians(lat))) as z from k where w > 0 group by 1),
c as (select area, w, degrees(atan2(z, sqrt(x * x + y * y))) as clat, degrees(atan2(y, x)) as clon from p),
t as (select n_nationkey as area, 30.0 + n_nationkey / 2.0 as plat, -95.0 as plon, n_nationkey * 15000.0 + 10000 as total from nation),
q as (select s_nationkey as area, 36.0 + s_suppkey % 4 as qlat, -85.0 + s_suppkey % 5 as qlon from supplier where s_suppkey % 3 = 0),
a as (select area, min(sqrt(pow(69 * (qlat - clat), 2) + pow(69 * cos(radians(clat)) * (qlon - clon), 2))) as away from c join q using (area) group by 1),
f as (select t.area, plat, plon, clat, clon, w / total as coverage, case when not coalesce(w / total between 0.5 and 2, false) then 'coverage' when away > 150 then 'place' else 'parts' end as source from t left join c using (area) left join a using (area))
select area, round(case when source = 'parts' then clat else plat end, 6) as lat, round(case when source = 'parts' then clon else plon end, 6) as lon, round(coverage, 6) as coverage, source from f""")
def g20_centres(spark: SparkSession, d: str) -> DataFrame:
    """Centres of nations where the parts cover their total and a place lies near."""
    k, s, n = F.col("c_custkey"), F.col("s_suppkey"), F.col("n_nationkey")
    parts = _t(spark, d, "customer").select(F.col("c_nationkey").alias("area"), F.when(k % 4 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("w"), (30 + (k * 7919 % 1500) / 100.0).alias("lat"), (-100 + (k * 104729 % 3000) / 100.0).alias("lon"))
    control = _t(spark, d, "nation").select(n.alias("area"), (n * 15000.0 + 10000).alias("total"), (30.0 + n / 2.0).alias("lat"), F.lit(-95.0).alias("lon"))
    places = _t(spark, d, "supplier").where(s % 3 == 0).select(F.col("s_nationkey").alias("area"), (36.0 + s % 4).alias("lat"), (-85.0 + s % 5).alias("lon"))
    out = areas.centres(parts, "area", "w", control, "total", places, close=150.0)
    return out.select("area", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("coverage", 6).alias("coverage"), "source")


@query("""with p as (select l_suppkey, l_partkey, sum(l_quantity) as land from lineitem group by 1, 2), t as (select *, land / sum(land) over (partition by l_partkey) as share from p)
select l_suppkey, round(sum(share * p_retailprice), 4) as w from t join part on p_partkey = l_partkey group by 1""")
def g22_apportion(spark: SparkSession, d: str) -> DataFrame:
    """Prices of parts shared out to suppliers by quantity."""
    p = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("land"))
    people = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("w"))
    return areas.apportion(p, people, "l_suppkey", "l_partkey", "land", "w").withColumn("w", F.round("w", 4))


@query("""with s as (select s_suppkey, s_nationkey, s_acctbal, rank() over (order by s_acctbal desc) as overall, count(*) over (partition by s_acctbal) - 1 as ties from supplier) select s_suppkey, overall, ties from s""")
def w5_global_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over all rows, counted up by ranges."""
    return tables.global_ranks(_t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", "overall", "ties")


@query("select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 4) as p10, round(quantile_cont(l_extendedprice, 1/3), 4) as third, round(median(l_extendedprice), 4) as med, round(quantile_cont(l_extendedprice, 0.9), 4) as p90 from lineitem group by 1, 2")
def a23_exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of all of lineitem without a buffer of its values."""
    out = tables.exact_quantiles(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p10": 0.1, "third": 1 / 3, "med": 0.5, "p90": 0.9})
    return out.select("l_returnflag", "l_linestatus", *(F.round(c, 4).alias(c) for c in ("p10", "third", "med", "p90")))


_LINES = """l as (select s_suppkey as line, case when s_suppkey % 3 = 0 then 'fast' else 'slow' end as kind, (s_suppkey % 40) * 1000.0 as x, (s_suppkey * 7 % 40) * 1000.0 as y from supplier),
s as (select line, kind, x as x1, y as y1, x + 1000.0 as x2, y as y2 from l union all select line, kind, x + 1000.0, y, x + 1000.0, y + 1000.0 from l),
p as (select line, kind, x1 + (x2 - x1) * i / 3 as x1, y1 + (y2 - y1) * i / 3 as y1, x1 + (x2 - x1) * (i + 1) / 3 as x2, y1 + (y2 - y1) * (i + 1) / 3 as y2 from s, (select unnest([0, 1, 2]) as i))"""


def _lines(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k % 40) * 1000.0, (k * 7 % 40) * 1000.0
    points = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0))))
    return _t(spark, d, "supplier").select(k.alias("line"), F.when(k % 3 == 0, "fast").otherwise("slow").alias("kind"), points.alias("points"))


@query(f"""with {_LINES}, e as (select least(round(x1) * 1000000 + round(y1), round(x2) * 1000000 + round(y2)) as a, greatest(round(x1) * 1000000 + round(y1), round(x2) * 1000000 + round(y2)) as b, min(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 1609.344) as mi, min(case when kind = 'fast' then 60 else 30 end) as slow, max(case when kind = 'fast' then 60 else 30 end) as fast from p group by 1, 2)
select count(*) as edges, round(sum(mi), 6) as miles, (select count(*) from (select a from e union select b from e)) as nodes from e""")
def g1_graph(spark: SparkSession, d: str) -> DataFrame:
    """G1: a road graph from lines: cut to 400 m, met to the metre, parallel edges reduced."""
    nodes, edges = network.edges_of(_lines(spark, d), {"fast": 60, "slow": 30})
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("mi"), 6).alias("miles")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes")))  # one row each


@query()
def g1_g3_connected(spark: SparkSession, d: str) -> DataFrame:
    """The graph with connectors and bridges, and which fragments are eligible."""
    nodes, edges = network.edges_of(_lines(spark, d), {"fast": 60, "slow": 30})
    edges = edges.unionByName(network.connectors(nodes, edges)).unionByName(network.bridges(spark, nodes, edges, within=1_500.0))
    marked, new = network.eligible(spark, nodes, edges, least=7, within=2_500.0)
    return marked.groupBy("component", "eligible").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"with {_PAIRS}, u as (select c_id, s_id, mi from (select *, row_number() over (partition by c_id order by mi, s_id) as k from pairs where mi <= 60) where k = 1), o as (select c_custkey as c_id from customer where c_nationkey % 5 = 0) select coalesce(u.c_id, o.c_id) as c_id, round(case when o.c_id is not null then 0 else mi end, 6) as mi from u full join o on u.c_id = o.c_id")
def g8_own_zero(spark: SparkSession, d: str) -> DataFrame:
    """Distances are 0 inside a target."""
    from .operators import geo

    near = geo.nearest_in_widening_rings(_points(spark, d, "c"), _points(spark, d, "s"), "c_id", "s_id", (60.0,)).select("c_id", "mi")
    own = _t(spark, d, "customer").where("c_nationkey % 5 = 0").select(F.col("c_custkey").alias("c_id"))
    return network.own_zero(near, own, "c_id").select("c_id", F.round("mi", 6).alias("mi"))


@query("select count(distinct (c_custkey % 83, c_custkey % 7)) as points, count(*) as rows from customer")
def g9_site_points(spark: SparkSession, d: str) -> DataFrame:
    """Rows at one place to four decimals are one point."""
    k = F.col("c_custkey")
    rows = _t(spark, d, "customer").select((30 + (k % 83) / 100.0 + (k % 2) / 1e6).alias("lat"), (-100 + (k % 7) / 100.0).alias("lon"))
    return network.site_points(rows, "lat", "lon").agg(F.count_distinct("point").alias("points"), F.count(F.lit(1)).alias("rows"))


@query(f"""with {_PAIRS}, w as (select c_id, s_id, mi, mi * (1 + (c_id % 30 - 10) / 100.0) as published from pairs where mi between 1 and 60)
select c_id, s_id, round(100 * abs(mi - published) / published, 4) as pct, 100 * abs(mi - published) / published <= 15 as ok from w""")
def g12_route_errors(spark: SparkSession, d: str) -> DataFrame:
    """Distances against published ones."""
    from .operators import geo

    found = geo.radius_join(_points(spark, d, "c"), _points(spark, d, "s"), 60.0).where("mi >= 1").select("c_id", "s_id", "mi")
    published = found.select("c_id", "s_id", (F.col("mi") * (1 + (F.col("c_id") % 30 - 10) / 100.0)).alias("mi"))
    return network.route_errors(found, published, ["c_id", "s_id"]).select("c_id", "s_id", F.round("pct", 4).alias("pct"), "ok")


@query("with p as (select l_suppkey, sum(l_quantity) as q from lineitem group by 1), t as (select l_suppkey, floor(sum(l_quantity) * 1.1) as q from lineitem where l_suppkey % 6 <> 0 group by 1) select l_suppkey, round(100 * (p.q - t.q) / t.q, 6) as pct from t left join p using (l_suppkey)")
def r12_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Sums of parts against published totals."""
    from .operators import quality

    li = _t(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("q"))
    totals = li.where("l_suppkey % 6 <> 0").groupBy("l_suppkey").agg(F.floor(F.sum("q") * 1.1).alias("q"))
    return quality.reconcile(li, totals, "l_suppkey", "q").select("l_suppkey", F.round("pct", 6).alias("pct"))


@query("select l_suppkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags, count(distinct l_partkey) as parts from lineitem group by 1")
def a27_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets as aggregates."""
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_partkey").alias("parts"))


@query("select value, count(*) as n, min(p_partkey) as first, max(p_partkey) as last from (select p_partkey, unnest(list_distinct(string_split(p_name, ' '))) as value from part) group by 1")
def j16_index(spark: SparkSession, d: str) -> DataFrame:
    """An inverted index of words, told by its lists' sizes and ends."""
    from .operators import joins

    out = joins.collect_index(_t(spark, d, "part").withColumn("words", F.split("p_name", " ")), "p_partkey", "words")
    return out.select("value", F.size("keys").cast("long").alias("n"), F.array_min("keys").alias("first"), F.array_max("keys").alias("last"))


@query("""with s as (select p_partkey, string_split(p_name, ' ') as w from part where p_partkey % 40 = 0), l as (select p_partkey, list_concat(string_split(p_name, ' '), [p_brand]) as w from part where p_partkey % 7 = 0)
select s.p_partkey as a_id, l.p_partkey as b_id from s, l where (len(list_filter(s.w, lambda x: not list_contains(l.w, x))) = 0 or len(list_filter(l.w, lambda x: not list_contains(s.w, x))) = 0) and len(list_distinct(s.w)) >= 2""")
def j15_subset_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token sets within one another."""
    from .operators import joins

    p = _t(spark, d, "part")
    small = p.where("p_partkey % 40 = 0").select("p_partkey", F.split("p_name", " ").alias("w"))
    large = p.where("p_partkey % 7 = 0").select("p_partkey", F.array_append(F.split("p_name", " "), F.col("p_brand")).alias("w"))
    return joins.subset_pairs(small, large, "p_partkey", "w")


@query("select o_orderkey, case when o_custkey % 4 = 0 then -1.0 else o_totalprice end as price from orders")
def u4_splice(spark: SparkSession, d: str) -> DataFrame:
    """U4: rows under a condition replaced by those of another source."""
    from .operators import joins

    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return joins.splice(o, o.where("o_custkey % 4 = 0").withColumn("price", F.lit(-1.0)), F.col("o_custkey") % 4 == 0).select("o_orderkey", "price")


@query("select c_custkey, case when c_acctbal < 0 then null when c_acctbal > 30.5 and floor(c_acctbal + 0.5) <= 30 then 31 else floor(c_acctbal + 0.5) end as r, 1 as one from customer where c_acctbal >= 0")
def p11_non_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Whole miles that don't round onto a bound."""
    from .functions import text as X

    return _t(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", X.non_crossing(F.col("c_acctbal"), 30).cast("double").alias("r"), F.lit(1).alias("one"))


@query("select p_partkey, case p_size % 5 when 0 then 18.0 when 1 then 0.5 when 2 then 52.0 / 52 when 3 then 10.0 / 365 end as years, case p_size % 5 when 0 then '00042' when 1 then null when 2 then '48201' when 3 then '12345' end as zip from part")
def p4_x8_ages_and_codes(spark: SparkSession, d: str) -> DataFrame:
    """Ages of text in years, and codes of five digits."""
    from .functions import text as X

    at = (F.col("p_size") % 5).cast("int")
    ages, codes = F.array(*map(F.lit, ("18 Years", "6 Months", "52 Weeks", "10 Days", "N/A"))), F.array(*map(F.lit, ("00042", "088901", "48201-1234", "123456789", "x")))
    return _t(spark, d, "part").select("p_partkey", X.age_years(F.get(ages, at)).alias("years"), X.zip5(F.get(codes, at)).alias("zip"))


@query("select p_partkey, unnest(case when p_size % 2 = 0 then ['saint jo', 'st jo'] else ['mt elk', 'mount elk'] end) as spelling, unnest(['a', 'b']) as nth from part")
def x5_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Other spellings of a name, in order."""
    from .functions import text as X

    name = F.when(F.col("p_size") % 2 == 0, "saint jo").otherwise("mt elk")
    out = _t(spark, d, "part").select("p_partkey", F.posexplode(X.spellings(name)).alias("i", "spelling"))
    return out.select("p_partkey", "spelling", F.when(F.col("i") == 0, "a").otherwise("b").alias("nth"))


@query("""with c as (select s_suppkey, lpad((s_suppkey * 37 % 90000 + 10000)::varchar, 5, '0') as z from supplier),
s as (select s_suppkey, z, left(z, i) || dg || substr(z, i + 2) as slip from c, (select unnest(range(5)) as i), (select unnest(range(10)) as dg) union select s_suppkey, z, left(z, i) || substr(z, i + 2, 1) || substr(z, i + 1, 1) || substr(z, i + 3) from c, (select unnest(range(4)) as i))
select s_suppkey, count(*) as slips, min(slip) as least from s where slip <> z group by 1""")
def x9_slips(spark: SparkSession, d: str) -> DataFrame:
    """Codes one slip away."""
    from .functions import text as X

    z = F.lpad((F.col("s_suppkey") * 37 % 90000 + 10000).cast("string"), 5, "0")
    s = _t(spark, d, "supplier").select("s_suppkey", X.digit_slips(z).alias("s"))
    return s.select("s_suppkey", F.size("s").cast("long").alias("slips"), F.array_min("s").alias("least"))


@query("""with t as (select p_partkey, p_name || '; ' || p_type || '; ' || p_brand as v, p_name as a, p_name || '; ' || p_type as b from part)
select p_partkey, case when length(v) <= 30 then v when length(b) <= 30 then b else a end as cut from t""")
def r18_cut_parts(spark: SparkSession, d: str) -> DataFrame:
    """Whole parts up to a length."""
    from .functions import text as X

    return _t(spark, d, "part").select("p_partkey", X.cut_parts(F.concat_ws("; ", "p_name", "p_type", "p_brand"), most=30).alias("cut"))


@query(f"""with {_PAIRS}, near as (select c_id, s_id, mi from pairs where mi <= 60), w as (select c_custkey as c_id, c_acctbal as w from customer where c_acctbal > 0)
select s_id, round(sum(w), 4) as score1, round(sum(case when c_id % 3 = 0 then w else 0 end), 4) as score2 from near join w using (c_id) where s_id % 5 <> 0 group by 1""")
def g13_scores(spark: SparkSession, d: str) -> DataFrame:
    """What each candidate that isn't excluded covers, of all units and of those of the second kind."""
    from .operators import geo

    pairs = geo.radius_join(_points(spark, d, "c"), _points(spark, d, "s"), 60.0).select(F.col("s_id").alias("candidate"), F.col("c_id").alias("unit"))
    weights = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("w"), (F.col("c_custkey") % 3 == 0).alias("second"))
    excluded = _t(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("candidate"))
    out = graph.cover_scores(pairs, weights, excluded)
    return out.select(F.col("candidate").alias("s_id"), F.round("score1", 4).alias("score1"), F.round("score2", 4).alias("score2"))


@query("select o_custkey, round(stddev_pop(o_totalprice), 4) as spread, count(*) as n from orders group by 1 having count(*) >= 12")
def a23_enough(spark: SparkSession, d: str) -> DataFrame:
    """Figures only of groups that are large enough."""
    out = _t(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.stddev_pop("o_totalprice"), 4).alias("spread"), F.count(F.lit(1)).alias("n"))
    return stats.enough(out, "n", 12)
