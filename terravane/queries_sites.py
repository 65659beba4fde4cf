"""Queries of sites' places and of the engine's tools, with the same in SQL. Sites are customers: codes, cities and names follow from
their keys; known codes and places are small tables made of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sites
from .plans import items as item_tool
from .plans import library, places
from .plans.catalog import Field, Table
from .plans.engine import Engine, query_frame
from .queries import _NATIONS, NATIONS, _nations
from .registry import query
from .registry import table as _t

_NAMES = ["north clinic", "lake cancer center", "mercy hospital", "oak street clinic", "lake cancer", "solo"]
_BASE = f"""site as (select c_custkey as id, c_custkey % 37 as item, case when c_custkey % 11 < 6 then ([{', '.join(f"'{n}'" for n in _NAMES)}])[(c_custkey % 11 + 1)::int] end as name, 'S' || (c_custkey % 3) as state, 'C' || (c_custkey % 6) as city, (10000 + (c_custkey * 7 % 100) * 13)::varchar as code from customer),
codes as (select (10000 + i * 13)::varchar as code, 'S' || (i % 3) as state, 'A' || (i % 9) as area, 40 + (i % 10) * 0.3 as lat, -90 + (i // 10) * 0.4 as lon, (i % 4) * 5.0 as radius, (i % 4) * 80.0 as size from range(90) t(i)),
places as (select 'S' || (i % 3) as state, 'C' || (i // 3 % 6) as city, 'A' || (i % 9) as area, 40 + (i // 3 % 6) * 0.5 + (i // 18) * 2.0 as lat, -90 + (i % 3) * 1.0 as lon, 3.0 as radius, 30.0 + i % 5 as size from range(24) t(i))"""
_MI = "sqrt(pow(69 * ({b}.lat - {a}.lat), 2) + pow(69 * cos(radians({a}.lat)) * ({b}.lon - {a}.lon), 2))"


def _s(c) -> F.Column:
    return F.concat(F.lit("S"), c.cast("string"))


def _site(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    name = F.get(F.array(*map(F.lit, _NAMES)), (k % 11).cast("int"))
    return _t(spark, d, "customer").select(k.alias("id"), (k % 37).alias("item"), F.when(k % 11 < 6, name).alias("name"), _s(k % 3).alias("state"), F.concat(F.lit("C"), (k % 6).cast("string")).alias("city"), (10000 + (k * 7 % 100) * 13).cast("string").alias("code"))


def _codes(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(90).select((10000 + i * 13).cast("string").alias("code"), _s(i % 3).alias("state"), F.concat(F.lit("A"), (i % 9).cast("string")).alias("area"), (40 + (i % 10) * 0.3).alias("lat"), (-90 + F.floor(i / 10) * 0.4).alias("lon"), ((i % 4) * 5.0).alias("radius"), ((i % 4) * 80.0).alias("size"))


def _towns(spark) -> DataFrame:
    i = F.col("id")
    third = F.floor(i / 3)
    return spark.range(24).select(_s(i % 3).alias("state"), F.concat(F.lit("C"), (third % 6).cast("string")).alias("city"), F.concat(F.lit("A"), (i % 9).cast("string")).alias("area"), (40 + (third % 6) * 0.5 + F.floor(i / 18) * 2.0).alias("lat"), (-90 + (i % 3) * 1.0).alias("lon"), F.lit(3.0).alias("radius"), (30.0 + i % 5).alias("size"))


@query(f"""with {_BASE}, h as (select s.*, c.lat, c.lon from site s left join codes c on c.code = s.code and s.id % 4 <> 0),
k as (select id, state, city, 0 as rank, lat, lon from h union all select id, state, 'C' || (id % 5), 1, lat, lon from h),
m as (select k.id, k.rank, p.area, p.size, {_MI.format(a='k', b='p')} as mi from k join places p on p.state = k.state and p.city = k.city)
select id, area, round(mi, 6) as miles from (select *, row_number() over (partition by id order by rank, not coalesce(mi <= 40, false), case when coalesce(mi <= 40, false) or mi is null then -size else 0 end, case when mi > 40 then mi else 0 end, area) as n from m) where n = 1""")
def j13_place_join(spark: SparkSession, d: str) -> DataFrame:
    """The place that a city names: largest within 40 miles of the code, else the nearest, else the largest."""
    points = _codes(spark).select("code", "lat", "lon")
    rows = _site(spark, d).join(points, "code", "left").withColumns({c: F.when(F.col("id") % 4 != 0, F.col(c)) for c in ("lat", "lon")})
    rows = rows.withColumn("keys", F.array("city", F.concat(F.lit("C"), (F.col("id") % 5).cast("string"))))
    return sites.place_join(rows, _towns(spark)).select("id", "area", F.round("miles", 6).alias("miles"))


_COMPARED = f"""own as (select s.*, c.lat as zlat, c.lon as zlon, c.radius as zradius, n.away, n.nlat, n.nlon from site s join codes c on c.code = s.code and c.state = s.state
join (select id, min(away) as away, arg_min(plat, (away, plat)) as nlat, arg_min(plon, (away, plat)) as nlon from (select s.id, p.lat as plat, p.lon as plon, {_MI.format(a='c', b='p')} as away from site s join codes c on c.code = s.code and c.state = s.state join places p on p.state = s.state and p.city = s.city) group by 1) n on n.id = s.id)"""


@query(f"""with {_BASE}, {_COMPARED}, g as (select * from own where away <= greatest(40, 2 * zradius) and name is not null), a as (select * from own where name is not null),
k as (select state, name, code, count(*) as k, any_value(zlat) as lat, any_value(zlon) as lon from g group by 1, 2, 3), m as (select a.id, k.k, k.code from (select id, state, name, nlat as lat, nlon as lon from a) a join k using (state, name) where {_MI.format(a='k', b='a')} <= 25)
select id, sum(k)::bigint as n, arg_min(code, (-k, code)) as code from m group by 1""")
def j14_listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings of a row's name near its city, and their most frequent code."""
    own = sites.compared(_site(spark, d), _codes(spark), _towns(spark)).where("name is not null")
    return sites.listings_near(own, own.where("away <= greatest(40, 2 * zradius)"))


def _loose(spark) -> DataFrame:
    return spark.createDataFrame([("S1", "C4")], "state string, city string")


@query("""with k as (select c_custkey as id, c_custkey * 7 % 400 as i, c_custkey < 100 and c_custkey % 3 <> 0 as slip, c_custkey * 7 % 400 % 6 <> 0 as named from customer), s as (select id, i, named, (10000 + i)::varchar as own, case when slip then left((10000 + i)::varchar, 3) || substr((10000 + i)::varchar, 5, 1) || substr((10000 + i)::varchar, 4, 1) else (10000 + i)::varchar end as code from k),
w as (select *, code <> own as wrong, code::int < 10400 as known from s), n as (select i, count(*) filter (where not wrong) as fine, count(*) filter (where wrong) as slips from w group by 1)
select id, case when fine >= 2 and named then 'listed' else 'swapped' end as rule, own as fix_code from w join n using (i) where wrong and known and (slips = 1 or not named)""")
def g16_mistyped(spark: SparkSession, d: str) -> DataFrame:
    """Codes that are typing errors, by listings and by swapped digits, with the code that is right. Towns lie at the codes, far apart."""
    i, k = F.col("id"), F.col("c_custkey") * 7 % 400
    at = ((30 + (i % 20) * 0.7).alias("lat"), (-100 + F.floor(i / 20) * 0.9).alias("lon"))
    codes = spark.range(400).select((10000 + i).cast("string").alias("code"), _s(i % 3).alias("state"), F.lit("A").alias("area"), *at, F.lit(0.0).alias("radius"))
    towns = spark.range(400).select(_s(i % 3).alias("state"), F.concat(F.lit("K"), i.cast("string")).alias("city"), *at, F.lit(3.0).alias("radius"))
    own = (10000 + k).cast("string")
    slipped = F.concat(F.left(own, F.lit(3)), F.substring(own, 5, 1), F.substring(own, 4, 1))
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("item"), F.when(k % 6 != 0, F.concat(F.lit("clinic k"), k.cast("string"))).alias("name"), _s(k % 3).alias("state"), F.concat(F.lit("K"), k.cast("string")).alias("city"), F.when((F.col("c_custkey") < 100) & (F.col("c_custkey") % 3 != 0), slipped).otherwise(own).alias("code"))
    return sites.mistyped_codes(rows, codes, towns, _loose(spark))


def _reviewable(rows: DataFrame) -> DataFrame:
    family = F.when(F.col("name").startswith("lake"), "lake")
    return rows.withColumn("family", family).withColumn("names_code", F.col("id") % 9 == 0).withColumn("names_city", F.col("id") % 7 == 0)


@query()
def g15_review(spark: SparkSession, d: str) -> DataFrame:
    """What is right where code and city disagree; tested against a plain loop."""
    rows = _reviewable(_site(spark, d))
    checked = rows.where("id % 50 = 0").select("id", F.when(F.col("id") % 100 == 0, "code").otherwise("city").alias("verdict"))
    return sites.reviewed(rows, _codes(spark), _towns(spark), _loose(spark), checked, rows.where("id % 41 = 0").select("id"))


_LADDER = f"""{_BASE}, people as (select code, 'A' || ((right(code, 1)::int + 3) % 9) as area from codes where right(code, 1)::int % 4 = 0),
regions as (select distinct left(code, 4) as code3, first_value(area) over (partition by left(code, 4) order by code) as area, first_value(state) over (partition by left(code, 4) order by code) as state from codes),
towns as (select state, city, min(area) as area from places where city <> 'C5' group by 1, 2),
r as (select s.*, id % 23 = 0 as virtual, case when id % 13 = 0 then (10000 + (id % 90) * 13)::varchar end as fix, case when id % 5 = 0 then (10000 + (id * 3 % 90) * 13)::varchar end as lcode, id % 2 = 0 as anchored, id % 10 = 1 as osc from site s),
j as (select r.*, t.area as ca, z.area as zl, z.state as zs, zp.area as zh, f.area as fl, f.state as fs, fp.area as fh, l.area as ll, lp.area as lh, g.area as ra, g.state as rs, w.items
from r left join towns t on t.state = r.state and t.city = r.city left join codes z on z.code = r.code left join people zp on zp.code = r.code left join codes f on f.code = r.fix left join people fp on fp.code = r.fix
left join codes l on l.code = r.lcode left join people lp on lp.code = r.lcode left join regions g on g.code3 = left(r.code, 4) left join (select name, code, count(distinct item) as items from site where name is not null group by 1, 2) w on w.name = r.name and w.code = r.code),
h as (select *, case when zh is not null and zh <> zl and not coalesce(ca = zl, false) then zh else zl end as zb, case when fh is not null and fh <> fl and not coalesce(ca = fl, false) then fh else fl end as fb, case when lh is not null and lh <> ll and not coalesce(ca = ll, false) then lh else ll end as lb from j),
e as (select *, case when virtual then 'virtual_site' when fix is not null and fs = state then 'zip_typo_corrected' when zs = state then case when zb <> zl then 'zip_pop' else 'zip' end when zl is not null and (osc or coalesce(items, 0) >= 2) then 'zip_state_corrected' end as m1,
case when rs = state and ca is not null and ca <> ra and not (state = 'S0' and city = 'C1' and ra = 'A3') then 'city_over_zip3' when rs = state then 'zip3' when ca is not null then 'city_gazetteer' else 'unassigned' end as m2 from h),
v as (select *, case m2 when 'city_over_zip3' then ca when 'zip3' then ra when 'city_gazetteer' then ca end as a2 from e),
x as (select *, case when m1 is not null then m1 when ll is not null and (anchored or m2 = 'unassigned') and lb is distinct from a2 then 'facility_listing' else m2 end as method from v),
y as (select id, method, case method when 'virtual_site' then null when 'zip_typo_corrected' then fb when 'zip' then zb when 'zip_pop' then zb when 'zip_state_corrected' then zb when 'facility_listing' then lb else a2 end as area, case method when 'zip_typo_corrected' then fix when 'facility_listing' then lcode end as fix_code from x)"""


@query(f"with {_LADDER} select id, case when area = 'A8' then 'outside' else method end as method, case when area <> 'A8' then area end as area, case when area is null or area <> 'A8' then fix_code end as fix_code from y")
def g14_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The area of each site by the first rule of the ladder that holds."""
    codes, i = _codes(spark), F.col("id")
    last = F.right("code", F.lit(1)).cast("int")
    people = codes.where(last % 4 == 0).select("code", F.concat(F.lit("A"), ((last + 3) % 9).cast("string")).alias("area"))
    regions = codes.groupBy(F.left("code", F.lit(4)).alias("code3")).agg(F.min_by("area", "code").alias("area"), F.min_by("state", "code").alias("state"))
    towns = _towns(spark).where("city <> 'C5'").groupBy("state", "city").agg(F.min("area").alias("area"))
    rows = _site(spark, d).withColumn("virtual", i % 23 == 0)
    cities = rows.join(towns, ["state", "city"], "left").select("id", "area", (i % 10 == 1).alias("other_state_city"))
    fixes = rows.where(i % 13 == 0).select("id", (10000 + (i % 90) * 13).cast("string").alias("fix_code"))
    listings = rows.where(i % 5 == 0).select("id", (10000 + (i * 3 % 90) * 13).cast("string").alias("code"), (i % 2 == 0).alias("anchored"))
    named = rows.where("name is not null").groupBy("name", "code").agg(F.count_distinct("item").alias("items"))
    wide = spark.createDataFrame([("S0", "C1", "A3")], "state string, city string, area string")
    known = spark.range(8).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("area"))
    return sites.assigned(rows, codes, people, regions, cities, fixes, listings, named, wide, known, digits=4)


@query(f"""with {_LADDER}, c as (select s.id, t.lat, t.lon from site s join (select state, city, min(lat) as lat, min(lon) as lon from places where city <> 'C5' group by 1, 2) t on t.state = s.state and t.city = s.city), a as (select area, avg(lat) as lat, avg(lon) as lon from codes group by 1),
w as (select y.*, s.code, z.state = s.state as ins from y join site s using (id) left join codes z on z.code = s.code where y.area is not null),
p as (select w.id, w.method, f.lat as flat, f.lon as flon, f.size as fsize, z.lat as zlat, z.lon as zlon, z.size as zsize, c.lat as clat, c.lon as clon, a.lat as alat, a.lon as alon,
{_MI.format(a='f', b='c')} as fc, {_MI.format(a='z', b='c')} as zc, {_MI.format(a='a', b='c')} as ac from w left join codes f on f.code = w.fix_code left join codes z on z.code = w.code and ins and w.fix_code is null left join c on c.id = w.id left join a on a.area = w.area),
q as (select *, coalesce(fsize > 100 and fc > 3 and fc <= greatest(2 * sqrt(fsize / pi()), 10), false) as ft, coalesce(zsize > 100 and zc > 3 and zc <= greatest(2 * sqrt(zsize / pi()), 10), false) as zt, coalesce(ac <= 40, false) as ok from p),
hows as (select *, case when flat is not null then method when zlat is not null and zt then 'city_in_large_code' when zlat is not null and method = 'zip_pop' and ok then 'city_of_code_in_two_areas' when zlat is not null then 'code' when ok then 'city' when clat is not null then 'unlocated' else 'area' end as how from q)
select id, how, round(case when flat is not null then case when ft then clat else flat end when how in ('city_in_large_code', 'city_of_code_in_two_areas', 'city') then clat when how = 'code' then zlat when how = 'area' then alat end, 6) as lat from hows""")
def g10_located(spark: SparkSession, d: str) -> DataFrame:
    """The point of each assigned site."""
    codes = _codes(spark)
    towns = _towns(spark).where("city <> 'C5'").groupBy("state", "city").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    rows = _site(spark, d)
    # areas before those outside are taken out: A8 counts as known here
    found = g14_all(spark, d).where("area is not null")
    inside = rows.join(codes.select("code", F.col("state").alias("zs")), "code", "left").select("id", "code", F.coalesce(F.col("zs") == F.col("state"), F.lit(False)).alias("code_in_state"))
    centres = codes.groupBy("area").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    cities = rows.join(towns, ["state", "city"]).select("id", "lat", "lon")
    return sites.located(found.join(inside, "id"), codes, cities, centres).select("id", "how", F.round("lat", 6).alias("lat"))


def g14_all(spark: SparkSession, d: str) -> DataFrame:
    """The ladder with all areas known."""
    codes, i = _codes(spark), F.col("id")
    last = F.right("code", F.lit(1)).cast("int")
    people = codes.where(last % 4 == 0).select("code", F.concat(F.lit("A"), ((last + 3) % 9).cast("string")).alias("area"))
    regions = codes.groupBy(F.left("code", F.lit(4)).alias("code3")).agg(F.min_by("area", "code").alias("area"), F.min_by("state", "code").alias("state"))
    towns = _towns(spark).where("city <> 'C5'").groupBy("state", "city").agg(F.min("area").alias("area"))
    rows = _site(spark, d).withColumn("virtual", i % 23 == 0)
    cities = rows.join(towns, ["state", "city"], "left").select("id", "area", (i % 10 == 1).alias("other_state_city"))
    fixes = rows.where(i % 13 == 0).select("id", (10000 + (i % 90) * 13).cast("string").alias("fix_code"))
    listings = rows.where(i % 5 == 0).select("id", (10000 + (i * 3 % 90) * 13).cast("string").alias("code"), (i % 2 == 0).alias("anchored"))
    named = rows.where("name is not null").groupBy("name", "code").agg(F.count_distinct("item").alias("items"))
    wide = spark.createDataFrame([("S0", "C1", "A3")], "state string, city string, area string")
    return sites.assigned(rows, codes, people, regions, cities, fixes, listings, named, wide, codes.select("area").distinct(), digits=4)


@query("""with i as (select o_orderkey as id, o_orderpriority as phase, o_orderstatus as grp, case when o_orderkey % 5 = 0 then ['multi'] when o_orderkey % 3 = 0 then ['lung', 'liver'] else ['lung'] end as labels, case when o_orderkey % 4 <> 0 then o_orderkey % 60 end as age from orders join customer on c_custkey = o_custkey where c_nationkey = 7),
h as (select * from i where list_contains(labels, 'lung') and (age is null or age <= 30))
select 'phase' as facet, p as value, count(id) as n from (select distinct o_orderpriority as p from orders) left join h on phase = p group by 2
union all select 'group', g, count(id) from (select distinct o_orderstatus as g from orders) left join h on grp = g group by 2
union all select 'label', l, count(*) from (select unnest(labels) as l from h) group by 2""")
def m5_item_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facets of the items with a site in a state that pass two filters."""
    o, i = _t(spark, d, "orders"), F.col("o_orderkey")
    labels = F.when(i % 5 == 0, F.array(F.lit("multi"))).when(i % 3 == 0, F.array(F.lit("lung"), F.lit("liver"))).otherwise(F.array(F.lit("lung")))
    frame = o.select(i.alias("id"), F.col("o_orderpriority").alias("phase"), F.col("o_orderstatus").alias("group"), labels.alias("labels"), F.get(labels, F.lit(0)).alias("primary"), F.when(i % 4 != 0, i % 60).alias("least_age"))
    where = o.join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(i.alias("id"), F.col("c_custkey").cast("string").alias("area"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("state"))
    hits = item_tool.passed(item_tool.in_scope(frame, where, where.select("area", "id"), {"state": "n7"}), {"label": "lung", "least_age_at_most": 30})
    domain = lambda c: sorted(r[0] for r in o.select(c).distinct().collect())  # noqa: E731  # a handful of codes
    return item_tool.facets(hits, domain("o_orderpriority"), domain("o_orderstatus"))


@query("""with n as (select 'town' as kind, s_suppkey as id, case when s_suppkey % 3 = 0 then 'Saint Ana' when s_suppkey % 3 = 1 then 'St. Ána' else 'Elk' end as name, s_nationkey as st, s_acctbal as score from supplier)
select id::varchar as id, name, round(score, 2) as score from n where name <> 'Elk' order by score desc, name, id limit 10""")
def m6_find_places(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest of the places that a misspelt name may mean."""
    s = F.col("s_suppkey")
    name = F.when(s % 3 == 0, "Saint Ana").when(s % 3 == 1, "St. Ána").otherwise("Elk")
    frame = _t(spark, d, "supplier").select(F.lit("town").alias("kind"), F.lit("towns").alias("table"), s.cast("string").alias("id"), name.alias("name"), F.lit("X").alias("state"), F.col("s_acctbal").alias("score"))
    found = places.find(places.index(frame), "saint anna", {})
    rows = [(m["id"], m["name"], round(m["score"], 2)) for m in found["matches"] + found.get("others", [])][:10]
    return spark.createDataFrame(rows, "id string, name string, score double")


_COUNTIES = Table("counties", tuple(Field(f, k) for f, k in (("id", "string"), ("name", "string"), ("pop55", "number"), ("pct_lt20_trials_within_60rdmi", "number"), ("people_lt20_trials_within_60rdmi", "number"))) + (Field("state", groupable=True, state=True),), base=("id", "name", "state"), weight="pop55", references=(("states", "state"), ("national", "")))


def _engine(spark, d) -> Engine:
    n = _nations(spark, d).select("id", "name", F.col("region").alias("state"), F.col("weight").alias("pop55"), F.col("pct_lt10").alias("pct_lt20_trials_within_60rdmi"), F.col("people_lt10").alias("people_lt20_trials_within_60rdmi"))
    engine = Engine({r.lower(): r for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")})
    engine.register(_COUNTIES, n)
    pct = (F.try_divide(100 * F.sum("people_lt20_trials_within_60rdmi"), F.sum("pop55"))).alias("pct_lt20_trials_within_60rdmi")
    above = Table("states", (Field("id"), Field("name"), Field("pct_lt20_trials_within_60rdmi", "number")))
    engine.register(above, n.groupBy(F.col("state").alias("id")).agg(F.min("state").alias("name"), pct))
    engine.register(Table("national", above.fields), n.agg(pct).select(F.lit("US").alias("id"), F.lit("all").alias("name"), "pct_lt20_trials_within_60rdmi"))
    return engine


@query(f"with {_NATIONS} select id, round(pct_lt10, 6) as pct from nations where region = 'EUROPE' order by pct_lt10 desc nulls last, weight desc, name limit 4")
def m8_ranking_method(spark: SparkSession, d: str) -> DataFrame:
    """M8: a method of the library: the worst four of a state."""
    got = _engine(spark, d).run("method", {"name": "counties_worst_access", "params": {"state": "europe", "n": 4}})
    rows = got["results"][0]["rows"]
    return spark.createDataFrame([(r["id"], round(r[library.MEASURES["short"][0]], 6)) for r in rows], "id string, pct double")


@query(f"""with {_NATIONS} select 'row' as part, id, round(pct_lt10, 6) as pct from nations where id in ('3', '8')
union all select 'states', region, round(100 * sum(people_lt10) / sum(weight), 6) from nations where region in (select region from nations where id in ('3', '8')) group by 2
union all select 'national', 'US', round(100 * sum(people_lt10) / sum(weight), 6) from nations""")
def m4_j18_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two rows beside those of their states and of all."""
    got = _engine(spark, d).run("compare", {"table": "counties", "ids": ["3", "8"], "columns": ["pct_lt20_trials_within_60rdmi"]})
    rows = [("row", r["id"], r["pct_lt20_trials_within_60rdmi"]) for r in got["rows"]] + [(r["table"], r["id"], r["pct_lt20_trials_within_60rdmi"]) for r in got["reference"]]
    return spark.createDataFrame([(a, b, round(c, 6)) for a, b, c in rows], "part string, id string, pct double")


_PARTS = Table("parts", (Field("id", "integer"), Field("name"), Field("brand", groupable=True), Field("size", "integer"), Field("price", "number"), Field("words", "array"), Field("code"), Field("large", "boolean")), base=("id",), default=())
_PREDICATES = {
    "f5": ({"field": "brand", "op": "is_null"}, "brand is null"), "f5b": ({"field": "brand", "op": "=", "value": None}, "brand is null"), "f5c": ({"field": "brand", "op": "not_null"}, "brand is not null"),
    "f6": ({"field": "name", "op": "contains", "value": "RED"}, "contains(lower(name), 'red')"), "f6b": ({"field": "words", "op": "contains", "value": "lat"}, "contains(lower(name), 'lat')"),
    "f7": ({"field": "words", "op": "includes", "value": "Red"}, "list_contains(string_split(lower(name), ' '), 'red')"), "f8": ({"field": "words", "op": "intersects", "value": ["Hot", "plate"]}, "list_has_any(string_split(lower(name), ' '), ['hot', 'plate'])"),
    "f1": ({"field": "size", "op": "=", "value": "7"}, "size = 7"), "f1b": ({"field": "large", "op": "=", "value": "TRUE"}, "large"), "f1c": ({"field": "words", "op": "=", "value": "x"}, "false"),
    "f2": ({"field": "brand", "op": "!=", "value": "brand#11"}, "lower(brand) <> 'brand#11'"), "f3": ({"field": "price", "op": ">=", "value": "1500"}, "price >= 1500"), "f3b": ({"field": "price", "op": ">", "value": "x"}, "false"),
    "f4": ({"field": "brand", "op": "not_in", "value": ["Brand#11", "Brand#22"]}, "brand not in ('Brand#11', 'Brand#22')"), "f9": ({"field": "size", "op": "between", "value": [10, 20]}, "size between 10 and 20"),
    "f10": ({"field": "price", "op": ">", "value": {"field": "size"}}, "price > size"), "f10b": ({"field": "size", "op": "<", "value": {"field": "code"}}, "size < try_cast(code as double)"), "f10c": ({"field": "large", "op": "=", "value": {"field": "name"}}, "false"),
    "f11": ({"any_of": [{"field": "size", "op": "=", "value": 1}, {"any_of": [{"field": "size", "op": "=", "value": 2}]}]}, "size in (1, 2)"),
}


@query("with p as (select p_partkey as id, p_name as name, case when p_size % 3 <> 0 then p_brand end as brand, p_size as size, p_retailprice as price, case when p_size % 2 = 0 then 'x' else (p_partkey % 60)::varchar end as code, p_size > 25 as large from part) " + " union all ".join(f"select '{n}' as op, count(*) filter (where {c}) as n from p" for n, (_, c) in _PREDICATES.items()))
def f_predicates(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each operator lets through."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = _t(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.when(size % 3 != 0, F.col("p_brand")).alias("brand"), size.alias("size"), F.col("p_retailprice").alias("price"), F.split("p_name", " ").alias("words"), F.when(size % 2 == 0, "x").otherwise((k % 60).cast("string")).alias("code"), (size > 25).alias("large"))
    out = None
    for name, (node, _) in _PREDICATES.items():
        one = query_frame(_PARTS, p, {"where": [node]})[1].select(F.lit(name).alias("op"), F.col("count").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_NATIONS}, q as (select region as \"group\", count(*) as n, floor(avg(pct_lt10) * 10 + 0.5) / 10 as mean_pct, median(items) as median_items from nations group by 1) select * from q")
def a3_told_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures as they are told, means to one decimal, medians as they are."""
    from .plans.engine import aggregate_frame

    out = aggregate_frame(NATIONS, _nations(spark, d), {"group_by": "region", "measures": [{"field": "pct_lt10", "stat": "mean"}, {"field": "items", "stat": "median"}]}, told=True)
    return out.select("group", "n", F.col("`pct_lt10:mean`").alias("mean_pct"), F.col("`items:median`").alias("median_items"))
