"""Queries of small fields and names. Functions of text run over hand-written cases, dealt to customers by key; their SQL holds
what each case must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fields as P
from .functions import names as N
from .registry import query
from .registry import table as _t


def _case_rows(spark: SparkSession, d: str, texts: list) -> DataFrame:
    """(c_custkey, text): the cases in turn."""
    cases = F.array(*(F.lit(t).cast("string") for t in texts))
    return _t(spark, d, "customer").select("c_custkey", F.get(cases, (F.col("c_custkey") % len(texts)).cast("int")).alias("text"))


def _sql(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def _wanted(outs: list, name: str = "out") -> str:
    return f"select c_custkey, ([{', '.join(map(_sql, outs))}])[(c_custkey % {len(outs)} + 1)::int] as {name} from customer"


_N = "(select c_custkey, c_acctbal, c_nationkey, c_mktsegment, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by all)"


def _with_orders(spark, d) -> DataFrame:
    n = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return _t(spark, d, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"select c_custkey, case when c_acctbal > 0 then floor(n * 100000 / c_acctbal * 10 + 0.5) / 10 end as rate from {_N}")
def p7_rate(spark: SparkSession, d: str) -> DataFrame:
    """Orders for 100,000 of balance, none where there is no balance."""
    return _with_orders(spark, d).select("c_custkey", P.rate(F.col("n"), F.col("c_acctbal")).alias("rate"))


@query("""select p_partkey, case when a and b then 1 when a then 2 when b then 3 else 4 end as class from part left join (select l_partkey, bool_or(l_quantity >= 50) as a, bool_or(l_discount >= 0.1) as b from lineitem group by 1) on l_partkey = p_partkey""")
def p8_presence(spark: SparkSession, d: str) -> DataFrame:
    """Parts with large lines, with the highest discount, with both or neither."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_quantity") >= 50).alias("a"), F.bool_or(F.col("l_discount") >= 0.1).alias("b"))
    return _t(spark, d, "part").select("p_partkey").join(li, "p_partkey", "left").select("p_partkey", P.presence(F.col("a"), F.col("b")).alias("class"))


@query("select o_orderkey, case when left(o_orderpriority, 1)::int <= 2 then o_totalprice end as value from orders")
def p9_gated(spark: SparkSession, d: str) -> DataFrame:
    """Prices of orders whose status allows to tell them."""
    return _t(spark, d, "orders").select("o_orderkey", P.gated(F.col("o_totalprice"), F.left("o_orderpriority", F.lit(1)).cast("int"), most=2).alias("value"))


@query("""with k as (select c_custkey, 'N' || c_nationkey as st, c_custkey % 124 as n from customer)
select c_custkey, st || '-' || case when n in (0, 98) then '00' when n < 10 then '0' || n else n::varchar end as id,
       st || ' ' || case when n in (0, 98) then 'at large' when n % 100 in (11, 12, 13) then n || 'th' when n % 10 = 1 then n || 'st' when n % 10 = 2 then n || 'nd' when n % 10 = 3 then n || 'rd' else n || 'th' end as name
from k where n < 100""")
def p10_district_ids(spark: SparkSession, d: str) -> DataFrame:
    """P10: ids and names of districts."""
    st, n = F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.col("c_custkey") % 124
    return _t(spark, d, "customer").where(n < 100).select("c_custkey", P.district_id(st, n).alias("id"), P.district_name(st, n).alias("name"))


@query("""select s_suppkey, (floor((30 + s_suppkey * 7919 % 1500 / 97.0) * 10000 + 0.5) / 10000)::varchar || ',' || (floor((-100 + s_suppkey * 104729 % 3000 / 97.0) * 10000 + 0.5) / 10000)::varchar as key from supplier""")
def p12_location_key(spark: SparkSession, d: str) -> DataFrame:
    """Places rounded to four decimals, as text."""
    k = F.col("s_suppkey")
    return _t(spark, d, "supplier").select("s_suppkey", P.location_key(30 + k * 7919 % 1500 / 97.0, -100 + k * 104729 % 3000 / 97.0).alias("key"))


@query(f"""with q as (select c_custkey, n, c_acctbal as w, floor(100.0 * (n + c_custkey % 3) / c_acctbal * 10 + 0.5) / 10 as share from {_N} where c_acctbal > 0)
select c_custkey, case when abs(100.0 * n / w - share) <= 0.06 then n::double else floor(w * share / 100 + 0.5) end as people from q""")
def p13_exact_or_share(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts where they agree with the share."""
    q = _with_orders(spark, d).where("c_acctbal > 0").withColumn("share", P.half_up(100.0 * (F.col("n") + F.col("c_custkey") % 3) / F.col("c_acctbal"), 1))
    return q.select("c_custkey", P.exact_or_share(F.col("n"), F.col("c_acctbal"), F.col("share")).alias("people"))


@query("select p_partkey, coalesce(case when p_size % 4 <> 0 then p_size * 2 end, 999) >= 55 as eligible, p_type like '%STEEL%' or p_type like '%ECONOMY%' as virtual from part")
def f15_f17_flags(spark: SparkSession, d: str) -> DataFrame:
    """upper limits that let people in, and rows told by a pattern."""
    limit = F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 2)
    return _t(spark, d, "part").select("p_partkey", P.eligible(limit).alias("eligible"), P.matches_pattern(F.col("p_type"), "STEEL|ECONOMY").alias("virtual"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, date_diff('day', o_orderdate::date, date '2001-08-31')::int as days, strftime(o_orderdate, '%Y') || ' Q' || quarter(o_orderdate) as quarter from orders""")
def x16_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of ISO times as text."""
    t = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return _t(spark, d, "orders").select("o_orderkey", P.day(t).alias("day"), P.days_since(t, F.lit("2001-08-31")).alias("days"), P.quarter_label(t).alias("quarter"))


@query("select c_custkey, floor((c_custkey - 500) / 2.0 + 0.5) as up, round_even((c_custkey - 500) / 2.0, 0) as even from customer")
def x21_roundings(spark: SparkSession, d: str) -> DataFrame:
    """Halves up, and to the even neighbour."""
    half = (F.col("c_custkey") - 500) / F.lit(2.0)
    return _t(spark, d, "customer").select("c_custkey", P.half_up(half).alias("up"), P.bankers(half).alias("even"))


@query("""with w as (select p_partkey, string_split(p_name, ' ') as words from part)
select p_partkey, array_to_string(list_sort(list_distinct(words)), ' ') as sorted, coalesce(list_position(words, 'plate'), 0) - 1 as at from w""")
def x22_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sorted different words, and the place of one."""
    w = F.split("p_name", " ")
    return _t(spark, d, "part").select("p_partkey", F.array_join(P.sorted_set(w), " ").alias("sorted"), P.index_of(w, "plate").cast("long").alias("at"))


@query("""with c as (select c_nationkey, c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by 1, 2),
keys as (select n_nationkey as c_nationkey, s as segment from nation, (select unnest(['AUTOMOBILE', 'BUILDING', 'NONE']) as s))
select c_nationkey, segment, coalesce(n, 0) as n from keys left join c using (c_nationkey) where false
union all select k.c_nationkey, k.segment, coalesce(c.n, 0) from keys k left join c on c.c_nationkey = k.c_nationkey and c.c_mktsegment = k.segment where k.c_nationkey in (select c_nationkey from c)""")
def x23_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """Maps of counts with all keys of a domain."""
    c = _t(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    maps = c.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    return maps.select("c_nationkey", F.explode(P.zero_filled(F.col("m"), ["AUTOMOBILE", "BUILDING", "NONE"])).alias("segment", "n"))


_JSON = '{"a": {"b.c": [{"k": "x", "v": 5}, {"k": "y", "v": [1, 2, 3]}]}, "name": "four"}'
_PATHS = [("a.`b.c`[0].v", "5"), ("a.`b.c`[k=y].v[1]", "2"), ("a.`b.c`[k=y].v.length", "3"), ("a.`b.c`.length", "2"), ("name.length", "4"), ("a.none.v", None), ("a.`b.c`[k=z].v", None)]


@query("select c_custkey, unnest([" + ", ".join(str(i) for i in range(len(_PATHS))) + "]) as path, unnest([" + ", ".join(_sql(w) for _, w in _PATHS) + "]) as out from customer")
def x24_json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Keys with dots, places, elements by a key's value, lengths."""
    doc = _t(spark, d, "customer").select("c_custkey", F.lit(_JSON).alias("doc"))
    outs = F.array(*(F.struct(F.lit(i).alias("path"), P.json_path(F.col("doc"), p).alias("out")) for i, (p, _) in enumerate(_PATHS)))
    return doc.select("c_custkey", F.explode(outs).alias("x")).select("c_custkey", "x.path", "x.out")


_PROSE = [("About 1,234 of twelve counties, 5.5 percent", "1234.0|12.0|5.5"), ("none here, phonetics", ""), ("seven, Eight and 09", "7.0|8.0|9.0"), (None, None)]


@query(_wanted([w for _, w in _PROSE]))
def x25_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of prose."""
    rows = _case_rows(spark, d, [t for t, _ in _PROSE])
    return rows.select("c_custkey", F.when(F.col("text").isNotNull(), F.array_join(F.transform(P.numbers_in(F.col("text")), lambda x: x.cast("string")), "|")).alias("out"))


_NAMES = [
    ("Mercy Hospital ( Site 0087)", "Mercy Hospital", "mercy hospital", False),
    ("Translation Research - US, Inc (TRIO-US", "Translation Research - US, Inc (TRIO-US)", "translation research us inc trio us", False),
    ("Oak) Clinic (", "Oak Clinic", "oak clinic", False),
    ("USA02-0", "USA02-0", "usa02 0", True),
    ("Site 12", "Site 12", "site 12", True),
    ("Lake () Center /ID# 12345,", "Lake  Center", "lake center", False),
    (None, None, None, False),
]


@query(f"select c_custkey, ([{', '.join(_sql(x[1]) for x in _NAMES)}])[(c_custkey % {len(_NAMES)} + 1)::int] as clean, ([{', '.join(_sql(x[2]) for x in _NAMES)}])[(c_custkey % {len(_NAMES)} + 1)::int] as key, ([{', '.join(_sql(x[3]) for x in _NAMES)}])[(c_custkey % {len(_NAMES)} + 1)::int] as code from customer")
def x2_clean_names(spark: SparkSession, d: str) -> DataFrame:
    """Names to show, keys without a sponsor's codes, and names that are codes only."""
    rows = _case_rows(spark, d, [x[0] for x in _NAMES])
    return rows.select("c_custkey", N.clean_name(F.col("text")).alias("clean"), N.without_codes(F.col("text")).alias("key"), N.code_like(F.col("text")).alias("code"))


_WORDS = [("The Univ. of Texas M. D. Anderson Ctr (MDACC)", "university texas md anderson center"), ("St. Luke's Hosp & Clinic", "st lukes hospital clinic"), ("A B C", "abc"), ("", ""), (None, None)]


@query(_wanted([w for _, w in _WORDS]))
def x3_name_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of names."""
    own = N.name_words(F.col("text"), {"univ": "university", "ctr": "center", "hosp": "hospital"}, ("the", "of", "and"))
    return _case_rows(spark, d, [t for t, _ in _WORDS]).select("c_custkey", F.array_join(own, " ").alias("out"))


@query("select doc_id, md5(lower(strip_accents(text))) as folded, length(text)::int as n from documents")
def x4_fold(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts without marks on letters."""
    return _t(spark, d, "documents").select("doc_id", F.md5(N.fold(F.col("text")).cast("binary")).alias("folded"), F.length("text").alias("n"))


_TOWNS = [("Saint Mary-of-the-Woods", "stmaryofthewoods"), ("Fort Doña Ana & Co.", "ftdonaanaandco"), ("Mount Ève", "mteve"), ("Sainte-Foy", "stefoy")]


@query(_wanted([w for _, w in _TOWNS]))
def x4_search_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a place search."""
    return _case_rows(spark, d, [t for t, _ in _TOWNS]).select("c_custkey", N.search_key(F.col("text")).alias("out"))


_LISTED = [("Agawam Town city|25", "agawam|agawam town"), ("Boston city|25", "boston"), ("Elk CDP|57", "elk"), ("Plain|99", "plain")]


@query(_wanted([w for _, w in _LISTED]))
def x10_place_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of listed places without their legal description, and an alias."""
    p = F.split("text", r"\|")
    keys = N.place_names(F.get(p, F.lit(0)), F.get(p, F.lit(1)), {"25": " city", "43": " town", "57": " cdp"}, twice=F.get(p, F.lit(1)) == "25")
    return _case_rows(spark, d, [t for t, _ in _LISTED]).select("c_custkey", F.array_join(keys, "|").alias("out"))


_KINDS = [("lung", r"(?i)\blung\b"), ("liver", r"(?i)\bliver\b"), ("blood", r"(?i)leukemia|lymphoma")]
_GENERIC = r"(?i)solid tumou?r|hematologic malignanc"
# texts of an item joined by ;, its title, and what it must be
_ITEMS = [
    ("Lung Cancer;Liver Cancer", "a trial", "multi", "texts"), ("Lung Cancer", "lung trial", "lung", "texts"), ("Lymphoma;Solid Tumor", "x", "multi", "texts"),
    ("Lung cancer;Advanced Solid Tumor", "Drug in solid tumors", "multi", "texts and title"), ("Lung cancer;Solid Tumor", "Lung and liver", "multi", "texts and title"),
    ("Solid tumor", "x", "multi", "texts"), ("Pain", "liver trial", "liver", "title"), ("Pain", "liver or lung", "multi", "title"), ("Pain", "solid tumors", "multi", "title"),
    ("Pain", "pain", "unclassified", "none"), ("Liver metastases of lung cancer", "x", "lung", "texts"),
]


@query(f"select c_custkey, ([{', '.join(_sql(x[2]) for x in _ITEMS)}])[(c_custkey % {len(_ITEMS)} + 1)::int] as category, ([{', '.join(_sql(x[3]) for x in _ITEMS)}])[(c_custkey % {len(_ITEMS)} + 1)::int] as source from customer")
def x12_combined(spark: SparkSession, d: str) -> DataFrame:
    """Categories of each text, with phrases of spread blanked, combined with those of the title."""
    rows = _case_rows(spark, d, [f"{a}|{b}" for a, b, *_ in _ITEMS])
    own, title = F.get(F.split("text", r"\|"), F.lit(0)), F.get(F.split("text", r"\|"), F.lit(1))
    blank = r"(?i)\b(?:liver|lung) metastas[ei]s\b"
    parts = F.array_distinct(F.flatten(F.transform(F.split(own, ";"), lambda t: N.categories(t, _KINDS, blank))))
    groups = F.filter(F.split(own, ";"), lambda t: t.rlike(_GENERIC))
    kind = F.when(F.exists(groups, lambda t: t.rlike("(?i)solid")), "solid").when(F.size(groups) > 0, "blood")
    out = N.combined_category(parts, F.size(groups) > 0, N.categories(title, _KINDS, blank), {"lung": "solid", "liver": "solid", "blood": "blood"}, title.rlike(_GENERIC), kind)
    return rows.select("c_custkey", out.alias("o")).select("c_custkey", "o.category", "o.source")


@query(_wanted(["blood|lung", "lung", "", "liver"]))
def x11_first_rules(spark: SparkSession, d: str) -> DataFrame:
    """X11: rules that keep only their own categories."""
    rows = _case_rows(spark, d, ["lung and lymphoma", "lung and lymphoma of the thorax", "nothing", "hepatic"])
    found = N.categories(F.col("text"), _KINDS, first=[("(?i)thorax", ["lung", "liver"]), ("(?i)hepatic", ["liver"])])
    return rows.select("c_custkey", F.array_join(F.array_sort(found), "|").alias("out"))


_ROUTES = [("Imatinib tablets|", "yes", "stem:imatinib"), ("Drug|given orally", "yes", "text"), ("Drug|oral cavity cancer", "unknown", "none"), ("Drug|intravenous", "no", "stated"), ("|", "unknown", "none")]


@query(f"select c_custkey, ([{', '.join(_sql(x[1]) for x in _ROUTES)}])[(c_custkey % {len(_ROUTES)} + 1)::int] as answer, ([{', '.join(_sql(x[2]) for x in _ROUTES)}])[(c_custkey % {len(_ROUTES)} + 1)::int] as evidence from customer")
def x14_evidence(spark: SparkSession, d: str) -> DataFrame:
    """An answer with its evidence, by stems, then by words."""
    p = F.split("text", r"\|")
    out = N.by_evidence([("text", F.get(p, F.lit(1)))], r"(?i)\borally?\b", r"(?i)intravenous", r"(?i)\boral (?:cavity|cancer)", stems=F.get(p, F.lit(0)), endings=("tinib",))
    return _case_rows(spark, d, [x[0] for x in _ROUTES]).select("c_custkey", out.alias("o")).select("c_custkey", "o.answer", "o.evidence")


_FACILITIES = [("Research Site", "placeholder"), ("Mayo Clinic Research Site", None), ("Corporate Office", "office"), ("Investigational Drug Service", "pharmacy"), ("Jane Q. Doe, MD", "person"), ("Mercy Hospital", None), ("0173", "placeholder"), (None, "placeholder")]


@query(_wanted([w for _, w in _FACILITIES]))
def x15_stands_for(spark: SparkSession, d: str) -> DataFrame:
    """Names that aren't an institution's."""
    rules = [("office", r"(?i)\b(?:corporate|central) office\b"), ("pharmacy", r"(?i)\binvestigational drug services?\b"), ("placeholder", r"(?i)\b(?:research|study) sites?\b")]
    return _case_rows(spark, d, [t for t, _ in _FACILITIES]).select("c_custkey", N.stands_for(F.col("text"), rules, r"(?i)clinic|hospital|universit").alias("out"))


@query(_wanted([True, False, False, True]))
def f16_screen(spark: SparkSession, d: str) -> DataFrame:
    """F16: words that count only outside of some contexts."""
    rows = _case_rows(spark, d, ["MDS in adults", "MECP2 and MDS", "cancer-free people", "ligament, MCL, tumor"])
    out = N.screened(F.col("text"), r"(?i)cancer-free", [(r"MECP2", r"\bMDS\b"), (r"(?i)ligament", r"\bMCL\b")], r"(?i)\b(?:mds|mcl|cancer|tumor)\b")
    return rows.select("c_custkey", out.alias("out"))
