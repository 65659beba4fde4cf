"""Rows of sites placed by what they state: places by name, mistyped codes, conflicts of code and city, the ladder to an
area, and points (J13, J14, G10, G14 to G16).

Rows are (id, item, name, state, city, code); names are normalised and null where they are no name of a facility's own.
``codes`` are the known codes (code, state, area, lat, lon, radius), ``places`` the known places (state, city, area, lat, lon,
radius, size), of which several may have one name. All evidence is counted over different items other than the row's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digit_slips
from .geo import flat_miles
from .shared import Kept


def _miles(a: str, b: str) -> Column:
    return flat_miles(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"))


def place_join(rows: DataFrame, places: DataFrame, row_id: str = "id", near: float = 40.0) -> DataFrame:
    """(id, area, lat, lon, size, radius, miles) of the place that a row's city names.

    rows: (id, state, keys: spellings in order of preference, lat, lon: a hint, or null). The first spelling that is known
    counts. Of places of that name the largest within ``near`` miles of the hint is taken, else the nearest, and
    without a hint the largest; ties by area.
    """
    own = rows.select(row_id, "state", F.col("lat").alias("hlat"), F.col("lon").alias("hlon"), F.posexplode("keys").alias("rank", "city"))
    met = own.join(places, ["state", "city"]).withColumn("miles", _miles("h", ""))
    close = F.coalesce(F.col("miles") <= near, F.lit(False))
    hinted = F.col("miles").isNotNull()
    by_size, by_miles = F.when(close | ~hinted, -F.col("size")).otherwise(F.lit(0.0)), F.when(hinted & ~close, F.col("miles")).otherwise(F.lit(0.0))
    best = F.min(F.struct("rank", (~close).alias("far"), by_size.alias("s"), by_miles.alias("m"), "area", "lat", "lon", "size", "radius", "miles"))
    return met.groupBy(row_id).agg(best.alias("b")).select(row_id, "b.area", "b.lat", "b.lon", "b.size", "b.radius", "b.miles")


def compared(rows: DataFrame, codes: DataFrame, places: DataFrame) -> DataFrame:
    """Rows whose code is known in their state and whose city is a known place, with away (miles from the code to the nearest
    place of that name) and that place (nlat, nlon), the code's point (zlat, zlon) and radius (zradius)."""
    known = codes.select("code", "state", F.col("lat").alias("zlat"), F.col("lon").alias("zlon"), F.col("radius").alias("zradius"))
    met = rows.join(known, ["code", "state"]).join(places.select("state", "city", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), F.col("radius").alias("nradius")), ["state", "city"])
    best = met.groupBy("id").agg(F.min(F.struct(_miles("z", "n").alias("away"), "nlat", "nlon", "nradius")).alias("n"))
    return rows.join(known, ["code", "state"]).join(best, "id").select("*", "n.away", "n.nlat", "n.nlon", "n.nradius").drop("n")


def listings_near(asked: DataFrame, agreeing: DataFrame, within: float = 25.0) -> DataFrame:
    """(id, n, code): how many agreeing rows of a row's name lie near its city, and the code that most of them have.

    asked: (id, state, name, nlat, nlon); agreeing: (state, name, code, zlat, zlon). Agreeing rows are counted by code before
    they meet, so a hot name is as many rows as it has codes; ties to the smaller code.
    """
    counts = agreeing.groupBy("state", "name", "code").agg(F.count(F.lit(1)).alias("k"), F.first("zlat").alias("qlat"), F.first("zlon").alias("qlon"))
    met = asked.select("id", "state", "name", "nlat", "nlon").join(counts, ["state", "name"]).where(_miles("q", "n") <= within)
    return met.groupBy("id").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "code"))["code"].alias("code"))


def _campus(asked: DataFrame, agreeing: DataFrame, within: float) -> DataFrame:
    """(id): rows at whose code a name that holds theirs, or is held by it, is listed, two words or more in common."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    names = agreeing.select("state", F.col("name").alias("other"), "code", F.col("zlat").alias("qlat"), F.col("zlon").alias("qlon")).distinct()
    a = asked.select("id", "state", "name", "zlat", "zlon", F.explode(words(F.col("name"))).alias("word"))
    b = names.select("state", "other", "qlat", "qlon", F.explode(words(F.col("other"))).alias("word"))
    met = a.join(b, ["state", "word"]).where(_miles("q", "z") <= within)
    x, y = words(F.col("name")), words(F.col("other"))
    common = F.size(F.array_intersect(x, y))
    return met.where((common >= 2) & (common == F.least(F.size(x), F.size(y)))).select("id").distinct()


def mistyped_codes(rows: DataFrame, codes: DataFrame, places: DataFrame, loose: DataFrame, gap: float = 40.0, swap_gap: float = 25.0, near: float = 25.0, least: int = 2) -> DataFrame:
    """(id, rule, fix_code) of rows whose code is a typing error (G16). loose: (state, city) of cities that tell nothing.

    Two rules. ``listed``: the code lies over ``gap`` miles and twice its radius from every place of the city; the row has a
    name of two words or more, which the item doesn't list a second time in the city and no other item lists at the code; the name
    is listed ``least`` times near the city, and no longer or shorter form of it near the code. Then most of those
    listings' code is right. ``swapped``: the code lies over ``swap_gap`` miles off; exactly one swap of two neighbouring digits gives a
    code at the city; no other item lists the name at the code. Then it is that one, or that of the name's listings.
    """
    keep = Kept(rows.sparkSession, "typos")  # read several times below
    own = keep.table(compared(rows, codes, places), "compared")
    conflict = F.col("away") > F.greatest(F.lit(gap), 2 * F.col("zradius"))
    named = F.col("name").isNotNull()
    agreeing = own.where(~conflict & named)
    elsewhere = keep.table(own.where(named).groupBy("state", "name", "code").agg(F.count_distinct("item").alias("items")).where("items > 1").select("state", "name", "code"), "elsewhere")
    asked = own.where(named & (F.size(F.split("name", " ")) >= 2) & conflict).join(elsewhere, ["state", "name", "code"], "left_anti")
    asked = keep.table(asked.join(agreeing.select("item", "state", "name", "city").distinct(), ["item", "state", "name", "city"], "left_anti"), "asked")
    found = listings_near(asked, agreeing, near).where(F.col("n") >= least)
    found = keep.table(found.join(_campus(asked, agreeing, near), "id", "left_anti").select("id", F.lit("listed").alias("rule"), F.col("code").alias("fix_code")), "listed")
    rest = own.where(F.col("away") > F.greatest(F.lit(swap_gap), 2 * F.col("zradius"))).join(found, "id", "left_anti").join(loose, ["state", "city"], "left_anti")
    rest = keep.table(rest.join(elsewhere, ["state", "name", "code"], "left_anti"), "rest")
    swaps = rest.select("id", "state", "city", F.explode(digit_slips(F.col("code"), swaps_only=True)).alias("swap"))
    at = swaps.join(codes.select(F.col("code").alias("swap"), "state", F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), ["swap", "state"])
    at = at.join(places.select("state", "city", "lat", "lon", "radius"), ["state", "city"]).where(flat_miles(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")) <= F.greatest(F.lit(5.0), 1.5 * F.col("radius")))
    one = at.groupBy("id").agg(F.min("swap").alias("swap"), F.count_distinct("swap").alias("n")).where("n = 1").select("id", "swap")
    known = listings_near(rest.where(named), agreeing, near).where(F.col("n") >= least).select("id", "code")
    swapped = one.join(known, "id", "left").select("id", F.lit("swapped").alias("rule"), F.coalesce("code", "swap").alias("fix_code"))
    return found.unionByName(swapped)


def reviewed(rows: DataFrame, codes: DataFrame, places: DataFrame, loose: DataFrame, checked: DataFrame, skip: DataFrame, gap: float = 15.0, least: int = 2) -> DataFrame:
    """(id, verdict, rule, fix_code) of rows whose code and city disagree (G15); verdict is code, city or ambiguous.

    rows also have family (the institution that a name belongs to, or null), names_code and names_city (whether the name names
    a place at the code, or the city). A row disagrees if its code lies over ``gap`` miles and its radius beyond the edge of
    every place of the city. checked: (id, verdict) by a person. In order: checked; a city of ``loose`` tells nothing; named for the
    code's place and nobody lists it in the city; listed at the code and not in the city; named for the city and listed there,
    not at the code; listed in the city, or named for it, and not at the code; else ambiguous. A row that the item lists again in the city, or
    for which no code in the city is known, is ambiguous instead of city.
    """
    own = Kept(rows.sparkSession, "review").table(compared(rows, codes, places), "compared").withColumn("out", F.greatest(F.lit(0.0), F.col("away") - F.col("nradius")))
    disagrees = F.col("out") > F.greatest(F.lit(gap), F.col("zradius"))
    fine = own.where(~disagrees)
    asked = own.where(disagrees).join(skip.select("id"), "id", "left_anti")

    def others(by: list[str], alias: str) -> DataFrame:
        """(id, alias): different items other than a row's own among agreeing rows of the same ``by``."""
        pairs = fine.select(*by, "item").distinct()
        total = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("all"))
        mine = asked.select("id", *by, "item").join(total, by).join(pairs.withColumn("here", F.lit(1)), [*by, "item"], "left")
        return mine.select("id", (F.col("all") - F.coalesce("here", F.lit(0))).alias(alias))

    counts = [others(["state", k, p], f"{k}_{p}") for k in ("name", "family") for p in ("code", "city")]
    out = asked
    for c in counts:
        out = out.join(c, "id", "left")
    n = {f"{k}_{p}": F.coalesce(f"{k}_{p}", F.lit(0)) for k in ("name", "family") for p in ("code", "city")}
    at_code, in_city = F.greatest(n["name_code"], n["family_code"]), F.greatest(n["name_city"], n["family_city"])
    usual = lambda by: fine.groupBy("state", *by, "code").agg(F.count(F.lit(1)).alias("k")).groupBy("state", *by).agg(F.min(F.struct((-F.col("k")).alias("k"), "code"))["code"].alias("fix"))
    for i, by in enumerate((["name", "city"], ["family", "city"], ["city"])):
        out = out.join(usual(by).withColumnRenamed("fix", f"fix{i}"), ["state", *by], "left")
    again = fine.where("name is not null").select("item", "state", "name", "city").distinct().withColumn("again", F.lit(True))
    out = out.join(again, ["item", "state", "name", "city"], "left").join(loose.withColumn("loose", F.lit(True)), ["state", "city"], "left")
    out = out.join(checked.select("id", F.col("verdict").alias("person")), "id", "left").withColumn("fix", F.coalesce("fix0", "fix1", "fix2"))
    told = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"))
    code_named, city_named = F.col("names_code"), F.col("names_city") & ~F.col("names_code")
    v = (
        F.when(F.col("person").isNotNull(), F.struct(F.col("person").alias("verdict"), F.lit("checked").alias("rule")))
        .when(F.col("loose"), told("code", "city tells nothing"))
        .when(code_named & ~F.col("names_city") & (n["name_city"] == 0), told("code", "named for the code's place"))
        .when((in_city == 0) & (at_code >= least), told("code", "listed at the code"))
        .when((n["name_code"] == 0) & (n["name_city"] >= least) & city_named, told("city", "named for the city and listed there"))
        .when((at_code == 0) & ((n["name_city"] >= least) | city_named), told("city", "listed in the city"))
        .otherwise(told("ambiguous", ""))
    )
    out = out.withColumn("v", v)
    person = F.col("v.rule") == "checked"
    doubt = (F.col("v.verdict") == "city") & ((F.col("again") & ~person) | F.col("fix").isNull())
    doubt = F.coalesce(doubt, F.lit(False))
    verdict = F.when(doubt, "ambiguous").otherwise(F.col("v.verdict"))
    return out.select("id", verdict.alias("verdict"), F.when(doubt, "").otherwise(F.col("v.rule")).alias("rule"), F.when(verdict == "city", F.col("fix")).alias("fix_code"))


def assigned(rows: DataFrame, codes: DataFrame, people: DataFrame, regions: DataFrame, cities: DataFrame, fixes: DataFrame, listings: DataFrame, named_at: DataFrame, wide: DataFrame, known: DataFrame, digits: int = 3, least: int = 2) -> DataFrame:
    """(id, method, area, fix_code): the area of each row by the first rule of a ladder that holds.

    codes: (code, area, state) by land; people: (code, area) where most of its people live; regions: (code3, area, state) by the
    first digits; cities: (id, area) of the city that a row names in its state, other_state_city: whether it is a place of the code's
    own state at the code; fixes: (id, fix_code) of mistyped codes; listings: (id, code, anchored) where the registry lists the
    facility otherwise; named_at: (name, code, items); wide: (state, city, area) areas of a city of several; known: (area).
    rows also have virtual. Areas outside ``known`` are ``outside`` in the end.
    """
    land = codes.select("code", F.col("area").alias("land"), F.col("state").alias("land_state"))
    home = people.select("code", F.col("area").alias("home"))
    by = lambda d, code, p: d.join(land.withColumnsRenamed({"code": code, "land": f"{p}land", "land_state": f"{p}state"}), code, "left").join(home.withColumnsRenamed({"code": code, "home": f"{p}home"}), code, "left")
    d = by(rows, "code", "z_")
    d = by(d.join(fixes.select("id", "fix_code"), "id", "left"), "fix_code", "f_")
    d = by(d.join(listings.select("id", F.col("code").alias("l_code"), "anchored"), "id", "left"), "l_code", "l_")
    d = d.join(cities.select("id", F.col("area").alias("city_area"), "other_state_city"), "id", "left")
    d = d.withColumn("code3", F.left("code", F.lit(digits))).join(regions.select("code3", F.col("area").alias("r_area"), F.col("state").alias("r_state")), "code3", "left")
    d = d.join(wide.select("state", "city", F.col("area").alias("r_area"), F.lit(True).alias("wide")), ["state", "city", "r_area"], "left")
    d = d.join(named_at.select("name", "code", "items"), ["name", "code"], "left")
    home_of = lambda p: F.when(F.col(f"{p}home").isNotNull() & (F.col(f"{p}home") != F.col(f"{p}land")) & ~F.coalesce(F.col("city_area") == F.col(f"{p}land"), F.lit(False)), F.col(f"{p}home")).otherwise(F.col(f"{p}land"))
    told = lambda m, a, fix=None: F.struct((F.lit(m) if isinstance(m, str) else m).alias("method"), a.alias("area"), (fix if fix is not None else F.lit(None).cast("string")).alias("fix"))
    nothing = F.lit(None).cast(dict(codes.dtypes)["area"])
    in_state = lambda p: F.coalesce(F.col(f"{p}state") == F.col("state"), F.lit(False))
    z_home = home_of("z_")
    elsewhere = F.col("z_land").isNotNull() & ~in_state("z_") & (F.coalesce("other_state_city", F.lit(False)) | (F.coalesce("items", F.lit(0)) >= least))
    region = F.coalesce(F.col("r_state") == F.col("state"), F.lit(False))
    city_wins = F.col("city_area").isNotNull() & (F.col("city_area") != F.col("r_area")) & F.col("wide").isNull()
    early = (
        F.when(F.coalesce("virtual", F.lit(False)), told("virtual_site", nothing))
        .when(F.col("fix_code").isNotNull() & in_state("f_"), told("zip_typo_corrected", home_of("f_"), F.col("fix_code")))
        .when(in_state("z_"), told(F.when(z_home != F.col("z_land"), "zip_pop").otherwise("zip"), z_home))
        .when(elsewhere, told("zip_state_corrected", z_home))
    )
    late = (
        F.when(region & city_wins, told("city_over_zip3", F.col("city_area")))
        .when(region, told("zip3", F.col("r_area")))
        .when(F.col("city_area").isNotNull(), told("city_gazetteer", F.col("city_area")))
        .otherwise(told("unassigned", nothing))
    )
    listed = F.col("l_land").isNotNull() & (F.col("anchored") | (late["method"] == "unassigned")) & ~home_of("l_").eqNullSafe(late["area"])
    d = d.withColumn("a", F.coalesce(early, F.when(listed, told("facility_listing", home_of("l_"), F.col("l_code"))), late))
    d = d.select("id", "a.*").join(known.select("area", F.lit(True).alias("known")), "area", "left")
    out = F.col("area").isNotNull() & F.col("known").isNull()
    return d.select("id", F.when(out, "outside").otherwise(F.col("method")).alias("method"), F.when(~out, F.col("area")).alias("area"), F.when(~out, F.col("fix")).alias("fix_code"))


def located(rows: DataFrame, codes: DataFrame, cities: DataFrame, areas: DataFrame, large: float = 100.0, near: float = 3.0, far: float = 40.0) -> DataFrame:
    """(id, lat, lon, how): the point of each assigned row.

    rows: (id, area, method, fix_code, code, code_in_state); codes: (code, lat, lon, size in square miles); cities: (id, lat, lon) of the
    place that a row's city names; areas: (area, lat, lon). In order: the fixed code's point; the code's point, or the city's
    where the code is large and the city between ``near`` and twice the code's radius (10 at least) from it, or where people live in
    another area and the city is at most ``far`` miles from the area's centre; the city's so near; nowhere where it is farther; the area's.
    """
    spot = lambda p: codes.select(F.col("code").alias(f"{p}code"), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"), F.col("size").alias(f"{p}size"))
    d = rows.join(spot("f_"), rows["fix_code"] == F.col("f_code"), "left").join(spot("z_"), (rows["code"] == F.col("z_code")) & rows["code_in_state"] & rows["fix_code"].isNull(), "left")
    d = d.join(cities.select("id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")), "id", "left").join(areas.select("area", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), "area", "left")
    told = lambda p, how: F.struct(F.col(f"{p}lat").alias("lat"), F.col(f"{p}lon").alias("lon"), (F.lit(how) if isinstance(how, str) else how).alias("how"))
    miles = lambda a, b: flat_miles(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"))
    radius = lambda p: F.sqrt(F.col(f"{p}size") / F.pi())
    in_town = lambda p: F.coalesce((F.col(f"{p}size") > large) & (miles(p, "c_") > near) & (miles(p, "c_") <= F.greatest(2 * radius(p), F.lit(10.0))), F.lit(False))
    city_ok = F.coalesce(miles("a_", "c_") <= far, F.lit(False))
    nowhere = F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit("unlocated").alias("how"))
    at = (
        F.when(F.col("f_lat").isNotNull() & in_town("f_"), told("c_", F.col("method")))
        .when(F.col("f_lat").isNotNull(), told("f_", F.col("method")))
        .when(F.col("z_lat").isNotNull() & in_town("z_"), told("c_", "city_in_large_code"))
        .when(F.col("z_lat").isNotNull() & (F.col("method") == "zip_pop") & city_ok, told("c_", "city_of_code_in_two_areas"))
        .when(F.col("z_lat").isNotNull(), told("z_", "code"))
        .when(city_ok, told("c_", "city"))
        .when(F.col("c_lat").isNotNull(), nowhere)
        .otherwise(told("a_", "area"))
    )
    return d.select("id", at.alias("at")).select("id", "at.*")
