"""Writers (K1 to K8)."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import Kept


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nulls as empty fields (K1)."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def keyed_json(df: DataFrame, path: str, level: str, key: str | None = None) -> None:
    """JSON lines in a folder for each level, the same rows in ``all``, and with a key an ``index`` of (level, key) (K2)."""
    df.write.mode("overwrite").partitionBy(level).json(f"{path}/by_level")
    df.write.mode("overwrite").json(f"{path}/all")
    if key:
        df.groupBy(level, key).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(f"{path}/index")


def compact_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, cols, row): each row as a JSON array in column order, values of their own types, and the columns' names (K3)."""
    cells = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), F.lit('{"v":null}')) for c in df.columns]
    inner = [F.substring(c, F.lit(6), F.length(c) - 6) for c in cells]
    return df.select(F.col(key).cast("string").alias("key"), F.array(*map(F.lit, df.columns)).alias("cols"), F.concat(F.lit("["), F.concat_ws(",", *inner), F.lit("]")).alias("row"))


def sparse_rows(df: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary (item, code), rows (key, at, n, codes)) of a many-to-many table (K4).

    Codes number the items in order, at is where a key's codes begin if all are laid one after another in order of keys.
    Both running counts go by ranges, so no window sees all rows. The tables lie in the shared folder until the driver ends.
    """
    keep = Kept(df.sparkSession, "sparse")
    known = df.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item)
    codes = _numbered(keep, known.select(item).distinct(), item, F.lit(1)).select(item, F.col("before").cast("int").alias("code"))
    rows = keep.table(known.distinct().join(codes, item).groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("codes")).withColumn("n", F.size("codes")), "rows")
    at = _numbered(keep, rows.select(key, "n"), key, F.col("n")).select(key, "before")
    return codes, rows.join(at, key).select(key, F.col("before").alias("at"), "n", "codes")


def _numbered(keep: Kept, df: DataFrame, key: str, weight: Column, spread: int = 32) -> DataFrame:
    """``df`` with before: the weight of all rows of smaller key, keys being different.

    Rows dealt out by ranges are written once and read for both sums: bounds of ranges come from a sample, which is another
    one each time that a large table is dealt out.
    """
    dealt = df.withColumn("__w", weight.cast("long")).repartitionByRange(spread, key).withColumn("__part", F.spark_partition_id())
    dealt = keep.table(dealt, f"dealt_{key}")
    up = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum("__w").over(up(Window.partitionBy("__part").orderBy(key))), F.lit(0)))
    sums = dealt.groupBy("__part").agg(F.sum("__w").alias("__all"))  # ``spread`` rows at most
    before = sums.select("__part", F.coalesce(F.sum("__all").over(up(Window.orderBy("__part"))), F.lit(0)).alias("__before"))
    return own.join(before, "__part").withColumn("before", F.col("__own") + F.col("__before")).drop("__part", "__w", "__own", "__before")


def packed(data: bytes, path: str) -> bool:
    """A gzip file whose bytes follow from the data alone; not written, and False, where it is there already (K5).

    For small files on the driver's side of a publication.
    """
    out = gzip.compress(data, mtime=0)
    try:
        with open(path, "rb") as f:
            if f.read() == out:
                return False
    except FileNotFoundError:
        pass
    with open(path, "wb") as f:
        f.write(out)
    return True


def archive(spark: SparkSession, df: DataFrame, path: str, date: str, pull: str | None = None, figures_of: str | None = None) -> str:
    """Append a snapshot under its date; a second one of a date gets a suffix (K6). Returns the name used.

    Where the figures tell the pull that they were made from, they must be those of this pull.
    """
    if pull is not None and figures_of is not None and pull != figures_of:
        raise ValueError(f"figures of pull {figures_of} can't be archived with pull {pull}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    name, n = date, 1
    while hadoop(f"{path}/snapshot_date={name}").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(f"{path}/snapshot_date={name}")):
        n += 1
        name = f"{date}-{n}"
    df.write.parquet(f"{path}/snapshot_date={name}")
    return name


def logged(df: DataFrame, rules: dict[str, Column], name: str = "log") -> tuple[DataFrame, Observation]:
    """``df`` whose write counts, on its way, the rows under each rule (K7); read them from the observation after the write."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items())), seen


def _signed_area(ring: Column) -> Column:
    """Twice the area of a ring of struct(x, y), positive where it runs against the clock."""
    n = F.size(ring)
    turns = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(turns, F.lit(0.0), lambda a, x: a + x)


def _thinned(ring: Column, close: float) -> Column:
    """Points that are ``close`` or more from the last one kept."""
    start = F.slice(ring, 1, 1)
    far = lambda a, p: F.hypot(p["x"] - F.element_at(a, -1)["x"], p["y"] - F.element_at(a, -1)["y"]) >= close
    return F.aggregate(F.slice(ring, 2, 1 << 30), start, lambda a, p: F.when(far(a, p), F.concat(a, F.array(p))).otherwise(a))


def geojson(polygons: DataFrame, id_: str, close: float, least: float, digits: int = 4) -> DataFrame:
    """(id, geometry): polygons as GeoJSON text (K8).

    rings: the border first, then holes. Points nearer than ``close`` to the last one kept go; rings of fewer than three
    points, or of an area under ``least``, go; borders run against the clock and holes with it, and each ring ends where it
    began. A polygon without a border left has null geometry.
    """
    point = lambda p: F.concat(F.lit("["), F.round(p["x"], digits).cast("string"), F.lit(","), F.round(p["y"], digits).cast("string"), F.lit("]"))
    thin = polygons.select(id_, F.transform("rings", lambda r, i: F.struct(i.alias("i"), _thinned(r, close).alias("r"))).alias("rings"))
    known = thin.select(id_, F.transform("rings", lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r"), _signed_area(x["r"]).alias("a"))).alias("rings"))
    kept = known.select(id_, F.filter("rings", lambda x: (F.size(x["r"]) >= 3) & (F.abs(x["a"]) / 2 >= least)).alias("rings"))

    def written(x):
        right = F.when((x["i"] == 0) == (x["a"] > 0), x["r"]).otherwise(F.reverse(x["r"]))
        return F.concat(F.lit("["), F.array_join(F.transform(F.concat(right, F.slice(right, 1, 1)), point), ","), F.lit("]"))

    body = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.array_join(F.transform("rings", written), ","), F.lit("]}"))
    return kept.select(id_, F.when(F.get("rings", F.lit(0))["i"] == 0, body).alias("geometry"))
