"""Readers with stated schemas (S1 to S16); keys are text and ``NA`` is data."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pull_pages(fetch: Callable[[str | None], tuple[list[dict], str | None, int | None]]) -> Iterator[str]:
    """JSON lines of a paged source (S1). fetch takes a page's token (None at first) and gives (items, next token, total).

    Raises where fewer items come than the source says that there are, so a broken pull is never taken for a whole one.
    """
    token, n, total = None, 0, None
    while True:
        items, token, told = fetch(token)
        total = told if total is None else total
        n += len(items)
        yield from (json.dumps(x) for x in items)
        if not token:
            break
    if total is not None and n < total:
        raise ValueError(f"{n} of {total} items came")


def keyed_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV of a stated schema; only the empty field is null."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", "").option("emptyValue", "").option("mode", "PERMISSIVE").csv(path)


def delimited_in_zip(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(file, row map<string, string>) of delimited files inside zip archives.

    A byte order mark and blanks around headers and values are taken off; empty values are null.
    """

    def work(batches):
        for b in batches:
            for data in b.column(0):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            lines = io.TextIOWrapper(f, encoding="utf-8-sig")
                            header = [h.strip() for h in next(lines, "").rstrip("\r\n").split(sep)]
                            held: list = []
                            for line in lines:
                                if line.strip():
                                    held.append([(h, v.strip() or None) for h, v in zip(header, line.rstrip("\r\n").split(sep))])
                                if len(held) == 5_000:
                                    yield _rows(name, held)
                                    held = []
                            if held:
                                yield _rows(name, held)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, "file string, row map<string, string>")


def _rows(name: str, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(rows, pa.map_(pa.string(), pa.string()))], ["file", "row"])


def prefixed(spark: SparkSession, path: str, schema: str, key: str, prefix: str, cells: list[str], sentinels: tuple[float, ...] = (), strict: bool = True) -> DataFrame:
    """Pipe-delimited rows of a key prefix and the sum of cells (S5). Sentinels make the sum null, or are skipped."""
    rows = spark.read.schema(schema).option("header", True).option("sep", "|").csv(path).where(F.col(key).startswith(prefix))
    values = [F.when(F.col(c).isin(*sentinels), None).otherwise(F.col(c)) if sentinels else F.col(c) for c in cells]
    total = values[0]
    for v in values[1:]:
        total = total + v
    if not strict:
        total = sum((F.coalesce(v, F.lit(0)) for v in values[1:]), F.coalesce(values[0], F.lit(0)))
    return rows.select(F.substring(key, len(prefix) + 1, 64).alias("key"), total.alias("total"))


def report(spark: SparkSession, path: str, body: str, columns: str) -> DataFrame:
    """Rows of a report with preamble and footer: lines that match ``body``, as CSV of the stated columns."""
    lines = spark.read.text(path).where(F.col("value").rlike(body))
    return lines.select(F.from_csv("value", columns).alias("x")).select("x.*")


def matching(rows: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """Rows of which one of the columns matches, whatever the case (S8): a filter of the scan, nothing is read in chunks."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False))
    return rows.where(hit)


def long_attributes(df: DataFrame, key: str, attribute: str, value: str, wanted: str, older: DataFrame | None = None) -> DataFrame:
    """One attribute of a long file, by key, else that of an older vintage (S12): (key, value, source)."""
    now = df.where(F.col(attribute) == wanted).select(F.col(key).alias("key"), F.col(value).alias("a"))
    if older is None:
        return now.select("key", F.col("a").alias("value"), F.lit("current").alias("source"))
    both = now.join(older.select(F.col(key).alias("key"), F.col(value).alias("b")), "key", "full_outer")
    return both.select("key", F.coalesce("a", "b").alias("value"), F.when(F.col("a").isNotNull(), "current").otherwise("older").alias("source"))


def assignment_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file ``window.X={...};`` as a row of a stated schema."""
    text = spark.read.option("wholetext", True).text(path)
    body = F.regexp_replace(F.regexp_replace("value", r"^\s*[\w.]+\s*=\s*", ""), r";\s*$", "")
    return text.select(F.from_json(body, schema).alias("x")).select("x.*")


def flatten_studies(studies: DataFrame, items: str, keep: list[str], site_fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row a study, one row a site) of nested documents (S2); lists are joined by ``;`` beside the array."""
    kinds = dict(studies.select(*keep).dtypes)
    facts = studies.select(*(F.concat_ws(";", c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in keep))
    sites = studies.select(keep[0], F.posexplode_outer(items).alias("ordinal", "site")).where("site is not null").select(keep[0], "ordinal", *(F.col(f"site.{f}").alias(f) for f in site_fields))
    return facts, sites


def any_of_wide(df: DataFrame, pattern: str, codes: list[str]) -> DataFrame:
    """Rows of which any column of a family holds a code."""
    family = [c for c in df.columns if re.fullmatch(pattern, c)]
    return df.where(F.exists(F.array(*family), lambda x: x.isin(*codes)))


def primary_first(codes: list[str], switches: list[str], wanted: list[str]) -> Column:
    """Different wanted codes of a family of columns, those whose switch is Y first, each part in order."""
    pairs = F.array(*(F.struct(F.when(F.col(s) == "Y", 0).otherwise(1).alias("rank"), F.col(c).alias("code")) for c, s in zip(codes, switches)))
    known = F.filter(pairs, lambda x: x["code"].isin(*wanted))
    return F.array_distinct(F.transform(F.array_sort(known), lambda x: x["code"]))


def signed_on(spark: SparkSession, path: str, row_tag: str, schema: str, members: str, withdrawn: str) -> DataFrame:
    """Rows of XML files with one row for each member of a list that hasn't withdrawn."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.withColumn("member", F.explode(members)).where(F.coalesce(F.col(f"member.{withdrawn}"), F.lit("")) == "").drop(members)


def first_that_works(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first of several sources that can be read and isn't empty (S10); the last one's error is raised if none can."""
    last: Exception | None = None
    for source in sources:
        try:
            df = source()
            if df.head(1):
                return df
        except Exception as e:  # a source that is away is what the next one is for
            last = e
    raise last or ValueError("every source is empty")


def aliases(headers: list[str], wanted: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    """For each wanted column the header that stands for it, by the first of its names that occurs (S11); null if none does.

    Names are compared by their letters and digits, whatever the case.
    """
    plain = lambda s: "".join(filter(str.isalnum, s.lower()))
    known: dict[str, str] = {}
    for h in headers:
        known.setdefault(plain(h), h)
    return {k: next((known[plain(n)] for n in names if plain(n) in known), None) for k, names in wanted.items()}


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, attributes map, kind, rings array of arrays of struct(x, y)) of zipped shapefiles.

    Points, lines and polygons; empty shapes have no ring. A zip is read by one task, record by record.
    """
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def work(batches):
        for b in batches:
            for data in b.column(0):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for name in z.namelist():
                        if name.lower().endswith(".shp"):
                            table = next((n for n in z.namelist() if n.lower() == name[:-4].lower() + ".dbf"), None)
                            rows = list(_dbf(z.read(table))) if table else []
                            for i, (kind, rings) in enumerate(_shp(z.read(name))):
                                own = [[{"x": x, "y": y} for x, y in r] for r in rings]
                                facts = list((rows[i] if i < len(rows) else {}).items())
                                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([facts], pa.map_(pa.string(), pa.string())), pa.array([kind], pa.int32()), pa.array([own], pa.list_(pa.list_(point)))], ["file", "attributes", "kind", "rings"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, "file string, attributes map<string, string>, kind int, rings array<array<struct<x: double, y: double>>>")


def _shp(data: bytes):
    """(kind, rings) of a main file's records."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        body = at + 12
        if kind in (1, 11, 21):
            yield kind, [[struct.unpack_from("<2d", data, body)]]
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack_from("<2i", data, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 40), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, body + 40 + 4 * parts)
            pairs = list(zip(flat[::2], flat[1::2]))
            yield kind, [pairs[a:b] for a, b in zip(starts, starts[1:])]
        else:
            yield kind, []
        at += 8 + size


def _dbf(data: bytes):
    """Rows of an attribute table as text; deleted rows keep their place."""
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for i in range(n):
        at, row = head + i * width + 1, {}
        for name, size in fields:
            row[name] = data[at : at + size].decode("utf-8", "replace").strip() or None
            at += size
        yield row


def of_release(spark: SparkSession, path: str, release: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept for one release of its source (S15): read where it was written for that, else made and written anew.

    The release is a column of partitions beside the data, so both are committed together.
    """
    try:
        kept = spark.read.parquet(path)
        if "release" in kept.columns and kept.where(F.col("release") == release).head(1):
            return kept.where(F.col("release") == release).drop("release")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().withColumn("release", F.lit(release)).write.mode("append").partitionBy("release").parquet(path)
    return spark.read.parquet(path).where(F.col("release") == release).drop("release")


def whole_or_kept(new: DataFrame, kept: DataFrame, key: str, least: float = 0.9) -> tuple[DataFrame, bool]:
    """(the new table if it looks whole, else the one kept before; whether it is the new one).

    It is whole if it has at least that share of the different keys kept before.
    """
    before = kept.select(key).distinct()
    n = before.count()
    same = before.join(new.select(key).distinct(), key, "left_semi").count()
    return (new, True) if n == 0 or same >= least * n else (kept, False)
