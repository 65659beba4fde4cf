"""Document fingerprints by SimHash and permuted block tables, in DataFrame operations only.

Terms are the five-word shingles of the lower-cased text (all its words where there are fewer), weighted by
their number. Each term's 64-bit hash votes with its weight, for a bit that is set and against one that
isn't; bits with more votes for than against are 1. Votes of three bits share a long (22 bits apart), so a
term costs 22 sums; a text is counted in blocks of 2^19 terms, which none of the sums can overflow.

Search: fingerprints are cut into 6 blocks. Two that differ in at most 3 bits agree in 3 blocks, so 20
tables, one for each choice of 3 blocks, keyed by these (31 to 33 bits), hold each such pair; a pair is
taken from the first table that has it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, compact

WIDTH = 5
RADIUS = 3
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
SPACE = " \t\n\x0b\f\r"
LANES, LANE_BITS, COUNTED = 22, 22, 1 << 19


def fingerprint_rows(rows: DataFrame, keys: list[str], text: str = "text", width: int = WIDTH) -> DataFrame:
    """(keys, fp): the fingerprint (long) of each row's text; keys tell rows apart and should be numbers.

    Null texts and texts without a word have fingerprint 0. If rows are partitioned by some of the keys,
    nothing is shuffled.
    """
    words = F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    terms = rows.select(*keys, words.alias("w"))
    terms = terms.select(*keys, "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("i"))
    h = F.when((F.col("i") > 0) | (F.get("w", F.lit(0)) != ""), F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(width))))
    terms = terms.select(*keys, (F.col("i") / COUNTED).cast("int").alias("part"), h.alias("h"))
    lane = sum(1 << (LANE_BITS * k) for k in range(3))
    votes = terms.groupBy(*keys, "part").agg(F.count("h").alias("n"), *(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(lane))).alias(f"s{j}") for j in range(LANES)))
    one = lambda b: F.shiftrightunsigned(f"s{b % LANES}", LANE_BITS * (b // LANES)).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
    votes = votes.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(one(b)).alias(f"b{b}") for b in range(64)))
    fp = F.lit(0).cast("long")
    for b in range(64):
        bit = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), bit).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, fp.alias("fp"))


def _bucket(column, bounds: list[int]):
    """How many of the sorted bounds are below a value: a look at every so-manieth, then within them."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lit = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    coarse = F.size(F.filter(lit([p[-1] for p in parts]), lambda x: x < column))
    fine = F.size(F.filter(F.coalesce(F.get(F.array(*map(lit, parts)), coarse), lit([]).cast("array<long>")), lambda x: x < column))
    return F.when(column.isNull(), 0).otherwise(coarse * step + fine)


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a, b):
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - hamming(a, b) / F.lit(64.0)


def near_fingerprints(queries: DataFrame, every: DataFrame) -> DataFrame:
    """(q, fp): all pairs of a query fingerprint and another that differ in 1 to ``RADIUS`` bits.

    Both are tables of different longs, columns q and fp.
    """

    def tables(name):
        kept = []
        for k, choice in enumerate(itertools.combinations(range(len(BLOCKS)), 3)):
            key = F.lit(0).cast("long")
            for b in choice:
                low, bits = BLOCKS[b]
                key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(name, low).bitwiseAND(F.lit((1 << bits) - 1)))
            kept.append(key.bitwiseOR(F.lit(k << 34)))
        return F.explode(F.array(*kept))

    a = queries.select("q", tables("q").alias("key"))
    b = every.select("fp", tables("fp").alias("key"))
    found = a.join(b, (a.key == b.key) & (hamming(F.col("q"), F.col("fp")) <= RADIUS) & (F.col("q") != F.col("fp")))
    agree = [hamming(F.shiftrightunsigned("q", low).bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))) == 0 for low, bits in BLOCKS]
    first = F.coalesce(*(F.when(agree[x] & agree[y] & agree[z], F.lit(k)) for k, (x, y, z) in enumerate(itertools.combinations(range(len(BLOCKS)), 3))))
    return found.where(F.shiftrightunsigned(a.key, 34) == first).select("q", "fp")


def edited_fingerprints(spark: SparkSession, docs: DataFrame, docs_a_bucket: int = 2000) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next. The next document is that
    of the next smaller doc_id, after the last the first. Null text is empty, null doc_ids count as the
    smallest; rows of equal doc_id follow each other by their text's hash and text. A single row is its
    own next. Rows are dealt out by ranges of doc_id, so each text is shuffled once; a copy of a range's
    first row goes to the range before it.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("id")
    n = min(max(1, -(-ids.count() // docs_a_bucket)), 20_000)
    bounds = sorted(set(ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], max(10_000, 20 * n))).head()[0] or [])) if n > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("id"), bounds))
    heads = sorted(map(tuple, rows.groupBy("bucket").agg(F.max("id")).collect()))  # a row a bucket, 20,000 at most
    above: dict[int, int] = {}  # by bucket: where a copy of its first row goes
    for k, (bucket, _) in enumerate(heads):
        above[bucket] = heads[(k + 1) % len(heads)][0]
    size = len(bounds) + 1
    known = dict(heads)
    top = F.get(F.array(*(F.lit(known.get(b)).cast("long") for b in range(size))), F.col("bucket"))
    to = F.get(F.array(*(F.lit(above.get(b)).cast("int") for b in range(size))), F.col("bucket"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))
    places = F.when(F.col("id") == top, F.array(own, F.struct(to.alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    rows = rows.select("id", "doc_id", "text", F.explode(places).alias("at")).select("id", "doc_id", "text", "at.bucket", "at.extra")
    order = Window.partitionBy("bucket").orderBy("extra", F.desc("id"), F.xxhash64("text"), "text")
    n_chars = F.char_length("text")
    third = F.floor(n_chars / 3).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("rn", F.row_number().over(order))
    edited = F.concat(F.substring("text", F.lit(1), n_chars - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    rows = rows.select("bucket", "rn", "extra", "id", F.col("doc_id").isNull().cast("int").alias("none"), n_chars.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # the digest as four longs: hash aggregation keeps numbers only
    digest = F.sha2("edited", 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"d{k}") for k in range(8)]
    both = rows.select("bucket", "rn", "extra", "id", "none", "n_chars", *parts, F.explode(F.when(F.col("extra") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"))))).alias("x"))
    keys = ["bucket", "rn", "extra", "id", "none", "n_chars", *(f"d{k}" for k in range(8))]
    marked = fingerprint_rows(both.select(*keys, "x.kind", "x.text"), [*keys, "kind"])
    marked = marked.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    marked = marked.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn"))).where("extra = 0")
    sha = F.lower(F.concat(*(F.lpad(F.hex(f"d{k}"), 8, "0") for k in range(8))))
    return marked.select(F.when(F.col("none") == 0, F.col("id")).alias("doc_id"), "n_chars", sha.alias("edited_sha256"), "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def as_hex(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op2_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query; for documents whose id is divisible by 20 also, from the block tables (others: null):
    near_count, how many other rows are within 3 bits, those of the same fingerprint among them, and
    near_fingerprints, the other fingerprints within 3 bits in order (rows of each have it in ``fingerprint``)."""
    work = Workspace(spark, "fingerprints")
    marked = work.table(compact(edited_fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))), "marked")
    every = work.table(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "different")
    queries = marked.where(F.col("doc_id") % 20 == 0).select(F.col("fp").alias("q")).distinct()
    pairs = near_fingerprints(queries, every.select("fp"))
    # different fingerprints within 3 bits of one: 43,744 at most
    near = pairs.join(every, "fp").groupBy("q").agg(F.sum("n").alias("near"), F.sort_array(F.collect_list(as_hex("fp"))).alias("partners"))
    same = every.join(queries.withColumnRenamed("q", "fp"), "fp").select("fp", "n")
    near = work.table(same.join(near.withColumnRenamed("q", "fp"), "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("near"), F.coalesce("partners", F.array().cast("array<string>")).alias("partners")), "near")
    asked = F.col("doc_id") % 20 == 0
    count = F.when(asked, F.col("near"))
    return marked.join(near, "fp", "left").select("doc_id", "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", count.cast("long").alias("near_count"), F.when(asked, F.array_join("partners", ",")).alias("near_fingerprints"))
