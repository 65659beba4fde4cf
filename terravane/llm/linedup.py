"""Repeated runs of lines, found with a suffix array over line ids and deleted but for the first copy.

Every non-blank line gets an id; lines that occur once end all repeats, so only runs of repeated lines
(*islands*) go on. Prefix doubling ranks the suffixes of islands by their first 1, 2, 4, ... lines: the rank
for 2n lines is the place of the pair (rank for n, rank for n of the suffix n lines on) among all pairs that
occur at least twice. Ranks come from a range-partitioned sort of the different pairs, so they are the order
of a suffix array, and suffixes of equal rank for n lines are an interval of it whose longest common prefix
is n lines or more.

A run is deleted if it has ``min_words`` words or more and an earlier copy. It is enough to test *tight* runs:
from their first to their last line they have ``min_words`` words, and would not without their first or
without their last line. A line lies in a run with an earlier copy exactly if it lies in a tight one with an
earlier copy: copies of a run have the same tight runs, and from any line of a long enough run a tight one
starts, or the tight one that ends the run covers the line. A tight run of l lines, 2^k <= l < 2^(k+1), is named
by its ranks for 2^k lines at its start and 2^k lines before its end. As lines have a word at least,
doubling ends after log2(min_words) rounds, whatever the corpus: all suffixes with the same l lines, an interval of the suffix
array with a longest common prefix of l or more, are the rows of one such name. Tight runs that follow each other at one
distance from their first copies make up the maximal repeated runs, which are what is deleted.

All of it is DataFrame operations on (document, line number, rank) rows; text is read once for line hashes
and once for the result. Groups of equal lines are counted before they are shuffled, and met in joins by a
side that is unique in the key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, compact

MIN_WORDS = 50
WORD = r"[^\s]+"
KEY = ("doc_id", "th")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, seq, at, h1, h2, nw) of non-blank lines: seq counts them from 0, at all lines; h1 and h2 are a 128-bit hash."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    lines = F.filter(lines, lambda x: x["line"].rlike(r"\S"))
    out = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(lines).alias("seq", "x")).select(*KEY, "seq", "x.at", "x.line")
    return out.select(*KEY, "seq", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("nw"))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Different pairs with their rank: ids that rise along a range-partitioned sort."""
    a, b = pairs.columns[:2]
    return pairs.orderBy(a, b).select(a, b, F.monotonically_increasing_id().alias("rank"))


def repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, work: Workspace | None = None) -> DataFrame:
    """(doc_id, th, gone): for each document with lines to delete, their numbers from 0.

    th is the text's xxhash64. Documents are ordered by (doc_id, th); rows equal in both are one document.
    """
    return repeated_runs(spark, docs, min_words, work).select(*KEY, F.explode("at").alias("line")).groupBy(*KEY).agg(F.collect_set("line").alias("gone"))


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, work: Workspace | None = None) -> DataFrame:
    """Maximal repeated runs: (doc_id, th, seq, lines, at, first), a row for each run of lines and its first copy.

    seq is the run's first line among the document's non-blank ones, lines their number, at their numbers among all
    lines, first the (doc_id, th, seq) of the copy before it. A run is maximal: it ends where the two differ, or where fewer
    than ``min_words`` words would be left.
    """
    work = work or Workspace(spark, "linedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    lines = work.table(_lines(docs), "lines")
    many = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    ranks = work.table(_ranked(many), "ranks0")
    by_doc, along = Window.partitionBy(*KEY).orderBy("seq"), Window.partitionBy(*KEY, "island").orderBy("seq")
    active = lines.join(ranks, ["h1", "h2"]).select(*KEY, "seq", "at", "nw", "rank").dropDuplicates([*KEY, "seq"])
    active = active.withColumn("island", F.col("seq") - F.row_number().over(by_doc))
    # sums of words up to each line, then of the lines that a tight run can reach
    active = active.withColumn("upto", F.sum("nw").over(along)).withColumn("ahead", F.collect_list("upto").over(along.rowsBetween(0, min_words)))
    base = F.col("upto") - F.col("nw")
    reach = lambda start: F.size(F.filter("ahead", lambda x: x - start < min_words))
    active = active.withColumn("least", reach(base) + 1)
    active = active.withColumn("least", F.when(F.col("least") <= F.size("ahead"), F.col("least"))).withColumn("most", F.greatest("least", reach(F.col("upto"))))
    active = active.withColumn("most", F.when(F.col("least").isNotNull(), F.col("most")))
    active = active.withColumn("longest", F.max("most").over(Window.partitionBy(*KEY, "island"))).where("longest is not null")
    at = F.slice(F.collect_list("at").over(along.rowsBetween(0, min_words)), F.lit(1), F.coalesce("most", F.lit(0)))
    active = work.table(active.select(*KEY, "island", "seq", at.alias("at"), "least", "most", "rank"), "active0")
    runs, span, turn = [], 1, 0
    while True:
        # tight runs of span to 2 span - 1 lines, by their two ranks
        ends = F.collect_list(F.struct("rank")).over(along.rowsBetween(0, span - 1)) if span > 1 else F.array(F.struct("rank"))
        fits = F.col("rank").isNotNull() & (F.col("least") < 2 * span) & (F.col("most") >= span)
        lengths = F.sequence(F.greatest("least", F.lit(span)), F.least("most", F.lit(2 * span - 1)))
        found = active.withColumn("ends", ends).where(fits).select(*KEY, "seq", "at", "rank", "ends", F.explode(lengths).alias("length"))
        found = found.select(*KEY, "seq", F.slice("at", F.lit(1), F.col("length")).alias("at"), "length", F.col("rank").alias("a"), F.get("ends", F.col("length") - span)["rank"].alias("b")).where("b is not null")
        runs.append(work.table(found, f"runs{turn}"))
        goes_on = F.when(F.col("rank").isNotNull() & (F.col("most") >= 2 * span), 1)
        active = active.withColumn("longest", F.max(goes_on).over(Window.partitionBy(*KEY, "island"))).where("longest is not null")
        if not active.head(1):
            break
        pairs = active.withColumn("next", F.lead("rank", span).over(along))
        again = pairs.where("rank is not null and next is not null").groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ranks = work.table(_ranked(again.select(F.col("rank").alias("r0"), F.col("next").alias("r1"))), f"ranks{turn + 1}")
        doubled = pairs.join(ranks.withColumnRenamed("rank", "doubled"), (F.col("rank") == F.col("r0")) & (F.col("next") == F.col("r1")), "left")
        active = work.table(doubled.select(*KEY, "island", "seq", "at", "least", "most", F.col("doubled").alias("rank")), f"active{turn + 1}")
        work.drop(f"active{turn}", f"ranks{turn}") if turn else None
        span, turn = 2 * span, turn + 1
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    place = F.struct(*KEY, "seq")
    first = every.groupBy("length", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("length", "a", "b", "first")
    later = every.join(first, ["length", "a", "b"]).where(~place.eqNullSafe(F.col("first")))
    # tight runs that follow each other at one distance from their first copies are parts of one maximal run
    pair = [*KEY, "first.doc_id", "first.th", F.col("seq") - F.col("first.seq")]
    up = Window.partitionBy(*pair).orderBy("seq", "length")
    before = F.max(F.col("seq") + F.col("length")).over(up.rowsBetween(Window.unboundedPreceding, -1))
    parts = later.withColumn("apart", F.coalesce((F.col("seq") > before).cast("int"), F.lit(1))).withColumn("run", F.sum("apart").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = parts.select(*KEY, "seq", "length", "at", "run", F.col("first.doc_id").alias("f_id"), F.col("first.th").alias("f_th"), F.col("first.seq").alias("f_seq"), (F.col("seq") - F.col("first.seq")).alias("apart"))
    runs = pairs.groupBy(*KEY, "f_id", "f_th", "apart", "run").agg(F.min("seq").alias("seq"), F.max(F.col("seq") + F.col("length")).alias("stop"), F.min("f_seq").alias("f_seq"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    return runs.select(*KEY, "seq", (F.col("stop") - F.col("seq")).alias("lines"), "at", F.struct(F.col("f_id").alias("doc_id"), F.col("f_th").alias("th"), F.col("f_seq").alias("seq")).alias("first"))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` after it as it takes to clash with no column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_lines, n_deleted (non-blank lines of the input) and the text without later copies.

    Copies of a run of whole lines, of ``min_words`` words or more, go everywhere but at their first place
    in (doc_id, text hash, line) order, within a document too. Blank lines stay, and so do shorter runs. A
    null text stays null with 0 lines; an empty text has none. Rows equal in doc_id and text are one
    document: all keep the same lines. A null doc_id sorts first. Other columns are carried along; where ``docs`` has
    columns n_lines or n_deleted, the new ones are named as ``free_name`` tells. An empty table gives an empty result.
    """
    gone = repeated_lines(spark, docs, min_words)
    own = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_h"), F.sort_array("gone").alias("gone"))
    # a row a document at most, far smaller than the texts beside it: hashed, so that texts aren't sorted
    joined = own.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left")
    lines = joined.select("own", F.col("own.text").alias("text"), "gone", F.split("own.text", "\n").alias("lines"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("lines", lambda x: x.rlike(r"\S"))))

    def between(k):  # the lines between two that go
        first = F.coalesce(F.get("gone", k - 1) + 2, F.lit(1))
        return F.slice("lines", first, F.coalesce(F.get("gone", k), F.size("lines")) - first + 1)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), between)), "\n")
    n_deleted = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    return lines.select(*(text.alias(c) if c == "text" else F.col("own")[c].alias(c) for c in docs.columns), n_lines.alias(free_name(docs, "n_lines")), n_deleted.alias(free_name(docs, "n_deleted")))


def op9_line_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many were deleted, and the SHA-256 of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = delete_repeats(spark, docs)
    out = out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.sha2("text", 256).alias("kept_sha256"))
    return compact(out)


#: The same in SQL, by brute force: all tight runs as text, grouped.
OP9_SQL = r"""
with lines as (
  select doc_id, text, i, line, row_number() over (partition by doc_id order by i) - 1 as seq
  from (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null)
  where regexp_matches(line, '\S')
), counted as (
  select *, len(regexp_extract_all(line, '[^\s]+')) as nw, sum(len(regexp_extract_all(line, '[^\s]+'))) over (partition by doc_id order by seq) as upto from lines
), reach as (
  select a.doc_id, a.seq, min(b.seq) as last
  from counted a join counted b on a.doc_id = b.doc_id and b.seq between a.seq and a.seq + 50 and b.upto - a.upto + a.nw >= 50 group by 1, 2
), tight as (
  select doc_id, seq as s, last as e from reach
  union
  select b.doc_id, max(a.seq) as s, b.seq as e from counted a join counted b on a.doc_id = b.doc_id and b.seq between a.seq and a.seq + 50 and b.upto - a.upto + a.nw >= 50 group by b.doc_id, b.seq
), named as (
  select t.doc_id, t.s, t.e, string_agg(l.line, chr(10) order by l.seq) as body
  from tight t join lines l on l.doc_id = t.doc_id and l.seq between t.s and t.e group by 1, 2, 3
), later as (
  select * from (select doc_id, s, e, row_number() over (partition by body order by doc_id, s) as k from named) where k > 1
), gone as (
  select distinct l.doc_id, l.i from later t join lines l on l.doc_id = t.doc_id and l.seq between t.s and t.e
), pieces as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null
), kept as (
  select p.doc_id, coalesce(string_agg(p.line, chr(10) order by p.i) filter (where g.i is null), '') as body,
         count(*) filter (where regexp_matches(p.line, '\S')) as n_lines, count(g.i) as n_deleted
  from pieces p left join gone g on g.doc_id = p.doc_id and g.i = p.i group by 1
)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_deleted, 0)::bigint as n_deleted, sha256(k.body) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
"""
