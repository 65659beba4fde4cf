"""Spellings of one entity, told within blocks by shared keys instead of by pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import components

LEAST = 5  # letters of a word that may be misspelt


def _words(name, drop) -> F.Column:
    """Different words of a name in order, without those of ``drop``."""
    words = F.array_distinct(F.split(X.norm(F.coalesce(name, F.lit(""))), " "))
    return F.array_sort(F.array_remove(F.array_except(words, drop), ""))


def misspellings(wordings: DataFrame) -> DataFrame:
    """(u, v) of wordings (id, block, words) that differ in one word of 5 letters or more, by one edit.

    They meet by their other words and what a word is with a letter left out, so wordings under a key are
    within two edits of each other: as few as the alphabet allows, however many rows there are.
    """
    word = F.get("words", F.col("i"))
    keyed = wordings.where(F.size("words") > 0).select("id", "block", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i"))
    keyed = keyed.select("id", "block", word.alias("word"), F.filter("words", lambda x, k: k != F.col("i")).alias("rest")).where(F.length("word") >= LEAST - 1)
    shorter = F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.substring("word", F.lit(1), k - 1), F.substring("word", k + 1, F.length("word"))))
    keyed = keyed.select("id", "block", "word", "rest", F.explode(F.array_distinct(F.array_append(shorter, F.col("word")))).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    long = F.greatest(F.length("a.word"), F.length("b.word")) >= LEAST
    return met.where(long & X.one_edit(F.col("a.word"), F.col("b.word"))).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()


def resolve(spark: SparkSession, rows: DataFrame, row_id: str, block: list[str], name: str, family: str | None = None, place: str | None = None, generic: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, entity) of rows with a block and a name: entity is the smallest row_id (a long) of the entity.

    Within a block, rows are one entity that have the same words (words of ``place`` taken out), that have
    the same words but for ``generic`` ones, that are a misspelling of each other, or that have the same
    ``family``. A row without a family takes that which most rows of its words have, ties to the first in
    order; rows of different families are never one entity. Rows with a null block or without a word stay out.
    """
    drop = F.split(X.norm(F.coalesce(F.col(place), F.lit(""))), " ") if place else F.array().cast("array<string>")
    own = rows.select(F.col(row_id).cast("long").alias("id"), F.struct(*block).alias("block"), _words(F.col(name), drop).alias("words"), (F.col(family) if family else F.lit(None)).cast("string").alias("family"))
    for b in block:
        own = own.where(F.col(f"block.{b}").isNotNull())
    own = own.where("size(words) > 0")
    # a row a wording: all that follows is about wordings
    by = own.groupBy("block", "words", "family").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    told = by.where("family is not null").groupBy("block", "words").agg(F.min(F.struct((-F.col("n")).alias("n"), "family"))["family"].alias("told"))
    by = by.join(told, ["block", "words"], "left").withColumn("kin", F.coalesce("family", "told"))
    wordings = by.groupBy("block", "words", "kin").agg(F.min("first").alias("id"))
    less = F.array_except("words", F.array(*map(F.lit, generic)).cast("array<string>"))
    by_family = F.when(F.col("kin").isNotNull(), F.struct(F.lit(0).alias("rule"), F.array("kin").alias("key")))
    by_words = F.when(F.col("kin").isNull(), F.struct(F.lit(1).alias("rule"), F.when(F.size(less) > 0, less).otherwise(F.col("words")).alias("key")))
    keyed = wordings.select("id", "block", F.coalesce(by_family, by_words).alias("k"))
    stars = keyed.join(keyed.groupBy("block", "k").agg(F.min("id").alias("u")), ["block", "k"]).select("u", F.col("id").alias("v"))
    slips = misspellings(wordings.where("kin is null").select("id", "block", "words"))
    labels = components(spark, stars.unionByName(slips))
    nodes = wordings.select(F.col("id").alias("node"), F.col("block").alias("b"), F.col("words").alias("w"), F.col("kin").alias("k")).join(labels, "node")
    named = by.select("block", "words", "family", "kin").join(nodes, (F.col("block") == F.col("b")) & (F.col("words") == F.col("w")) & F.col("kin").eqNullSafe(F.col("k")))
    named = named.select("b", "w", F.col("family").alias("f"), "component")
    return own.join(named, (F.col("block") == F.col("b")) & (F.col("words") == F.col("w")) & F.col("family").eqNullSafe(F.col("f"))).select(F.col("id").alias(row_id), F.col("component").alias("entity"))
