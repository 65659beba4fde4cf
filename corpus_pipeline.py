"""From documents to token ids: language ID, line dedup, near-duplicate removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir) with the columns of documents and returns what it keeps, the last one
its digests of token ids. A stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import anchors, bpe, crf, linedup, mixing
from terravane.llm.common import Workspace, table

#: Toxic documents are to have next to no tokens, so their rates become 0.
TARGETS = {"clean": 0.955, "low": 0.044, "toxic": 0.001}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the field can tell; those of no letter, or with all languages about as likely, go."""
    return crf.keep_known(docs, least=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are cut out; documents of which nothing stays go."""
    out = linedup.delete_repeats(spark, docs)
    return out.where((F.col("n_deleted") == 0) | F.coalesce(F.col("text").rlike(r"\S"), F.lit(True))).withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return anchors.keep_one(spark, docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights of clean, low-quality and toxic text."""
    return mixing.keep_mixed(spark, docs, table(spark, sf_dir, "labels"), TARGETS).select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, by number and digest, and the digest of the text decoded from them."""
    return bpe.encode_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL can't express a learned model; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
