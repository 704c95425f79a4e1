"""Corpus pipeline: language ID, near dedup, substring dedup, decontamination, encoding. Part of the llm subpackage.

Each stage takes (spark, docs, sf_dir); docs has the columns of `documents`. A stage's result is written as Parquet and
read again as the docs of the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sturdytab.llm import decontaminate, language, near_copies, pieces, substring_dedup
from sturdytab.llm.common import need, table
from sturdytab.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without letters go. A null lang is filled in."""
    need(docs, *COLUMNS)
    model = language.fit_languages(docs)
    labelled = language.label_languages(docs, model, carry=("text", "lang", "source", "n_chars"))
    kept = labelled.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by similarity 0.8 the document with the smallest id. Equal rows count once. Documents without
    an id stay only where no document of their group has one."""
    need(docs, *COLUMNS)
    found = near_copies.near_copies(docs)
    kept = found.where("doc_id <=> component").select(F.col("doc_id").alias("kept_id")).distinct()
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.select(*COLUMNS).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place, already holds. n_chars follows."""
    need(docs, *COLUMNS)
    kept = substring_dedup.remove_repeats(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                       F.length("kept_text").cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    need(docs, *COLUMNS)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti").select(*COLUMNS)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentation of each text, and whether it decodes to the very text."""
    need(docs, *COLUMNS)
    vocabulary = pieces.load_vocabulary(pieces.DEFAULT_MODEL)
    drawn = pieces.encode(docs, vocabulary, carry=("lang", "source"), check="lossless")
    return drawn.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("sentencepiece", in_pieces),
]

#: The first stage learns its model, which SQL cannot express; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
