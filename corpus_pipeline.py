"""The corpus pipeline: each stage works on all that its predecessor kept.

``run`` applies the stages to ``documents``. All stages but the last return the columns of ``documents``; the last packs
what is left and returns a row per piece. Stages tell rows apart by themselves, not by doc_id: rows that share a doc_id
or have none are judged by their own text like any other, and rows that repeat doc_id and text leave one. A null text is
an empty one, which the first stage rejects; an empty table stays empty; columns that documents has besides stay as they
are. Each stage's ``docs`` is a table that is read in the same parts each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociforge.llm import exact_dedup, language_id, near_dedup, packing, quality
from lociforge.llm.common import discard, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a language; models are learned from the table's own labels.

    Texts without a letter, null and empty ones go; without any label, all go.
    """
    return language_id.keep_languages(docs, language_id.train(docs.where(~language_id.held_out(3, 1))))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that the classifier doesn't call bad; it learns from labels of documents that got here.

    Without labels of both kinds all texts have one score, and stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language_id.held_out(5, 0))
    return quality.keep_good(docs, quality.train(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts one row, with the largest doc_id; null and empty texts are equal."""
    return exact_dedup.drop_exact_duplicates(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five words, similarity 0.8) one row, with the smallest doc_id.

    Texts without words are in no group and stay. Where doc_ids repeat or are missing, a group's first row stays.
    """
    return near_dedup.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; a null text is an empty one, a piece of one token."""
    return packing.pack(docs)


STAGES = [("language", languages), ("quality", good), ("exact", distinct), ("near", different), ("pack", packed)]

#: Models and tokenizers are beyond SQL; the tests hold each stage against plain decisions, text by text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
