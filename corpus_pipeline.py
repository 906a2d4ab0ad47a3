"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each one's result is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of ``docs``, for the rows they keep.

Common to all stages: other columns of ``docs``, also ones with names that an operator uses itself, are carried along
untouched; repeated rows and ids are rows of their own, which only the near-duplicate stage thins out; texts are taken whole, however
long; missing ids are ids like others; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import (
    op4_order_minhash,
    op5_quality,
    op7_packing,
    op8_decontaminate,
    op10_language,
)
from gapwise.llm.common import keep_table, remainder, table
from gapwise.llm.queries import LANGUAGE_FOLDS, LANGUAGE_HELD_OUT


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose two best languages are too close.

    Missing, empty and blank texts have no letter and go.  Equal texts are judged alike; languages that tie are too close.
    """
    train = remainder(F.col("doc_id"), LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT
    return op10_language.keep_identified(docs, train)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a rule learned from the labels of those still there.

    Missing, empty and blank texts have fewer words than the base rules ask and go.  Without labels only the base rules
    decide.  Equal texts are judged alike.
    """
    return op5_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies.

    Of rows that tie for the least id one stays.  Texts without words are copies of each other if they are equal; a missing
    text counts as an empty one.
    """
    return op4_order_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item.

    Missing, empty and blank texts overlap nothing and stay, as all do when there are no items.  Equal texts are judged alike.
    """
    return op8_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids.

    A missing or empty text is the end id alone.  Which documents share a sequence depends on how Spark splits its input; every id
    is in exactly one piece.
    """
    return op7_packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", judge_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Trained models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Each stage but the last is stored in the shared folder as it ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = keep_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
