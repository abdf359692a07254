"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of their input; rows that a stage rejects are gone for all later ones. The
last one returns the packed pieces of the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritab.llm import decontaminate, language_crf, packing, quality_votes, simhash_pivots
from veritab.llm.common import remove, scratch, written
from veritab.llm.queries import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good."""
    return quality_votes.kept_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are recognised, in one language or several: half of them by their best posterior at least."""
    return language_crf.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash_pivots.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences of 2,048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Expectation-maximisation, a trained random field and a packing heuristic are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table ``documents``. Once a stage's rows are written, its scratch folders and its
    input's go; those of the last stage stay, because its result is read from them."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        remove(spark, read + made[:-1])
        read = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
