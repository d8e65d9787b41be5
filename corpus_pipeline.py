"""A training corpus from documents: quality classifier, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it returns is written as Parquet
and read again. All but the last return the columns of documents, and extra columns whatever their names are. Stages
don't fail on nulls in any column, empty or very long texts, ties, repeated rows or an empty table (which gives an empty
table); what happens to each is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import kneser_ney, line_dedup, minhash, mixing, packing
from quarrystone.llm.common import bounded_batches, shared_path, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit.

    Null and blank texts go; a null language is a language; rows that repeat, and ties, share a verdict; a null doc_id is judged
    like any other. Without trusted documents all texts stay.
    """
    bounded_batches(spark)
    return kneser_ney.keep_documents(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occurred before; those that had no others go.

    Null and blank texts go. Of equal lines the one in the least (doc_id, text hash, position) stays, nulls first; whole rows that
    repeat keep the same lines.
    """
    bounded_batches(spark)
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all others.

    Null texts and texts without words stay, as they are nobody's duplicates. Of a group the least (doc_id, text hash) stays,
    nulls first; of rows that repeat, one.
    """
    bounded_batches(spark)
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokens fill each source's share of the budget.

    Null and empty texts have no tokens and go; a null source is a source; rows that repeat stay or go together; documents of one
    length are chosen by a seeded hash.
    """
    bounded_batches(spark)
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences.

    Long documents are cut into pieces; a null or empty text has one row without a place; rows that repeat are packed each.
    """
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the knapsack, the packing or the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
