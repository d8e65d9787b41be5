"""The training-data queries, each over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.common import bounded_batches, table
from quarrystone.llm.itq import near_duplicates as near_vectors
from quarrystone.llm.kneser_ney import classify
from quarrystone.llm.licenses import scan_licenses
from quarrystone.llm.line_dedup import line_bitmaps
from quarrystone.llm.minhash import near_duplicates
from quarrystone.llm.mixing import mix_ids
from quarrystone.llm.packing import pack_documents
from quarrystone.llm.quality_rules import keep_by_rules
from quarrystone.llm.toxicity import toxic_documents
from quarrystone.llm.warc import write_pages


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the files that hold all pages."""
    return write_pages(spark, table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_bitmaps(table(spark, sf_dir, "documents")).drop("key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_ids(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that no certified rule rejects."""
    return keep_by_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that have near-duplicates, each with its class and its number of links."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents called toxic."""
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have near-duplicates, each with the one of its group that stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their perplexity and their language's limit."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep").drop("key", "keep")


def _bounded(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _bounded(f) for f in (op1_packing, op2_license_scan, op3_warc, op4_line_dedup, op5_mixing, op6_quality_rules, op7_embedding_near_dedup, op8_toxicity, op9_minhash, op10_quality_classifier)}

ORACLES = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), marked AS (
  SELECT doc_id, pos, trimmed = '' OR row_number() OVER (PARTITION BY trimmed ORDER BY doc_id, pos) = 1 AS keep
  FROM (SELECT doc_id, pos, regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS trimmed FROM lines)
), edges AS (
  SELECT *, CASE WHEN keep = lag(keep, 1, true) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS edge FROM marked
), runs AS (
  SELECT doc_id, run, count(*) AS n, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS kept
  FROM (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edges) GROUP BY doc_id, run
)
SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines, CAST(sum(kept) AS INTEGER) AS n_kept,
       CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep_bitmap
FROM runs GROUP BY doc_id
""",
}
