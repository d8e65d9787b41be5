"""Readers for the parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; columns and filters of the query reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
