"""Registration of named queries with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.sources.tables import TABLES, load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql is what DuckDB runs on the same tables, if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views for the tables that a statement names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            load(spark, sf_dir, name).createOrReplaceTempView(name)


def statement(name: str, text: str, sql: str | None = None) -> None:
    """Registers a Spark SQL statement; sql: DuckDB's wording where it differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    run.__name__ = name
    query(sql or text)(run)
