"""Inserts, updates and deletes as pure functions from a table's rows to its new rows, and constraint checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrystone.sources.shared import cut


class ConstraintError(ValueError):
    """Rows that the table's constraints don't allow."""


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    key: str


@dataclass(frozen=True)
class TableSchema:
    columns: StructType
    primary_key: str | None = None
    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    auto_increment: str | None = None
    defaults: Mapping[str, object] = field(default_factory=dict)
    checks: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    #: Column and uniqueness by the index's name.
    indexes: Mapping[str, tuple[str, bool]] = field(default_factory=dict)


def ranked(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """The rows with their place (from 1) in an order, by ranges instead of one sequence.

    Ranges are sorted and counted; what is collected is a number for each range. The rows are kept in between, as a sample
    gives the ranges' bounds. Ties have different places.
    """
    order = list(order) or [F.lit(0)]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["_p"]: r["n"] for r in placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    starts = F.array(*[F.lit(x) for x in first]) if first else F.array(F.lit(0))
    return placed.withColumn(name, F.get(starts.cast("array<bigint>"), part) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at")


def conform(rows: DataFrame, schema: TableSchema) -> DataFrame:
    """The table's columns in order, cast as stores do (ANSI: a value that doesn't fit is an error); missing ones are null or their default."""
    unknown = [c for c in rows.columns if c not in schema.columns.names]
    if unknown:
        raise ConstraintError(f"unknown columns: {', '.join(unknown)}")
    out = []
    for f in schema.columns:
        c = F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(schema.defaults.get(f.name))
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def number_rows(rows: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    """Nulls in an auto-increment column become the next whole numbers, in the order of the other columns.

    The rows that lack a number are sorted by range, and each range goes on where those before it end.
    """
    top = existing.select(F.max(column).alias("_a")).crossJoin(rows.select(F.max(column).alias("_b"))).select(F.greatest("_a", "_b", F.lit(0)).alias("_top"))
    given = rows.where(F.col(column).isNotNull())
    missing = ranked(rows.where(F.col(column).isNull()), [c for c in rows.columns if c != column], "_n").crossJoin(F.broadcast(top))  # one row
    return given.unionByName(missing.withColumn(column, (F.col("_top") + F.col("_n")).cast(rows.schema[column].dataType)).select(*rows.columns))


def violations(rows: DataFrame, schema: TableSchema, existing: DataFrame | None = None, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(rule, column, n): how many new rows break each rule; only broken rules are listed. A unique column may repeat null."""
    parts = []

    def found(rule: str, column: str, bad: DataFrame) -> None:
        parts.append(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.lit(column).alias("column"), "n"))

    required = dict.fromkeys([*([schema.primary_key] if schema.primary_key else []), *schema.not_null, *([schema.auto_increment] if schema.auto_increment else [])])
    for c in required:
        found("not null", c, rows.where(F.col(c).isNull()))
    for c in dict.fromkeys([*([schema.primary_key] if schema.primary_key else []), *schema.unique]):
        keys = rows.select(c, F.lit(1).alias("_new"))
        if existing is not None:
            keys = keys.unionByName(existing.select(c, F.lit(0).alias("_new")))
        clash = keys.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k"), F.sum("_new").alias("new")).where("k > 1 and new > 0")
        found("unique", c, clash.select(F.explode(F.sequence(F.lit(1), F.col("new")))))
    for check in schema.checks:
        found("check", check, rows.where(F.expr(f"not ({check})")))
    for k in schema.foreign_keys:
        other = (tables or {})[k.table].select(F.col(k.key).alias("_key"))
        found("foreign key", k.column, rows.where(F.col(k.column).isNotNull()).join(other, F.col(k.column) == F.col("_key"), "left_anti"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "rule string, column string, n long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def check(rows: DataFrame, schema: TableSchema, existing: DataFrame | None = None, tables: Mapping[str, DataFrame] | None = None) -> None:
    bad = violations(rows, schema, existing, tables).collect()  # a row per rule at most
    if bad:
        raise ConstraintError("; ".join(f"{r['rule']} on {r['column']}: {r['n']} rows" for r in bad))


def insert_df(table: DataFrame, rows: DataFrame, schema: TableSchema | None = None) -> DataFrame:
    """The table with the rows. With a schema they are cast, numbered and given their defaults."""
    if schema is not None:
        rows = conform(rows, schema)
        if schema.auto_increment:
            rows = number_rows(rows, table, schema.auto_increment)
    return table.unionByName(rows)


def update_df(table: DataFrame, assignments: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """All assignments see the old row; a condition that is null leaves the row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, assignments[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in table.columns])


def delete_df(table: DataFrame, where: Column | None = None) -> DataFrame:
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def upsert_df(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with a known key take the place of the old ones."""
    return table.join(rows.select(*key), list(key), "left_anti").select(*table.columns).unionByName(rows)
