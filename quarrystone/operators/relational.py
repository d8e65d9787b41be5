"""Relational operators as compositions of DataFrame operations; Catalyst picks the physical strategy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<=>": lambda a, b: a.eqNullSafe(b),
    "like": lambda a, b: a.like(b),
    "not like": lambda a, b: ~a.like(b),
    "in": lambda a, b: a.isin(*b),
    "not in": lambda a, b: ~a.isin(*b),
    "between": lambda a, b: a.between(*b),
    "is null": lambda a, b: a.isNull(),
    "is not null": lambda a, b: a.isNotNull(),
}


#: Pairs of rows that a task of few_keys_join makes, about.
TASK_PAIRS = 1 << 22


def predicate(column: str | Column, op: str, value: object = None) -> Column:
    """A comparison by name. Three-valued logic: a comparison with null is null, so `where` drops the row."""
    c = F.col(column) if isinstance(column, str) else column
    try:
        return _COMPARE[op.lower()](c, value)
    except KeyError:
        raise ValueError(f"unknown operator {op!r}") from None


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is less than, equal to or greater than b. Null has no place in the order: comparing it is an error, as is NaN."""
    odd = a.isNull() | b.isNull() | F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(odd, F.raise_error(F.lit("null and NaN can't be ordered")).cast("int")).when(a < b, -1).when(a > b, 1).otherwise(0)


def project(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Columns by position; an empty list keeps all; a position out of range is an IndexError."""
    if not indices:
        return df
    return df.select(*[F.col(f"`{df.columns[i]}`") for i in indices])


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] | Column | None, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join by pairs of names, any join by a condition, or the cross product without one. null_safe: null meets null."""
    if on is None:
        return left.crossJoin(right)
    if not isinstance(on, Column):
        pairs = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in on]
        on = pairs[0]
        for p in pairs[1:]:
            on = on & p
    return left.join(right, on, how)


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_columns: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time; without one the columns are null.

    One shuffle on the key: both sides are laid over each other and the last right row is carried forward by a window, so
    the cost is linear in both sides and no key's rows meet as pairs. Of right rows with equal times the greatest wins.
    """
    key = F.col(by)
    a = left.select(key.alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_l"), F.lit(None).cast(right.select(F.struct(*right_columns)).schema[0].dataType).alias("_r"))
    b = right.select(key.alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"), F.struct(*right_columns).alias("_r"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", F.col("_r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_l.*", *[F.when(F.col("_k").isNotNull(), F.col(f"_m.{c}")).alias(c) for c in right_columns])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join on low <= point < high through buckets of the given width: an equi-join instead of a nested loop.

    A range is filed under every bucket that it touches; width should be near the usual length of a range.
    """
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def few_keys_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join by a column of few values with many rows each, whose pairs are the bulk of the work.

    Both sides of each value are cut into pieces, by a hash of the row, of which each of the left meets each of the right: as many as
    leave a task about TASK_PAIRS pairs, however many there are of one value. A row is sent as often as the other side has pieces,
    the square root of a value's pairs over TASK_PAIRS. The pairs are counted first.
    """
    many = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    pairs = F.col("_left") * F.col("_right")
    most, total = many(left, "_left").join(many(right, "_right"), key).agg(F.max(pairs), F.sum(pairs)).first()
    pieces = max(1, math.ceil(math.sqrt((most or 0) / TASK_PAIRS)))
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_PAIRS))

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        piece = F.pmod(F.xxhash64(*df.columns), F.lit(pieces)).cast("int")
        df = df.where(F.col(key).isNotNull()).withColumn(own, piece).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        return df.repartition(parts, key, "_i", "_j")

    return cut(left, "_i", "_j").join(cut(right, "_j", "_i").hint("merge"), [key, "_i", "_j"]).drop("_i", "_j")


@dataclass(frozen=True)
class AggSpec:
    """function: count, sum, avg, min, max, count_distinct, stddev, median; column None counts rows."""

    function: str
    column: str | None = None
    alias: str | None = None

    def expression(self) -> Column:
        c = F.lit(1) if self.column is None else F.col(self.column)
        f = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct, "stddev": F.stddev_samp, "median": F.median}[self.function]
        return f(c).alias(self.alias or f"{self.function.upper()}({self.column or '*'})")


def aggregate(df: DataFrame, by: Sequence[str], specs: Sequence[AggSpec], having: Column | None = None) -> DataFrame:
    """Grouped aggregation with map-side partial sums; null is a group. Without keys one row, of nulls and 0 for no input."""
    out = df.groupBy(*by).agg(*[s.expression() for s in specs])
    return out if having is None else out.where(having)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows: each task keeps k, one merges them."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes by rank before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def sliding(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, column: str, name: str = "window") -> DataFrame:
    """Full windows of n consecutive values within each group, in step 1, as arrays."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, n - 1)
    return df.withColumn(name, F.collect_list(column).over(w)).where(F.size(name) == n)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], expression: Column, name: str) -> DataFrame:
    """An aggregate over all rows up to the current one."""
    return df.withColumn(name, expression.over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def take_while(df: DataFrame, by: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Rows of each group before the first that doesn't meet the condition (null doesn't)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_stop", F.max((~F.coalesce(condition, F.lit(False))).cast("int")).over(w)).where("_stop = 0").drop("_stop")


def skip_while(df: DataFrame, by: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Rows of each group from the first that doesn't meet the condition on."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_stop", F.max((~F.coalesce(condition, F.lit(False))).cast("int")).over(w)).where("_stop = 1").drop("_stop")


def batches(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, name: str = "batch") -> DataFrame:
    """A number for each run of n rows within each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.floor((F.row_number().over(w) - 1) / n).cast("bigint"))
