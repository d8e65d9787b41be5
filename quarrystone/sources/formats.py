"""File formats, text ingestion and JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round_trip(df: DataFrame, kind: str, path: str) -> DataFrame:
    """The rows written in a format and read again with the known schema: no pass over the data to infer one."""
    options = {"header": "true"} if kind == "csv" else {}
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).options(**options).load(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; nulls are left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def strip_boilerplate(lines: DataFrame, begin: str, end: str, column: str = "value") -> DataFrame:
    """Lines of each file between a begin mark and an end mark; a file without marks stays whole. lines: path, n, value."""
    from pyspark.sql import Window

    w = Window.partitionBy("path")
    marks = lines.withColumn("_a", F.max(F.when(F.col(column).contains(begin), F.col("n"))).over(w)).withColumn("_b", F.min(F.when(F.col(column).contains(end), F.col("n"))).over(w))
    return marks.where((F.col("_a").isNull() | (F.col("n") > F.col("_a"))) & (F.col("_b").isNull() | (F.col("n") < F.col("_b")))).drop("_a", "_b")


def chunk_text(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, chunk, piece): whole texts cut into pieces of at most size characters."""
    n = F.ceil(F.length(text_col) / size)
    each = docs.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk"))
    return each.select(id_col, "chunk", F.substring(F.col(text_col), (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("piece"))
