"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import kept


def _print(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an exclusive or of their hashes: alike only for equal sets."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1] or 0


def components(links: DataFrame) -> DataFrame:
    """(id, root) for the ids of links (u, v) that aren't roots themselves; root: the least id that is connected with the id.

    The least neighbour of a node comes from a grouped minimum that is joined back, so a hub's edges stay spread: what is
    sent for it is one row from each task, and the join may be split. A link of an id with itself, a repeated link and an
    empty table give nothing of their own.
    """
    edges = kept(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = _print(edges)
    while True:
        # Large star: neighbours above a node go to its least neighbour. Small star: those below do, and the node too.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = kept(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = kept(small, "edges")
        after = _print(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = after
