"""Mixing sources to target weights: subset-sum budget fitting over exact token lengths.

Documents are counted by (source, token length). Each source gets its share of the token budget; what a source can't
fill is shared out among the others by their weights. Within a source every length gives the same share of its
documents, rounded down or up by one seeded systematic draw over the lengths in order, so that lengths that occur once
get their share too; at most about the longest document's tokens are then left. These are filled by a bounded-knapsack table
over counts (each length as often as documents of it are left, split in powers of two, in a seeded order), whatever their
number is. If that doesn't fill the budget exactly, documents that were rounded up are taken back, in a seeded order, as long
as all that is left is within SPAN longest documents, and the table fills that. Which documents of a length go in is the order
of a seeded hash, so the choice is reproducible and independent of layout; a frequent length is cut into ranges of the
hash, of which only the one at the border is ranked.

Defined results: a null source is a source of its own. A null or empty text has length 0 and costs nothing: it is never
selected. Rows that are alike in doc_id, source and text stay or go together: they count as one document whose length is
the sum of theirs, which is one row of the result. A null doc_id is hashed like any other. A source
without weight gets no budget. An empty table gives no rows. Extra columns are kept in `mix_documents` and never read.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import BROADCAST_ROWS, TOKENIZER, cut, n_tokens

#: Share of the corpus's tokens that the mixture has.
BUDGET_SHARE = 0.5

SEED = 17

#: Target weights of the query and the pipeline: sources of which more is wanted. All others weigh OTHER.
WEIGHTS = {"src1": 2.0, "src2": 2.0, "src3": 3.0}

OTHER = 1.0

#: Tokens that the second knapsack covers, in longest documents of the source.
SPAN = 64

#: Documents of a source and length that are ranked at once.
RANK_ROWS = 1_000_000


def source_budgets(tokens: Mapping[str | None, int], weights: Mapping[str | None, float] | None, budget: int, other: float = 0.0) -> dict[str | None, int]:
    """Tokens by source. weights None: all sources weigh the same; a source that isn't in weights weighs other. A source never gets more than it has."""
    w = {s: (1.0 if weights is None else float(weights.get(s, other))) for s in tokens}
    out = {s: 0 for s in tokens}
    free = sorted((s for s in tokens if w[s] > 0 and tokens[s] > 0), key=lambda s: (s is not None, s))
    left = budget
    while free and left > 0:
        total = sum(w[s] for s in free)
        full = [s for s in free if tokens[s] <= left * w[s] / total]
        if not full:
            for s in free:
                out[s] = int(left * w[s] / total)
            break
        for s in full:
            out[s] = tokens[s]
        left -= sum(tokens[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their tokens are as near below the budget as the table can."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    rng = np.random.default_rng(SEED)
    exact = counts * (budget / total)
    floor = exact.astype(np.int64)
    order = np.argsort(lengths, kind="stable")
    edges = np.floor(np.r_[0.0, np.cumsum((exact - floor)[order])] + rng.random())
    more = np.zeros_like(floor)
    more[order] = np.minimum(np.diff(edges).astype(np.int64), (counts - floor)[order])
    # The draw may be over by about one document: the shortest that makes up for it goes, or the longest.
    while (over := int((lengths * (floor + more)).sum()) - budget) > 0:
        up = np.flatnonzero(more)
        enough = up[lengths[up] >= over]
        more[enough[np.argmin(lengths[enough])] if len(enough) else up[np.argmax(lengths[up])]] -= 1
    order = rng.permutation(len(lengths))
    best = _fill(lengths, counts, budget, floor + more, order)
    left = budget - int((lengths * best).sum())
    if left == 0:
        return best
    rest, span = budget - int((lengths * (floor + more)).sum()), SPAN * int(lengths.max())
    for i in order:
        back = min(int(more[i]), (span - rest) // int(lengths[i]))
        if back > 0:
            more[i] -= back
            rest += back * int(lengths[i])
    again = _fill(lengths, counts, budget, floor + more, order)
    return again if budget - int((lengths * again).sum()) < left else best


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: int, take: np.ndarray, order: np.ndarray) -> np.ndarray:
    """take and what the knapsack adds of the lengths in this order."""
    take = take.copy()
    rest = budget - int((lengths * take).sum())
    # first[s]: the item by which the sum s was first reached. An item is 2^k documents of one length.
    first = np.full(rest + 1, -1, np.int32)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in order:
        n, left = int(lengths[i]), int(min(counts[i] - take[i], rest // int(lengths[i])))
        k = 1
        while left > 0 and not reached[rest]:
            k_now = min(k, left)
            size = k_now * n
            new = np.zeros(rest + 1, bool)
            new[size:] = reached[: rest + 1 - size]
            new &= ~reached
            first[new] = len(items)
            reached |= new
            items.append((i, k_now))
            left -= k_now
            k *= 2
        if reached[rest]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s > 0:
        i, k = items[first[s]]
        take[i] += k
        s -= k * int(lengths[i])
    return take


def choose(lengths: DataFrame, weights: Mapping[str | None, float] | None = WEIGHTS, budget_share: float = BUDGET_SHARE, budget: int | None = None, other: float = OTHER) -> DataFrame:
    """(source, n, count, take) from a kept table of (doc_id, source, n): one row per source and length of which some go in."""
    spark = lengths.sparkSession
    histogram = cut(lengths.where("n > 0").groupBy("source", "n").agg(F.count(F.lit(1)).alias("count")))
    tokens = {r["source"]: int(r["t"]) for r in histogram.groupBy("source").agg(F.sum(F.col("n").cast("bigint") * F.col("count")).alias("t")).collect()}
    shares = source_budgets(tokens, weights, int(sum(tokens.values()) * budget_share) if budget is None else budget, other)
    budgets = spark.createDataFrame([(s, b) for s, b in shares.items()], "source string, budget bigint")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n", kind="stable")
        p["take"] = fit_counts(p["n"].to_numpy(), p["count"].to_numpy(), int(p["budget"].iloc[0]))
        return p.loc[p["take"] > 0, ["source", "n", "count", "take"]]

    small = F.broadcast(budgets) if len(shares) <= BROADCAST_ROWS else budgets
    with_budget = histogram.join(small, histogram["source"].eqNullSafe(budgets["source"])).select(histogram["source"], "n", "count", "budget")
    return with_budget.groupBy("source").applyInPandas(fit, "source string, n int, count bigint, take bigint")


def select_lengths(lengths: DataFrame, seed: int = SEED, rank_rows: int = RANK_ROWS, **how) -> DataFrame:
    """The selected rows (doc_id, source, n_tokens, key) of a kept table (doc_id, source, n, key).

    Of a source and length those with the least hashes go in. Where they are many, the hashes are cut into equal ranges that are
    counted: those before the border go in whole, and only the range at the border is ranked.
    """
    take = cut(choose(lengths, **how)).select(F.col("source").alias("_s"), F.col("n").alias("_n"), "count", "take")
    joined = lengths.join(take, F.col("source").eqNullSafe(F.col("_s")) & (F.col("n") == F.col("_n")))
    h = F.xxhash64(F.lit(seed), "doc_id", "key")
    part = joined.where("take < count").withColumn("h", h).withColumn("bucket", F.floor((F.shiftright(h, 32).cast("double") + 2147483648.0) / 4294967296.0 * F.ceil(F.col("count") / rank_rows)).cast("int"))
    many = part.where(F.col("count") > rank_rows)
    if take.where((F.col("count") > rank_rows) & (F.col("take") < F.col("count"))).isEmpty():
        placed = part.withColumn("before", F.lit(0).cast("bigint")).withColumn("own", F.col("count"))
    else:
        before = F.sum("own").over(Window.partitionBy("_s", "_n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        sizes = many.groupBy("_s", "_n", "bucket").agg(F.count(F.lit(1)).alias("own")).withColumn("before", F.coalesce(before, F.lit(0)))
        sizes = sizes.select(F.col("_s").alias("_s2"), F.col("_n").alias("_n2"), F.col("bucket").alias("_b2"), "own", "before")
        on = F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_n") == F.col("_n2")) & (F.col("bucket") == F.col("_b2"))
        placed = part.join(sizes, on, "left").withColumn("before", F.coalesce("before", F.lit(0))).withColumn("own", F.coalesce("own", "count"))
    whole = placed.where("before + own <= take")
    w = Window.partitionBy("source", "n", "bucket").orderBy("h", "doc_id", "key")
    border = placed.where("before < take and before + own > take").withColumn("rank", F.row_number().over(w)).where("before + rank <= take")
    columns = ["doc_id", "source", F.col("n").alias("n_tokens"), "key"]
    return joined.where("take = count").select(columns).unionByName(whole.select(columns)).unionByName(border.select(columns))


def measure(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n, key) of the distinct rows, kept; key: a hash of text and source. n counts every copy."""
    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text"), tokenizer).alias("n"), F.xxhash64("text", F.col("source").cast("string")).alias("key"))
    return cut(each.groupBy("doc_id", "source", "key").agg(F.sum("n").cast("int").alias("n")))


def mix_ids(docs: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED, **how) -> DataFrame:
    """doc_id, source, n_tokens of the documents in the mixture."""
    return select_lengths(measure(docs, tokenizer), seed, **how).drop("key")


def mix_documents(docs: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED, **how) -> DataFrame:
    """The documents in the mixture, with all their columns."""
    chosen = cut(select_lengths(measure(docs, tokenizer), seed, **how).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    on = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_d")) & (F.xxhash64("text", F.col("source").cast("string")) == F.col("_k"))
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")
    return rows.join(chosen, on, "left_semi").select("_row.*")
