"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected, per language, with high confidence.

Every document gets a few measures of its bytes (RULES). Labelled texts, each counted once in its language however many rows
have it, are split by a seeded hash of the text into a half that proposes and a holdout that certifies: copies are one
trial of the binomial bound and lie in the same half. In the proposing half the cutoff of a rule at level k is the GRID[k] upper quantile
of the good documents of the language; a rule takes part in a language from the level on at which most of what it rejects
there is labelled bad. One level stands for the cutoffs of all rules of its language, and the sets that levels reject grow with the
level, so the levels are tested in order: for each the exact binomial (Clopper-Pearson) upper bound of the rate at which the
holdout's good documents are rejected, at confidence 1 - DELTA / number of languages (Bonferroni), must be at most ALPHA;
the first failure ends the sequence. Of the certified levels the least is taken that rejects, within TOLERANCE, as many bad
documents of the proposing half as the last one. With probability 1 - DELTA no language loses more than ALPHA of its good
documents. A language that nothing certifies keeps all its documents.

The measures are whole numbers (ten-thousandths), so quantiles come from histograms with at most 10,001 bins per rule and
language, counted over all labelled documents; a task sees the histogram of one rule and language. Cutoffs are a table with a
row per language that is joined to the documents.

Defined results: a null or empty text has all measures 0 and is kept unless a cutoff is below 0, which can't be. A null
language is a language of its own. Repeated labels, and labels of equal texts, count once with the least quality; labels
without doc_id or quality are ignored. Rows that repeat are judged alike and count once in the bound. A language without labels keeps all. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import BROADCAST_ROWS, byte_chunks, cut, text_bytes

ALPHA = 0.02

DELTA = 0.05

SEED = 29

#: Upper tails of the good documents at which cutoffs are proposed, from lenient to strict.
GRID = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02)

TOLERANCE = 0.005

RULES = ("upper", "symbols", "digits", "exclaim", "spaces", "repeats", "long_words", "lines")

_CLASS = np.zeros(256, np.uint8)
for _name, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b" \t\r\x0b\x0c", b"\n", b"#$%&*+/<=>@\\^_`{|}~[]"), 1):
    _CLASS[list(_chars)] = _name


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of RULES for each text, in ten-thousandths."""
    n = len(offsets) - 1
    out = np.zeros((n, len(RULES)), np.int32)
    for i, j in byte_chunks(offsets):
        size = np.diff(offsets[i : j + 1])
        part = data[offsets[i] : offsets[j]]
        doc = np.repeat(np.arange(j - i, dtype=np.int64), size)
        count = np.bincount(doc * 8 + _CLASS[part], minlength=8 * (j - i)).reshape(-1, 8)
        upper, lower, digits, exclaim, spaces, breaks, symbols = count.T[1:]
        words = spaces + breaks + 1
        visible = size - spaces - breaks

        def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.minimum(10_000, 10_000 * a // np.maximum(b, 1))

        out[i:j, 0] = share(upper, upper + lower)
        out[i:j, 1] = share(symbols, visible)
        out[i:j, 2] = share(digits, visible)
        out[i:j, 3] = share(exclaim, words)
        out[i:j, 4] = share(spaces, size)
        out[i:j, 6] = share(visible, 40 * words)  # 10,000: 40 bytes a word
        out[i:j, 7] = share(breaks, words)
        for k in range(i, j):
            w = data[offsets[k] : offsets[k + 1]].tobytes().split()
            out[k, 5] = int(10_000 * _repeats(w)) if len(w) > 1 else 0
    return out


def _repeats(words: list[bytes]) -> float:
    """Share of the pairs of neighbouring words that occurred before."""
    pairs = list(zip(words, words[1:], strict=False))
    return 1 - len(set(pairs)) / len(pairs)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = measures(*text_bytes(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("h"), *(pa.array(m[:, k]) for k in range(len(RULES)))], names=["doc_id", "lang", "h", *RULES])


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate at which so few rejections in n have probability delta."""
    if n == 0 or rejected >= n:
        return 1.0
    choose = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(rejected + 1)]
    low, high = rejected / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(c + (k * math.log(p) if k else 0.0) + (n - k) * math.log1p(-p)) for k, c in enumerate(choose)) if 0 < p < 1 else float(p == 0)
        low, high = (p, high) if tail > delta else (low, p)
    return high


def propose(histogram: pd.DataFrame, grid: tuple[float, ...] = GRID) -> dict[tuple[str | None, str], list[int | None]]:
    """Cutoffs by (language, rule), one for each level; a document is rejected above its cutoff. None: the rule rests.

    histogram: lang, rule, value, quality, n of the proposing half.
    """
    out = {}
    for (lang, rule), h in histogram.groupby(["lang", "rule"], dropna=False):
        good, bad = (h[h["quality"] == q].groupby("value")["n"].sum().sort_index() for q in (1, 0))
        if not len(good) or not len(bad):
            continue
        n, above = int(good.sum()), good[::-1].cumsum()[::-1] - good  # good documents over each value
        cutoffs: list[int | None] = []
        for level in grid:
            cutoff = int(above.index[above.to_numpy() <= level * n][0])
            lost, caught = int(good[good.index > cutoff].sum()), int(bad[bad.index > cutoff].sum())
            cutoffs.append(cutoff if caught > lost else None)
        # Levels are nested: a rule doesn't rest again, and doesn't become more lenient.
        for k in range(1, len(cutoffs)):
            if cutoffs[k - 1] is not None and (cutoffs[k] is None or cutoffs[k] > cutoffs[k - 1]):
                cutoffs[k] = cutoffs[k - 1]
        out[None if pd.isna(lang) else lang, rule] = cutoffs
    return out


def certify(tallies: pd.DataFrame, alpha: float = ALPHA, delta: float = DELTA, levels: int = len(GRID), languages: int | None = None) -> dict[str | None, int]:
    """The level of each language that has a certified one. languages: how many share delta; None: those of tallies.

    tallies: lang, half (0 proposes, 1 certifies), quality, level (the first that rejects; `levels`: none does), n.
    """
    groups = {k: g for k, g in tallies.groupby("lang", dropna=False)}  # noqa: C416 (a null key has no other way)
    out = {}
    for lang, t in groups.items():

        def rejected(half: int, quality: int, t: pd.DataFrame = t) -> tuple[np.ndarray, int]:
            x = t[(t["half"] == half) & (t["quality"] == quality)]
            return np.cumsum(np.bincount(x["level"].to_numpy(np.int64), x["n"], levels + 1))[:levels].astype(int), int(x["n"].sum())

        good, n = rejected(1, 1)
        last = -1
        while last + 1 < levels and upper_bound(good[last + 1], n, delta / (languages or len(groups))) <= alpha:
            last += 1
        if last >= 0:
            bad, m = rejected(0, 0)
            out[None if pd.isna(lang) else lang] = int(np.flatnonzero(bad[: last + 1] >= bad[last] - TOLERANCE * m)[0])
    return out


def _by_language(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with a kept table of one row per language, null matching null."""
    named = table.withColumnRenamed("lang", "_lang")
    small = table.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(named) if small else named, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")


def _level(levels: int) -> Column:
    """The first level that rejects a document; levels: none does. What levels reject grows, so it is told by their number."""
    over = lambda value: lambda c: value > c
    rejecting = [F.coalesce(F.size(F.filter(F.col("cutoffs")[r], over(F.col(r)))), F.lit(0)) for r in RULES]
    return F.lit(levels) - F.greatest(*[F.when(n < 0, 0).otherwise(n) for n in rejecting])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, DataFrame]:
    """All documents with their measures and keep; and the cutoffs in force (lang, rule, cutoff)."""
    d = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(lang as string) as lang", "xxhash64(text) as h", "text")
    schema = "doc_id bigint, lang string, h bigint, " + ", ".join(f"{r} int" for r in RULES)
    all_ = cut(d.mapInArrow(_measure, schema))
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    half = F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(2)).cast("int").alias("half")
    labelled = cut(all_.join(known, "doc_id").groupBy("lang", "h", *RULES).agg(F.min("quality").alias("quality")).select("lang", *RULES, "quality", half))
    long = labelled.where("half = 0").select("lang", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("x"))
    histogram = long.groupBy("lang", "quality", "x.rule", "x.value").agg(F.count(F.lit(1)).alias("n"))

    def cutoffs_of(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(lang, rule, c) for (lang, rule), c in propose(p).items()], columns=["lang", "rule", "c"])

    proposed = histogram.groupBy("lang", "rule").applyInPandas(cutoffs_of, "lang string, rule string, c array<int>")
    cutoffs = cut(proposed.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "c"))).alias("cutoffs")))  # a row per language, an entry per rule
    levels = len(GRID)
    tallies = _by_language(labelled, cutoffs).select("lang", "half", "quality", _level(levels).alias("level")).groupBy("lang", "half", "quality", "level").agg(F.count(F.lit(1)).alias("n"))
    languages = labelled.select("lang").distinct().count()

    def certified(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(certify(p, alpha, delta, levels, languages).items()), columns=["lang", "level"])

    level = tallies.groupBy("lang").applyInPandas(certified, "lang string, level int")
    force = cut(_by_language(cut(level), cutoffs).select("lang", F.transform_values("cutoffs", lambda r, c: F.get(c, F.col("level"))).alias("limits")))
    reject = F.lit(False)
    for r in RULES:
        reject = reject | F.coalesce(F.col(r) > F.col("limits")[r], F.lit(False))
    judged = _by_language(all_, force).withColumn("keep", ~reject).drop("h", "limits")
    return judged, force.select("lang", F.explode("limits").alias("rule", "cutoff")).where("cutoff is not null")


def keep_by_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang and measures of the documents that no rule rejects."""
    return judge(docs, labels)[0].where("keep").drop("keep")
