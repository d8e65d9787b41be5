"""Toxicity: non-negative positive-unlabelled learning of a sparse linear classifier in numpy.

Positive are documents that `labels` confirms as toxic; all documents are the unlabelled text, none of them called clean. A
document's features are its distinct lower-case words and their beginnings of four and five letters; of scripts without spaces
they are the pairs of neighbouring characters. The risk is prior * R+(positive) + max(0, R-(unlabelled) - prior *
R-(positive)) with the logistic loss; whenever the bracket turns negative, the step goes against its gradient, so the model
can't gain by calling all unlabelled text clean. An L1 proximal step (AdaGrad) leaves weights only on features that tell. The
class prior is the share of toxic ones among the labelled documents, within PRIOR_RANGE.

Of the labelled rows at most MAX_POSITIVE confirmed documents, those with the least hashes, are read as positive ones; their
features in two documents or more are the vocabulary. Nothing else is sampled: each document is read once, whole, and its
features of the vocabulary are kept as numbers in a table. Their frequencies are sums over it, and so is the unlabelled risk: documents
with the same screened features are one pattern with a count. Patterns come to the driver if there are at most MAX_PATTERNS;
beyond that each step sums the same gradient in tasks. The scores come from the same table.

Defined results: a null or empty text has no features, its probability is that of the bias, and it is never called toxic.
A document whose labels conflict is confirmed if one of them is 1. Without a confirmed document nothing is toxic. Rows that
repeat are scored each. A null doc_id is scored like any other, but never trains. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import kept

MAX_POSITIVE = 3_000

MAX_PATTERNS = 200_000

PRIOR_RANGE = (0.01, 0.5)

#: Logit from which a document is toxic.
THRESHOLD = 0.0

#: L1 strength, relative to the risk's mean gradient.
SPARSITY = 2e-3

STEPS = 300

#: A feature must occur in so many of the positive documents; that more is chance, the screen tells.
LEAST_DOCUMENTS = 2

LEAST_POSTERIOR = 0.7

SIGNIFICANCE = 1.0

_word = regex.compile(r"\p{L}[\p{L}\p{M}'’]+")
_unspaced = regex.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u9fff\uf900-\ufaff]+")


def _found(text: str) -> tuple[set[str], set[str], set[str], set[str]]:
    """Distinct words, beginnings of four and of five letters, and pairs of characters of scripts without spaces."""
    text = text.lower()
    pairs: set[str] = set()
    if not text.isascii() and _unspaced.search(text):
        for run in _unspaced.findall(text):
            pairs.update(run[i : i + 2] for i in range(max(1, len(run) - 1)))
        text = _unspaced.sub(" ", text)
    words = set(_word.findall(text))
    return words, {w[:4] for w in words if len(w) > 4}, {w[:5] for w in words if len(w) > 5}, pairs


def features(text: str | None) -> set[str]:
    """All features, the beginnings and pairs with their length as a mark ("4stup", "5stupi", "2xy")."""
    if not text:
        return set()
    words, four, five, pairs = _found(text)
    return words | {"4" + x for x in four} | {"5" + x for x in five} | {"2" + x for x in pairs}


class Csr:
    """Rows of feature numbers, each as often as counts says: products with a vector from both sides."""

    def __init__(self, rows: list[np.ndarray], counts: np.ndarray | None = None):
        self.at = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.counts = np.ones(len(rows)) if counts is None else np.asarray(counts, float)
        self.n = float(self.counts.sum())

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], len(self.counts))

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, g[self.row], width)

    def loss(self, w: np.ndarray, bias: float, sign: int) -> tuple[float, np.ndarray, float]:
        """Mean logistic loss of calling the rows of one class (sign), and its gradient by weights and bias."""
        z = self.dot(w) + bias
        g = -sign * _sigmoid(-sign * z) * self.counts / self.n
        return float((np.logaddexp(0, -sign * z) * self.counts).sum() / self.n), self.back(g, len(w)), float(g.sum())


class Patterns:
    """The same sums over a kept table (pattern, k), made by tasks."""

    def __init__(self, table: DataFrame, n: int):
        self.table, self.n = table, n

    def loss(self, w: np.ndarray, bias: float, sign: int) -> tuple[float, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(w) + 2)
            for b in batches:
                if b.num_rows:
                    part = Csr([np.asarray(x) for x in b.column("pattern").to_pylist()], b.column("k").to_numpy())
                    loss, g, gb = part.loss(w, bias, sign)
                    out += part.n * np.r_[loss, gb, g]
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "x"])

        total = np.zeros(len(w) + 2)
        for r in self.table.mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toLocalIterator():  # a row per weight
            total[r["at"]] = r["x"]
        return total[0] / self.n, total[2:] / self.n, total[1] / self.n


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def vocabulary(positive: list[set[str]]) -> dict[str, int]:
    """In how many of the positive documents each feature is, of those in LEAST_DOCUMENTS."""
    k = Counter(x for f in positive for x in f)
    return {x: k[x] for x in sorted(k) if k[x] >= LEAST_DOCUMENTS}


def screen(k_p: dict[str, int], n_p: int, k_u: np.ndarray, n_u: int, prior: float) -> list[str]:
    """Features that may carry weight. k_u: in how many unlabelled documents the features of k_p are, in their order.

    By Bayes prior * rate(positive) / rate(unlabelled) is the share of toxic ones among the documents that have the
    feature: it must reach LEAST_POSTERIOR. And the excess must be beyond chance for all features together: the Chernoff
    bound of the binomial tail, times their number, is under SIGNIFICANCE (the false ones to expect at most).
    """
    out = []
    for (x, k), u in zip(k_p.items(), k_u.tolist(), strict=True):
        rate, base = k / n_p, min((u + 1) / (n_u + 1), 1 - 1e-9)
        excess = rate * np.log(rate / base) + ((1 - rate) * np.log((1 - rate) / (1 - base)) if rate < 1 else 0)
        if rate > base and prior * rate / base >= LEAST_POSTERIOR and n_p * excess > np.log(len(k_p) / SIGNIFICANCE):
            out.append(x)
    return sorted(out)


def gradient(p: Csr, u: Csr | Patterns, w: np.ndarray, bias: float, prior: float) -> tuple[float, np.ndarray, float]:
    """The bracket R-(unlabelled) - prior * R-(positive), and the direction of the step by weights and bias: the gradient of
    the risk, or against that of the bracket where it is negative."""
    negative, gn, bn = u.loss(w, bias, -1)
    false, gf, bf = p.loss(w, bias, -1)
    if negative - prior * false < 0:
        return negative - prior * false, prior * gf - gn, prior * bf - bn
    _, gt, bt = p.loss(w, bias, 1)
    return negative - prior * false, prior * gt + gn - prior * gf, prior * bt + bn - prior * bf


def descend(p: Csr, u: Csr | Patterns, width: int, prior: float, steps: int = STEPS, sparsity: float = SPARSITY) -> tuple[np.ndarray, float]:
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    g2, b2 = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        _, g, gb = gradient(p, u, w, bias, prior)
        g2, b2 = g2 + g * g, b2 + gb * gb
        rate = 0.5 / np.sqrt(g2)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity * prior, 0)
        bias -= 0.5 / np.sqrt(b2) * gb
    return w, bias


def numbered(rows: list[set[str]], names: list[str]) -> list[np.ndarray]:
    number = {x: i for i, x in enumerate(names)}
    return [np.array(sorted(number[x] for x in f & number.keys()), np.int64) for f in rows]


def fit(positive: list[set[str]], unlabelled: list[set[str]], prior: float, steps: int = STEPS, sparsity: float = SPARSITY) -> tuple[dict[str, float], float]:
    """Weights by feature (those that aren't 0) and the bias, of documents in memory."""
    k_p = vocabulary(positive)
    k = Counter(x for f in unlabelled for x in f & k_p.keys())
    names = screen(k_p, len(positive), np.array([k[x] for x in k_p], np.int64), len(unlabelled), prior)
    w, bias = descend(Csr(numbered(positive, names)), Csr(numbered(unlabelled, names)), len(names), prior, steps, sparsity)
    return {x: float(w[i]) for i, x in enumerate(names) if w[i]}, bias


def confirmed(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE) -> tuple[list[set[str]], float]:
    """Features of the positive documents, and the class prior.

    The hash of the id decides, so the narrow ids are chosen first and only their texts are read.
    """
    toxic = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    share = toxic.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    chosen = toxic.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).select("doc_id")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # max_positive ids at most
    rows = texts.mapInArrow(_listed, "doc_id bigint, features string").toArrow().sort_by([("doc_id", "ascending"), ("features", "ascending")])
    names: dict[str, str] = {}  # one string object for each feature
    out = [{names.setdefault(y, y) for y in x.split("\n")} - {""} for x in rows.column("features").to_pylist()]
    return out, float(np.clip(share or 0.0, *PRIOR_RANGE))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(["\n".join(sorted(features(t))) for t in b.column("text").to_pylist()], pa.string())], names=["doc_id", "features"])


def _numbers(shared):
    """Of each document the numbers of its features that are in the vocabulary, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[dict[str, int]] = [{}, {}, {}, {}]
        for i, x in enumerate(shared.value):
            mark = "452".find(x[0])
            kinds[mark + 1][x if mark < 0 else x[1:]] = i
        for b in batches:
            out = []
            for t in b.column("text"):
                t = t.as_py()
                out.append(sorted(k[x] for k, found in zip(kinds, _found(t), strict=True) for x in found & k.keys()) if t else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "numbers"])

    return run


def _frequencies(width: int):
    """In how many of a task's documents each feature is; number -1: the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = np.zeros(width, np.int64), 0
        for b in batches:
            k += np.bincount(b.column("numbers").flatten().to_numpy(), minlength=width)
            n += b.num_rows
        at = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, k[at]])], names=["at", "k"])

    return run


def score(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_patterns: int = MAX_PATTERNS, steps: int = STEPS) -> DataFrame:
    """doc_id, logit, probability and toxic of every row."""
    positive, prior = confirmed(docs, labels, max_positive)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    k_p = vocabulary(positive)
    if not k_p:
        out_rows = d.select("doc_id", F.lit(-30.0).alias("logit"))
    else:
        shared = d.sparkSession.sparkContext.broadcast(list(k_p))  # features of max_positive documents
        table = kept(d.mapInArrow(_numbers(shared), "doc_id bigint, numbers array<int>"), "features")
        k_u, n = np.zeros(len(k_p), np.int64), 0
        for r in table.select("numbers").mapInArrow(_frequencies(len(k_p)), "at bigint, k bigint").groupBy("at").agg(F.sum("k").alias("k")).toLocalIterator():  # a row per feature
            if r["at"] < 0:
                n = r["k"]
            else:
                k_u[r["at"]] = r["k"]
        names = screen(k_p, len(positive), k_u, n, prior)
        place = {x: i for i, x in enumerate(names)}
        to = np.array([place.get(x, -1) for x in k_p], np.int64)

        def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [np.sort(y[y >= 0]) for y in (to[np.asarray(x, np.int64)] for x in b.column("numbers").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "pattern"])

        rows = kept(table.mapInArrow(screened, "doc_id bigint, pattern array<int>"), "patterns")
        patterns = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("k"))
        p = Csr(numbered(positive, names))
        patterns = kept(patterns, "patterns")
        if n == 0:
            return d.select("doc_id", F.lit(-30.0).alias("logit"), F.lit(0.0).alias("probability"), F.lit(False).alias("toxic"))
        if patterns.count() <= max_patterns:
            t = sorted((tuple(x), k) for x, k in zip(*(patterns.toArrow().column(c).to_pylist() for c in ("pattern", "k")), strict=True))
            u: Csr | Patterns = Csr([np.array(x, np.int64) for x, _ in t], np.array([k for _, k in t]))
        else:
            u = Patterns(patterns, n)
        w, bias = descend(p, u, len(names), prior, steps)
        bias = min(bias, -1e-9)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = np.array([bias + float(w[np.asarray(x, np.int64)].sum()) for x in b.column("pattern").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "logit"])

        out_rows = rows.mapInArrow(scored, "doc_id bigint, logit double")
    z = F.greatest(F.least("logit", F.lit(30.0)), F.lit(-30.0))
    return out_rows.select("doc_id", "logit", (1 / (1 + F.exp(-z))).alias("probability"), (F.col("logit") > THRESHOLD).alias("toxic"))


def toxic_documents(docs: DataFrame, labels: DataFrame, **how: int) -> DataFrame:
    return score(docs, labels, **how).where("toxic").drop("toxic")
