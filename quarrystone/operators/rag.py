"""Retrieval: TF-IDF and semantic features, retrieval over a knowledge graph, and hybrid ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import text as X
from quarrystone.functions import vector as V
from quarrystone.operators.vector import knn_join
from quarrystone.sources.shared import cut


@dataclass(frozen=True)
class HybridConfig:
    """vector_weight implies the graph's weight as its complement."""

    vector_weight: float = 0.5
    max_vector_results: int = 20
    max_graph_results: int = 3
    similarity_threshold: float = 0.7

    def __post_init__(self) -> None:
        if not 0 <= self.vector_weight <= 1:
            object.__setattr__(self, "vector_weight", min(1.0, max(0.0, self.vector_weight)))

    @property
    def graph_weight(self) -> float:
        return 1 - self.vector_weight


#: Presets: general, precise, exploratory.
PRESETS = {"general": HybridConfig(similarity_threshold=0.7), "precise": HybridConfig(0.6, 10, 2, 0.85), "exploratory": HybridConfig(0.4, 50, 5, 0.6)}


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, n, size): occurrences of each term and the number of terms of the document."""
    t = docs.select(F.col(id_col).alias("id"), X.tokenize(F.col(text_col)).alias("terms"))
    return t.select("id", F.size("terms").alias("size"), F.explode("terms").alias("term")).groupBy("id", "term", "size").agg(F.count(F.lit(1)).alias("n"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, max_terms: int = 512) -> DataFrame:
    """(id, term, weight): tf = n / size, idf = ln(N / df), each document's vector of length 1.

    The vocabulary is the max_terms terms that are in the most documents (ties in the order of the terms): the vectors' dimension, so it is bounded and broadcast.
    """
    counts = cut(term_counts(docs, id_col, text_col))  # texts are read and cut into words once
    total = docs.select(F.count(F.lit(1)).alias("total"))
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(max_terms)
    idf = vocabulary.crossJoin(F.broadcast(total)).select("term", F.log(F.col("total") / F.col("df")).alias("idf"))
    raw = counts.join(F.broadcast(idf), "term").select("id", "term", (F.col("n") / F.col("size") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.withColumn("norm", norm).where("norm > 0").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def relevance(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, score): sum of the tf-idf weights of the terms over the whole vocabulary; documents without them don't appear."""
    counts = term_counts(docs, id_col, text_col).where(F.col("term").isin(terms))
    total = docs.select(F.count(F.lit(1)).alias("total"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = counts.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))  # as many rows as terms
    return scored.groupBy("id").agg(F.sum(F.col("n") / F.col("size") * F.log(F.col("total") / F.col("df"))).alias("score")).where("score > 0")


def semantic_features(docs: DataFrame, text_col: str, dim: int, name: str = "features") -> DataFrame:
    """A column more: indicators and measures of the text, cut or padded to dim, of length 1.

    Features and their norm are columns of their own, so that each is computed once.
    """
    text = F.col(text_col)
    parts = F.concat(X.indicators(text), F.array(*[c.cast("double") for c in X.text_stats(text).values()]))
    sized = docs.withColumn("_f", F.slice(F.concat(parts, F.array_repeat(F.lit(0.0), dim)), 1, dim))
    return sized.withColumn(name, F.coalesce(V.normalize(F.col("_f")), F.col("_f"))).drop("_f")


def graphrag_query(nodes: DataFrame, queries: DataFrame, threshold: float = 0.7, max_results: int = 10) -> DataFrame:
    """(src, dst, score, rank): for each query (id, vector) the nodes (id, vector) at least as alike as the threshold."""
    return knn_join(queries, nodes, max_results, exclude_self=False).where(F.col("score") >= threshold)


def hybrid_query(docs: DataFrame, nodes: DataFrame, queries: DataFrame, config: HybridConfig = PRESETS["general"], entities: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """(src, dst, hybrid_score, vector_score, graph_score): vector results score 1 / rank, graph results their cosine; weighted and added.

    entities (id): vector results outside of it are dropped.
    """
    near = knn_join(queries, docs, config.max_vector_results, metric, exclude_self=False).select("src", "dst", (1 / F.col("rank")).alias("vector_score"))
    if entities is not None:
        near = near.join(entities.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "vector_score")
    graph = graphrag_query(nodes, queries, config.similarity_threshold, config.max_graph_results).select("src", "dst", F.col("score").alias("graph_score"))
    both = near.join(graph, ["src", "dst"], "full")
    score = config.vector_weight * F.coalesce("vector_score", F.lit(0.0)) + config.graph_weight * F.coalesce("graph_score", F.lit(0.0))
    w = Window.partitionBy("src").orderBy(F.desc("hybrid_score"), "dst")
    return both.withColumn("hybrid_score", score).withColumn("r", F.row_number().over(w)).where(F.col("r") <= config.max_vector_results).select("src", "dst", "hybrid_score", "vector_score", "graph_score")


def graph_score(average: Column, path_length: Column, entities: Column) -> Column:
    """An average, less for long paths and more for many entities."""
    return average * (1 / (1 + 0.1 * path_length)) * (1 + F.least(0.05 * entities, F.lit(0.5)))


def keyword_hybrid(docs: DataFrame, id_col: str, text_col: str, keywords: list[str], semantic: DataFrame, weight: float) -> DataFrame:
    """(id, score): semantic score (id, score) times 1 - weight, plus weight where any keyword occurs."""
    low = F.lower(F.col(text_col))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(hit, F.lit(False)).alias("hit"))
    j = d.join(semantic.select("id", F.col("score").alias("s")), "id", "left").where("hit or s is not null")
    return j.select("id", (F.coalesce("s", F.lit(0.0)) * (1 - weight) + F.when(F.col("hit"), weight).otherwise(0.0)).alias("score"))


def keyword_bonus(docs: DataFrame, id_col: str, text_col: str, keywords: list[str], semantic: DataFrame, weight: float) -> DataFrame:
    """(src, dst, score): semantic scores (src, dst, score) times 1 - weight, plus weight where dst's document has any keyword.

    Only the ids of the documents with a keyword are joined.
    """
    low, hit = F.lower(F.col(text_col)), F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    named = docs.where(hit).select(F.col(id_col).alias("dst"), F.lit(True).alias("hit")).distinct()
    return semantic.join(named, "dst", "left").select("src", "dst", (F.col("score") * (1 - weight) + F.when(F.col("hit"), weight).otherwise(0.0)).alias("score"))
