"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

The index is fitted on a bounded sample, the FIT distinct vectors with the least hashes: vectors are scaled to length 1 and
centred, the principal directions are rotated by ITERATIONS rounds of B = sign(V R), then R from the singular vectors of
V'B, and the signs of V R are the code. All vectors are indexed.

Multi-index search: a family of tables cuts the code's bits into PARTS parts; further families cut other orders of the
bits. Each vector is filed under each part and under each part with one bit turned, so two vectors meet in a table exactly if
their parts differ in at most two bits. How many families there are follows from the geometry of the data, never from its
size: partners at exactly COSINE are made for the sample's vectors, in the directions in which the data differ, and
families are added until TARGET of these pairs meet. REACH, the Hamming distance up to which pairs are reranked, comes from
the same pairs. The rows for each vector are families * (PARTS + bits) whatever the corpus is, and so is the recall.

A pair is taken where it meets first: in its first table (which both codes tell), under one key (which the turned bits
tell), so nothing has to be made distinct. Pairs within REACH whose cosine similarity of the original vectors is at least
COSINE are links. Equal vectors are searched as one and never paired among themselves; the links between different vectors are
all kept. The result has a row per vector with its class (connected by links) and its number of links.

Defined results: null vectors, vectors with a null, NaN or infinite part, zero vectors, and vectors whose dimension isn't the most
frequent one (ties: the larger) take no part. Rows that repeat (same vec_id and vector) are one row; a null vec_id takes no
part; an id with several vectors has a row for each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import cut
from quarrystone.llm.components import components

COSINE = 0.95

ITERATIONS = 12

SEED = 11

MAX_BITS = 64

#: Distinct vectors on which the index is fitted.
FIT = 20_000

#: Pairs at COSINE that are made to count the families.
PROBES = 4_000

PARTS = 3

#: Bits in which two parts may differ.
TURNS = 2

#: Share of the pairs at exactly COSINE that must meet; pairs above meet more often.
TARGET = 0.97

MAX_FAMILIES = 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def valid_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v, h, g) of the rows that take part, v an array of doubles, h and g hashes of it; and the dimension."""
    v = F.col("embedding").cast("array<double>")
    d = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    d = d.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    most = d.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most["dim"] if most else 0
    return d.where(F.size("v") == dim).select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(7)).alias("g")), dim


def learn(x: np.ndarray, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the rows of x (of length 1) and the projection (dimension x bits) whose signs are the code."""
    mean = x.mean(axis=0)
    centred = x - mean
    bits = min(x.shape[1], MAX_BITS)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    w = directions[:, np.argsort(-values, kind="stable")[:bits]]
    projected = centred @ w
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(iterations):
        u, _, vt = np.linalg.svd(projected.T @ np.where(projected @ r >= 0, 1.0, -1.0))
        r = u @ vt
    return mean, w @ r


def partners(x: np.ndarray, cosine: float, seed: int = SEED) -> np.ndarray:
    """For each row one at exactly this cosine, away towards another row."""
    rng = np.random.default_rng(seed)
    away = x[rng.permutation(len(x))] - x + 1e-9 * rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * _unit(away)


def layout(x: np.ndarray, mean: np.ndarray, p: np.ndarray, cosine: float = COSINE, target: float = TARGET, seed: int = SEED) -> tuple[list[np.ndarray], int]:
    """The bits of each table, and the Hamming distance up to which pairs are reranked."""
    x = x[:PROBES]
    differ = ((x - mean) @ p >= 0) != ((partners(x, cosine) - mean) @ p >= 0)
    bits = p.shape[1]
    reach = int(np.quantile(differ.sum(axis=1), 0.999, method="higher"))
    rng = np.random.default_rng(seed)
    tables: list[np.ndarray] = []
    met = np.zeros(len(x), bool)
    for k in range(MAX_FAMILIES):
        order = np.arange(bits) if k == 0 else rng.permutation(bits)
        for part in np.array_split(order, PARTS if bits >= PARTS else 1):
            tables.append(part)
            met |= differ[:, part].sum(axis=1) <= TURNS
        if met.mean() >= target:
            break
    return tables, max(reach, TURNS)


def _mask(part: np.ndarray) -> int:
    """The bits of a table as a signed 64-bit number."""
    return int(np.int64(np.uint64(sum(1 << int(i) for i in part))))


def _encode(mean: np.ndarray, p: np.ndarray, tables: list[np.ndarray]):
    """For each vector its code and the keys under which it is filed: turned is 0, or the number of the bit that is turned."""
    bits = p.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        shifts = [np.arange(len(part), dtype=np.int64) for part in tables]
        for b in batches:
            signs = (_matrix(b.column("v"), len(mean)) - mean) @ p >= 0
            code = (signs * powers).sum(axis=1, dtype=np.uint64).view(np.int64)
            ids = b.column("x").to_numpy(zero_copy_only=False)
            for at in range(0, len(code), 1024):
                keys, turned = [], []
                for t, part in enumerate(tables):
                    own = (signs[at : at + 1024, part] << shifts[t]).sum(axis=1)[:, None]
                    key = np.concatenate([own, own ^ (1 << shifts[t])], axis=1) | (t << 33)
                    keys.append(key)
                    turned.append(np.broadcast_to(np.arange(key.shape[1], dtype=np.int32), key.shape))
                key, turn = np.concatenate(keys, axis=1), np.concatenate(turned, axis=1)
                rows = np.repeat(np.arange(at, at + len(key)), key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(code[rows]), pa.array(key.ravel()), pa.array(turn.ravel())], names=["x", "code", "key", "turned"])

    return run


def links(unique: DataFrame, dim: int, cosine: float = COSINE, fit: int = FIT, target: float = TARGET) -> DataFrame:
    """(x, y, cosine) with x < y of the vectors that are alike, from a kept table (x, v, h) of different vectors."""
    n = unique.count()
    # About fit of the least hashes, then exactly those.
    share = min(1.0, 1.5 * fit / max(n, 1))
    least = unique.where(F.shiftright("h", 32).cast("double") < -2147483648.0 + share * 4294967296.0) if share < 1 else unique
    x = _matrix(least.orderBy("h", "x").limit(fit).select("v").toArrow().column("v").combine_chunks(), dim)
    mean, p = learn(x)
    tables, reach = layout(x, mean, p, cosine, target)
    keyed = unique.select("x", "v").mapInArrow(_encode(mean, p, tables), "x bigint, code bigint, key bigint, turned int")
    # The same table on both sides: it is shuffled once.
    a, b = keyed.alias("a"), keyed.alias("b")
    tx, ty = F.col("a.turned"), F.col("b.turned")
    differ = F.col("a.code").bitwiseXOR(F.col("b.code"))
    first = F.coalesce(*[F.when(F.bit_count(differ.bitwiseAND(F.lit(_mask(part)))) <= TURNS, t) for t, part in enumerate(tables)])
    once = (ty == 0) | ((tx > 0) & (tx < ty))
    met = a.join(b, F.col("a.key") == F.col("b.key")).where((F.col("a.x") < F.col("b.x")) & once & (F.bit_count(differ) <= reach) & (first == F.shiftright("a.key", 33))).select(F.col("a.x").alias("x"), F.col("b.x").alias("y"))
    dot = F.aggregate(F.zip_with("vx", "vy", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, t: s + t * t))
    left = unique.select("x", F.col("v").alias("vx"), norm("v").alias("nx"))
    right = unique.select(F.col("x").alias("y"), F.col("v").alias("vy"), norm("v").alias("ny"))
    return met.join(left, "x").join(right, "y").select("x", "y", (dot / (F.col("nx") * F.col("ny"))).alias("cosine")).where(F.col("cosine") >= cosine)


def near_duplicates(rows: DataFrame, cosine: float = COSINE, fit: int = FIT) -> DataFrame:
    """(vec_id, class_id, links) of the rows that have a link: class_id is the least vec_id of the class, links the number of
    other rows whose vector is alike or equal."""
    spark = rows.sparkSession
    valid, dim = valid_vectors(rows)
    if dim == 0:
        return spark.createDataFrame([], "vec_id bigint, class_id bigint, links bigint")
    # Different vectors, numbered; the ids stay in a narrow table.
    unique = cut(valid.groupBy("v").agg(F.first("h").alias("h"), F.first("g").alias("g")).withColumn("x", F.monotonically_increasing_id()))
    members = cut(valid.select("vec_id", "h", "g").distinct().join(unique.select("h", "g", "x"), ["h", "g"]).select("vec_id", "x"))
    sizes = members.groupBy("x").agg(F.count(F.lit(1)).alias("k"), F.min("vec_id").alias("least"))
    found = cut(links(unique, dim, cosine, fit).select("x", "y"))
    ends = found.select("x", F.col("y").alias("to")).unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("to")))
    degree = ends.join(sizes.select(F.col("x").alias("to"), "k"), "to").groupBy("x").agg(F.sum("k").alias("links"))
    root = components(found.select(F.col("x").alias("u"), F.col("y").alias("v")))
    each = cut(
        sizes.join(degree, "x", "left").join(root.withColumnRenamed("id", "x"), "x", "left").select("x", F.coalesce("root", "x").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("links")).where("links > 0")
    )
    classes = each.groupBy("root").agg(F.min("least").alias("class_id"))
    return members.join(each.select("x", "root", "links"), "x").join(classes, "root").select("vec_id", "class_id", "links")
