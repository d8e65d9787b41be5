"""Similarity search over vectors: exact nearest neighbours by blocks, and locality-sensitive hashing."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import vector as V
from quarrystone.sources.shared import cut

#: Rows and bytes of a packed block, rows and bytes of those that a task has of the second side of a search, and rows of each side
#: that are scored at once.
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
PART_ROWS, PART_BYTES = 8 * BLOCK_ROWS, 8 * BLOCK_BYTES
SLICE_ROWS, TILE_ROWS = 512, 2048
#: Pairs whose vectors are gathered at once.
PAIRS = 1 << 14


def knn(df: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", threshold: float | None = None, max_distance: float | None = None) -> DataFrame:
    """The k rows that are most like one vector: id, score, rank from 0. k = 0 gives none. Ties: the least id first.

    A filter and a top-k in one pass: every task keeps k rows.
    """
    scored = df.select(F.col(id_col).alias("id"), V.similarity(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]), metric).alias("score")).where("score is not null")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    if max_distance is not None:
        scored = scored.where(1 - F.col("score") <= max_distance)
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def _packed(rows: DataFrame, parts: int, marks: str | None = None) -> DataFrame:
    """(block, dim, ids, vectors, marks): rows (id, vector) as arrays of bytes, kept in the shared folder.

    A block has at most BLOCK_ROWS rows and BLOCK_BYTES bytes, of one dimension; vectors of floats stay floats. marks names a column of
    numbers or bytes that goes along: a row's values, all of one length. Rows go to parts by their id, or are sorted by cell if marks is that.
    """
    single = rows.schema["vector"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    mark = F.lit(b"") if marks is None else F.col(marks)
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>" if single else "array<double>").alias("vector"), mark.alias("marks")).where("id is not null and vector is not null")
    rows = rows.repartitionByRange(parts, "marks", "id").sortWithinPartitions("marks", "id") if marks == "cell" else rows.repartition(parts, F.xxhash64("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        block = TaskContext.get().partitionId() << 32

        def full(dim: int, rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block
            most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
            n = sum(len(x[0]) for x in held[dim])
            if n < most and not rest:
                return
            ids, vectors, own = (np.concatenate(x) for x in zip(*held[dim], strict=True))
            end = n if rest else n - n % most
            held[dim] = [(ids[end:], vectors[end:], own[end:])]
            for at in range(0, end, most):
                to = min(end, at + most)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(x[at:to]).tobytes()], pa.binary()) for x in (ids, vectors, own))], ["block", "dim", "ids", "vectors", "marks"])
                block += 1

        for b in batches:
            v = b.column("vector")
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)  # a part that is null is NaN
            ids = b.column("id").to_numpy(zero_copy_only=False)
            own = _marks(b.column("marks"))
            for dim in np.unique(size[size > 0]).tolist():
                at = size == dim
                held.setdefault(dim, []).append((ids[at], flat[np.repeat(at, size)].reshape(-1, dim), own[at]))
                yield from full(dim, False)
        for dim in held:
            yield from full(dim, True)

    return cut(rows.mapInArrow(run, "block long, dim int, ids binary, vectors binary, marks binary"))


def _marks(column: pa.Array) -> np.ndarray:
    """A row of values for each row: of numbers, lists of numbers or bytes."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).reshape(len(column), 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


class _Side:
    """A packed block: ids, vectors in double precision, their norms, marks; usable: rows that can match at all."""

    def __init__(self, b: pa.RecordBatch, row: int, prefix: str, kind: type, mark: type, metric: str):
        get = lambda name: b.column(f"{prefix}{name}")[row]
        self.block, dim = get("block").as_py(), get("dim").as_py()
        ids = np.frombuffer(get("ids").as_buffer(), np.int64)
        x = np.frombuffer(get("vectors").as_buffer(), kind).reshape(-1, dim).astype(np.float64)
        marks = np.frombuffer(get("marks").as_buffer() or b"", mark).reshape(len(ids), -1)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        usable = (norm > 0) & (norm < np.inf) if metric == "cosine" else ~np.isnan(norm)
        self.dim = dim
        self.ids, self.x, self.norm, self.marks = (a if usable.all() else a[usable] for a in (ids, x, norm, marks))


class _Best:
    """The k best of each row so far: the greatest scores, of equal ones the least ids."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.score, self.dst = np.full((n, k), -np.inf), np.full((n, k), self.NONE)

    def add(self, row: np.ndarray, score: np.ndarray, dst: np.ndarray) -> None:
        rows, k = np.unique(row), self.score.shape[1]
        r = np.concatenate([np.repeat(rows, k), row])
        s, d = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.dst[rows].ravel(), dst])
        order = np.lexsort((d, -s, r))
        take = order[np.searchsorted(r[order], rows)[:, None] + np.arange(k)]
        self.score[rows], self.dst[rows] = s[take], d[take]


def _same(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of equal ids."""
    order = np.argsort(dst, kind="stable")
    low, high = (np.searchsorted(dst[order], src, side) for side in ("left", "right"))
    n = high - low
    return np.repeat(np.arange(len(src)), n), order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _scores(a: _Side, b: _Side, row: np.ndarray, column: np.ndarray, metric: str) -> np.ndarray:
    """Of pairs of rows, rounded to 6 digits."""
    out = np.empty(len(row))
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, len(row), PAIRS):
            i, j = row[at : at + PAIRS], column[at : at + PAIRS]
            if metric == "euclidean":
                d = a.x[i] - b.x[j]
                out[at : at + PAIRS] = 1 / (1 + np.sqrt(np.einsum("ij,ij->i", d, d)))
            else:
                s = np.einsum("ij,ij->i", a.x[i], b.x[j])
                out[at : at + PAIRS] = s / (a.norm[i] * b.norm[j]) if metric == "cosine" else s
        return np.round(out, 6)


def _tile(a: _Side, b: _Side, rows: np.ndarray, columns: slice, best: _Best, metric: str, least: float, same: tuple[np.ndarray, np.ndarray] | None, met: np.ndarray | None) -> None:
    """Some rows against some columns. One matrix product gives a number that follows the score; pairs whose number may be among the
    k best, with room for rounding, are scored exactly."""
    k = best.score.shape[1]
    x, y, norm = a.x[rows], b.x[columns], a.norm[rows]
    far = b.norm[columns].max(initial=0)
    if metric == "cosine":
        key = (x / norm[:, None]) @ (y / b.norm[columns][:, None]).T
    elif metric == "dot":
        key = x @ y.T
    else:  # less the square of the query's length, the negative square of the distance
        key = np.hstack([2 * x, np.ones((len(x), 1))]) @ np.hstack([y, -(b.norm[columns] ** 2)[:, None]]).T

    odd = far == np.inf or bool((norm == np.inf).any())
    if met is not None:
        key[~met] = -np.inf
    if same is not None:
        key[same] = -np.inf
    floor, n = np.maximum(best.score[rows, -1], least), key.shape[1]
    open_ = np.flatnonzero(np.isneginf(floor))
    if len(open_) and n >= 16 * k and not odd:
        # Of g groups of columns the k best groups' greatest keys: k columns have the least of these or more.
        g = n // 16
        top = np.partition(key[open_, : 16 * g].reshape(-1, 16, g).max(axis=1), g - k, axis=1)[:, g - k]
        floor[open_] = 1 / (1 + np.sqrt(np.maximum(norm[open_] ** 2 - top, 0))) if metric == "euclidean" else top
    low = floor - 1e-6
    if metric == "euclidean":
        d = 1 / np.maximum(low, 1e-300) - 1
        low = np.where(low > 0, norm * norm - d * d - 1e-13 * (norm + far) ** 2, -np.inf)
    elif metric == "dot":
        low -= 1e-13 * norm * far
    # Where a vector's length is infinite every pair is scored.
    row, column = np.nonzero((key >= low[:, None]) & (key > -np.inf) if not odd else ~np.isneginf(key))
    if len(row):
        row, column = rows[row], column + columns.start
        s = _scores(a, b, row, column, metric)
        hit = s >= least  # not NaN
        if hit.any():
            best.add(row[hit], s[hit], b.ids[column[hit]])


Piece = tuple[np.ndarray, slice, np.ndarray | None]


def _all(a: _Side, b: _Side) -> Iterator[Piece]:
    """Rows and columns to score, and which pairs of them meet (None: all)."""
    for at in range(0, len(a.ids), SLICE_ROWS):
        rows = np.arange(at, min(len(a.ids), at + SLICE_ROWS))
        for to in range(0, len(b.ids), TILE_ROWS):
            yield rows, slice(to, min(len(b.ids), to + TILE_ROWS)), None


def _search(left: DataFrame, right: DataFrame, k: int, metric: str, exclude_self: bool, kinds: tuple[type, type], marks: tuple[type, type] = (np.uint8, np.uint8), pieces: Callable[[_Side, _Side], Iterator[Piece]] = _all, least: float = -np.inf) -> DataFrame:
    """(src, dst, score, rank): each packed block of the left side meets each of the right one. A task has one part of the right side and
    one block of the left, of which the k best leave once it has met the whole part."""
    names = ("block", "dim", "ids", "vectors", "marks")
    pairs = left.select(*[F.col(x).alias(f"a_{x}") for x in names]).hint("shuffle_replicate_nl").crossJoin(right.select(*[F.col(x).alias(f"b_{x}") for x in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            row, at = np.nonzero(best.dst != best.NONE)
            return pa.RecordBatch.from_arrays([pa.array(a.ids[row]), pa.array(best.dst[row, at]), pa.array(best.score[row, at])], ["src", "dst", "score"])

        a = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                if a is None or a.block != batch.column("a_block")[i].as_py():
                    if a is not None:
                        yield found()
                    a = _Side(batch, i, "a_", kinds[0], marks[0], metric)
                    best = _Best(len(a.ids), k)
                b = _Side(batch, i, "b_", kinds[1], marks[1], metric)
                if a.dim != b.dim or not len(a.ids) or not len(b.ids):
                    continue
                r, c = _same(a.ids, b.ids) if exclude_self else (np.zeros(0, np.int64),) * 2
                for rows, columns, met in pieces(a, b):
                    same = None
                    if len(r):
                        place = np.full(len(a.ids), -1)
                        place[rows] = np.arange(len(rows))
                        here = (place[r] >= 0) & (c >= columns.start) & (c < columns.stop)
                        same = (place[r][here], c[here] - columns.start) if here.any() else None
                    with np.errstate(invalid="ignore", over="ignore"):
                        _tile(a, b, rows, columns, best, metric, least, same, met)
        if a is not None:
            yield found()

    near = pairs.mapInArrow(run, "src long, dst long, score double")
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _kind(rows: DataFrame) -> type:
    return np.float32 if rows.schema["vector"].dataType.elementType.simpleString() == "float" else np.float64


def _parts(queries: DataFrame, items: DataFrame) -> tuple[int, int]:
    """Parts of both sides: blocks of queries, parts of items, enough of both to keep all tasks busy."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(0)) * 8), F.lit(0))).first()
    (nq, bq), (ni, bi) = shape(queries), shape(items)
    right = max(1, -(-ni // PART_ROWS), -(-bi // PART_BYTES))
    left = max(1, -(-nq // BLOCK_ROWS), -(-bq // BLOCK_BYTES), min(-(-4 * tasks // right), -(-nq // SLICE_ROWS)))
    return left, max(right, min(-(-4 * tasks // left), -(-ni // SLICE_ROWS)))


def knn_join(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """(src, dst, score, rank): for every query vector its k best items, exactly. Both sides have (id, vector).

    Both sides are packed into blocks, once; each block of queries meets each part of the items without a shuffle of either. Matrix
    products of SLICE_ROWS by TILE_ROWS rows say which pairs may be among the k best, and these are scored exactly. Nothing is broadcast;
    a task holds a block of queries and a part of the items, whatever the tables' sizes; the time is that of all pairs. Scores are
    rounded to 6 digits, ties go to the least id. Rows with a null vector, another dimension or (cosine) no direction don't match.
    """
    if k < 1:
        return queries.sparkSession.createDataFrame([], "src long, dst long, score double, rank int")
    left, right = _parts(queries, items)
    if queries is items:
        a = _packed(items, max(left, right))
        b = a.coalesce(right)
    else:
        a, b = _packed(queries, left), _packed(items, right)
    return _search(a, b, k, metric, exclude_self, (_kind(queries), _kind(items)))


def planes(tables: int, hashes: int, dim: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).uniform(-1, 1, (tables, hashes, dim))


def lsh_layout(n: int, cosine: float, recall: float) -> tuple[int, int, int]:
    """(hashes, turns, tables) for n vectors: keys of about log2(n) signs, of which a query tries all with up to a quarter turned,
    in as many tables as give a pair of this cosine a chance of recall to meet. One sign agrees with 1 - angle / pi."""
    hashes = max(8, round(np.log2(max(n, 2))))
    turns = hashes // 4
    differ = float(np.arccos(cosine) / np.pi)
    meet = sum(math.comb(hashes, i) * differ**i * (1 - differ) ** (hashes - i) for i in range(turns + 1))
    return hashes, turns, max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - meet))))


def lsh_index(df: DataFrame, dim: int, tables: int = 4, hashes: int = 10, seed: int = 42) -> DataFrame:
    """(id, vector, keys): the signs of seeded projections, one bucket key for each table."""
    p = planes(tables, hashes, dim, seed).reshape(-1, dim)
    powers = 1 << np.arange(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            keys = ((x @ p.T >= 0).reshape(len(x) * tables, hashes) * powers).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * tables, keys.astype(np.int64))], ["id", "vector", "keys"])

    rows = df.select("id", "vector").where(F.size("vector") == dim)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}, keys array<long>")


def lsh_join(queries: DataFrame, index: DataFrame, k: int, threshold: float = 0.0, hashes: int = 10, turns: int = 0) -> DataFrame:
    """(src, dst, score, rank): of the indexed vectors that a query meets in any table, the k most alike by cosine.

    queries is an index of the asking vectors by the same planes. A vector is filed under one key a table; queries ask under
    their key and those with up to turns signs turned: they meet what differs from their key in no more signs. Blocks of both sides
    compare their keys where they meet, so neither the keys that are asked for nor the pairs that meet are rows of a shuffle.
    """
    kind = np.uint32 if hashes <= 32 else np.uint64

    def meet(a: _Side, b: _Side) -> Iterator[Piece]:
        x, y = a.marks.astype(kind), np.ascontiguousarray(b.marks.astype(kind).T)
        for rows, columns, _ in _all(a, b):
            met = np.zeros((len(rows), columns.stop - columns.start), bool)
            for t in range(x.shape[1]):
                met |= np.bitwise_count(x[rows, t][:, None] ^ y[t, columns][None, :]) <= turns
            yield rows, columns, met

    if k < 1:
        return queries.sparkSession.createDataFrame([], "src long, dst long, score double, rank int")
    left, right = _parts(queries, index)
    return _search(_packed(queries, left, "keys"), _packed(index, right, "keys"), k, "cosine", True, (_kind(queries), _kind(index)), (np.int64, np.int64), meet, threshold)


class CellIndex:
    """An index for approximate nearest neighbours: vectors by the nearest of about sqrt(n) centres, a search reads the nearest cells.

    The centres are learned by ROUNDS rounds of k-means on a seeded sample of at most FIT vectors; every vector is indexed. How
    many cells a search reads (ef) is measured at building: the least number with which the sample's own neighbours are found
    with a share of RECALL. Rows are (cell, id, vector); every
    change gives a new index, so a reader keeps its version. Equal distances go to the least id.
    """

    FIT, ROUNDS, RECALL, SEED = 20_000, 8, 0.97, 7

    def __init__(self, rows: DataFrame, centres: np.ndarray, ef: int, metric: str):
        self.rows, self.centres, self.ef, self.metric = rows, centres, ef, metric

    @classmethod
    def build(cls, items: DataFrame, metric: str = "euclidean", k: int = 10) -> CellIndex:
        """Of items (id, vector) of one dimension; those with another are refused by the cast to a matrix."""
        n = items.count()
        every = max(1, n // cls.FIT)
        sample = items.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id"), "id").limit(cls.FIT)
        x = cls._prepared(np.stack(sample.select(F.col("vector").cast("array<double>").alias("v")).toPandas()["v"].to_numpy()), metric) if n else np.zeros((0, 1))
        if not n:
            return cls(items.select(F.lit(0).alias("cell"), "id", F.col("vector").cast("array<double>").alias("vector")), np.zeros((1, 1)), 1, metric)
        rng = np.random.default_rng(cls.SEED)
        centres = x[rng.choice(len(x), min(len(x), max(1, round(n**0.5))), replace=False)].copy()
        for _ in range(cls.ROUNDS):
            own = cls._nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            count = np.bincount(own, minlength=len(centres))
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        index = cls(items.limit(0).select(F.lit(0).alias("cell"), "id", F.col("vector").cast("array<double>").alias("vector")), centres, 1, metric)
        # How near a query's centre must be: the rank of the cells of its true neighbours.
        asks = x[: min(len(x), 400)]
        d = cls._distances(asks, x)
        d[np.arange(len(asks)), np.arange(len(asks))] = np.inf
        near = np.argsort(d, axis=1)[:, : min(k, max(1, len(x) - 1))]
        cell = cls._nearest(x, centres)
        rank = np.argsort(np.argsort(cls._distances(asks, centres), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, cell[near], axis=1).ravel())
        index.ef = int(needed[min(len(needed) - 1, math.ceil(cls.RECALL * len(needed)))]) + 1
        return index.insert(items)

    @staticmethod
    def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
        """By cosine, vectors of length 1: their Euclidean order is that of the cosine."""
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)

    @classmethod
    def _nearest(cls, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """The nearest centre of each row; a slice of rows at a time."""
        return np.concatenate([np.zeros(0, np.int64), *(cls._distances(x[at : at + TILE_ROWS], centres).argmin(axis=1) for at in range(0, len(x), TILE_ROWS))])

    def _mapped(self, rows: DataFrame, of: Callable[[np.ndarray], pa.Array], name: str, kind: str) -> DataFrame:
        """(id, vector, name): what a function gives for each slice of vectors."""
        metric, dim = self.metric, self.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TILE_ROWS):
                    b = batch.slice(at, TILE_ROWS)
                    if pc.any(pc.not_equal(pc.list_value_length(b.column("vector")), dim)).as_py():
                        raise ValueError(f"a vector hasn't the index's dimension {dim}")
                    x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), of(CellIndex._prepared(x, metric))], ["id", "vector", name])

        return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null").mapInArrow(run, f"id long, vector array<double>, {name} {kind}")

    def _cells(self, rows: DataFrame) -> DataFrame:
        """(cell, id, vector): each row in its nearest cell."""
        centres = self.centres
        return self._mapped(rows, lambda x: pa.array(CellIndex._nearest(x, centres).astype(np.int32)), "cell", "int").select("cell", "id", "vector")

    def _asks(self, rows: DataFrame, most: int) -> DataFrame:
        """(id, vector, bits): a bit for each cell, set for the most nearest ones."""
        centres = self.centres

        def bits(x: np.ndarray) -> pa.Array:
            set_ = np.zeros((len(x), len(centres)), bool)
            np.put_along_axis(set_, np.argsort(CellIndex._distances(x, centres), axis=1, kind="stable")[:, :most], True, axis=1)
            return pa.array([r.tobytes() for r in np.packbits(set_, axis=1)], pa.binary())

        return self._mapped(rows, bits, "bits", "binary")

    def insert(self, rows: DataFrame) -> CellIndex:
        """Rows with an id that is there already are an error, as is one that is given twice."""
        ids = rows.groupBy("id").count()
        if not ids.where("count > 1").isEmpty() or not ids.join(self.rows.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("an id is in the index already")
        return CellIndex(self.rows.unionByName(self._cells(rows)), self.centres, self.ef, self.metric)

    def delete(self, ids: DataFrame) -> CellIndex:
        return CellIndex(self.rows.join(ids.select("id"), "id", "left_anti"), self.centres, self.ef, self.metric)

    def contains(self, id_: int) -> bool:
        return not self.rows.where(F.col("id") == id_).isEmpty()

    def stats(self) -> DataFrame:
        """(vectors, cells, largest, ef)."""
        return self.rows.groupBy("cell").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("vectors"), F.count(F.lit(1)).alias("cells"), F.max("count").alias("largest")).withColumn("ef", F.lit(self.ef))

    def search(self, queries: DataFrame, k: int, ef: int | None = None, exclude_self: bool = True) -> DataFrame:
        """(src, dst, score, rank): for each query (id, vector) its k best of the ef nearest cells; scores as in knn_join.

        Items are packed in the order of their cells. A block of queries meets each part of the items; of a cell there are scored those
        queries that ask for it. A cell that is larger than others is cut into several blocks.
        """
        if k < 1 or self.rows.isEmpty():
            return queries.sparkSession.createDataFrame([], "src long, dst long, score double, rank int")

        def asked(a: _Side, b: _Side) -> Iterator[Piece]:
            cell = b.marks[:, 0]
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for start, end in itertools.pairwise(edges):
                c = int(cell[start])
                ask = np.flatnonzero(a.marks[:, c >> 3] >> (7 - (c & 7)) & 1)
                for at in range(0, len(ask), SLICE_ROWS):
                    for to in range(start, end, TILE_ROWS):
                        yield ask[at : at + SLICE_ROWS], slice(to, min(end, to + TILE_ROWS)), None

        asks = self._asks(queries, min(ef or self.ef, len(self.centres)))
        left, right = _parts(queries, self.rows)
        return _search(_packed(asks, left, "bits"), _packed(self.rows, right, "cell"), k, self.metric, exclude_self, (np.float64, np.float64), (np.uint8, np.int32), asked)


class VectorStore:
    """Vectors by id with metadata; every change gives a new store, so a reader keeps its version (begin, rollback: keep the old one)."""

    SCHEMA = "id long, vector array<double>, metadata map<string,string>"

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def store(self, rows: DataFrame) -> VectorStore:
        """Adds rows; those with a known id take its place."""
        return VectorStore(self.rows.join(rows.select("id"), "id", "left_anti").unionByName(rows))

    def delete(self, ids: DataFrame) -> VectorStore:
        return VectorStore(self.rows.join(ids.select("id"), "id", "left_anti"))

    def retrieve(self, id_: int) -> DataFrame:
        return self.rows.where(F.col("id") == id_)

    def list_ids(self) -> DataFrame:
        return self.rows.select("id")

    def count(self) -> int:
        return self.rows.count()

    def exists(self, id_: int) -> bool:
        return not self.retrieve(id_).isEmpty()

    def search(self, query: list[float], k: int, **how: float) -> DataFrame:
        return knn(self.rows, query, k, id_col="id", vector_col="vector", **how)

    def search_all(self, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
        """(src, dst, score, rank): for every query (id, vector) its k best."""
        return knn_join(queries, self.rows.select("id", "vector"), k, metric, exclude_self=False)
