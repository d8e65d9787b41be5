"""What larger tables show: signs of zero, searches in blocks, all-pairs algorithms, joins by a key of few values."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import relational as R
from quarrystone.operators import vector as S
from quarrystone.operators.graph import Graph, _Adjacency
from quarrystone.plans import ORACLES, QUERIES
from tests.oracle import connect


def test_normalize_keeps_the_sign_of_zero(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, -2e-7, 2e-7, 0.0], 0), (1, [0.6, -0.8, -1e-9, -6e-7], 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/part")
    next(tmp_path.glob("part/*.parquet")).rename(tmp_path / "embeddings.parquet")
    got = {r["id"]: r["unit"] for r in QUERIES["v5_normalize"](spark, str(tmp_path)).collect()}
    want = {r[0]: r[2] for r in connect(str(tmp_path)).execute(ORACLES["v5_normalize"]).fetchall()}
    assert got == want
    assert {k: [math.copysign(1, x) for x in v] for k, v in got.items()} == {k: [math.copysign(1, x) for x in v] for k, v in want.items()}


def _key(r):
    return r["src"], r["dst"], r["score"], r["rank"]


def _brute(asks, items, k, metric, least=-2.0):
    """By definition: rounded scores, ties to the least id."""
    rows = []
    for q, a in asks:
        scored = []
        for i, b in items:
            if i == q or b is None or a is None or len(a) != len(b):
                continue
            x, y = np.array(a), np.array(b)
            if metric == "euclidean":
                s = 1 / (1 + np.sqrt(((x - y) ** 2).sum()))
            else:
                n = np.sqrt(x @ x) * np.sqrt(y @ y)
                s = x @ y if metric == "dot" else x @ y / n if n else math.nan
            if not math.isnan(s) and round(s, 6) >= least:
                scored.append((-round(float(s), 6), i))
        rows += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return rows


def _odd_vectors():
    rng = np.random.default_rng(11)
    x = np.round(rng.standard_normal((260, 6)), 1)
    x[40:80] = x[:40]  # copies: ties
    x[90] = 0  # no direction
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[100] = (100, None)
    rows[101] = (101, [1.0, 2.0, 3.0])
    rows[102] = (102, [0.5, 2.0, 3.5])
    rows[103] = (103, [])
    rows[104] = (104, [math.nan] * 6)
    rows[105] = (105, (x[3] * 1e-9).tolist())
    return rows


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_blocks_find_what_all_pairs_find(spark, monkeypatch, metric):
    """Many small blocks, odd vectors and ties, a table with itself and two tables."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 48)
    monkeypatch.setattr(S, "PART_ROWS", 96)
    rows = _odd_vectors()
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    same = lambda got, want: sorted((a, b, pytest.approx(s, abs=2e-6), r) for a, b, s, r in want) == sorted(map(_key, got.collect()))
    assert same(S.knn_join(df, df, 2, metric), _brute(rows, rows, 2, metric))
    few = df.where("id % 9 = 0")
    assert same(S.knn_join(few, df, 4, metric), _brute([r for r in rows if r[0] % 9 == 0], rows, 4, metric))
    assert S.knn_join(df, df, 0, metric).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_tiles_keep_the_best(monkeypatch, metric):
    """Tiles that know what was found before leave out nothing, among ties and vectors without an end too."""
    monkeypatch.setattr(S, "TILE_ROWS", 300)
    monkeypatch.setattr(S, "PAIRS", 50)
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((1700, 5)), 1) + 3
    x[200:400] = x[:200]
    for odd in (False, True):
        if odd:
            x[700, 2], x[20, 1] = math.inf, 1e200
        batch = pa.RecordBatch.from_pydict({f"a_{k}": [v] for k, v in {"block": 0, "dim": 5, "ids": np.arange(1700).tobytes(), "vectors": x.tobytes(), "marks": b""}.items()})
        a = S._Side(batch, 0, "a_", np.float64, np.uint8, metric)
        best = S._Best(len(a.ids), 6)
        with np.errstate(all="ignore"):
            for rows, columns, met in S._all(a, a):
                S._tile(a, a, rows, columns, best, metric, -np.inf, None, met)
            for i in (0, 17, 20, 999):
                row = np.flatnonzero(a.ids == i)
                if len(row):
                    s = S._scores(a, a, np.full(len(a.ids), row[0]), np.arange(len(a.ids)), metric)
                    want = np.lexsort((a.ids, -s))[:6]
                    assert best.dst[row[0]].tolist() == a.ids[want].tolist()


def test_search_shuffles_no_copies_of_a_table(spark, tmp_path, monkeypatch):
    """Each side of a search is kept once, whatever the number of blocks that meet."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 64)
    monkeypatch.setattr(S, "PART_ROWS", 128)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1000, 32)))], "id long, vector array<double>")
    plan = S.knn_join(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroups" not in plan
    hashes, turns, tables = S.lsh_layout(1000, 0.5, 0.95)
    index = S.lsh_index(df, 32, tables, hashes)
    plan = S.lsh_join(index.where("id % 50 = 0"), index, 3, 0.5, hashes, turns)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "SortMergeJoin" not in plan


def test_hashed_search_is_that_of_its_tables(spark):
    """Pairs that meet in a table, and no others."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    index = S.lsh_index(df, 8, 3, 9)
    keys = {r["id"]: r["keys"] for r in index.collect()}
    got = {(r["src"], r["dst"]) for r in S.lsh_join(index.where("id < 30"), index, 300, -1.0, 9, 1).collect()}
    assert got == {(i, j) for i in range(30) for j in range(300) if i != j and any((a ^ b).bit_count() <= 1 for a, b in zip(keys[i], keys[j], strict=True))}


def test_cell_index_scores_the_cells_that_are_asked_for(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    index = S.CellIndex.build(df)
    cell = {r["id"]: r["cell"] for r in index.rows.collect()}
    near = np.argsort(((x[:40, None] - index.centres[None]) ** 2).sum(2), axis=1)[:, :3]
    got = {(r["src"], r["dst"]) for r in index.search(df.where("id < 40"), 400, ef=3).collect()}
    assert got == {(i, j) for i in range(40) for j in range(400) if i != j and cell[j] in near[i]}
    with pytest.raises(Exception, match="dimension"):
        index.search(spark.createDataFrame([(1, [1.0] * 7), (2, [1.0] * 9)], "id long, vector array<double>"), 3).count()


def _depths(near, source):
    depth, queue = {source: 0}, [source]
    for x in queue:
        for y in near.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    return depth


@pytest.fixture(scope="module")
def mixed(spark):
    """A hub of 90 neighbours, random links, a path of its own, a node alone; loops and links given twice."""
    rng = np.random.default_rng(6)
    pairs = [(1000, i) for i in range(90)] + [tuple(p) for p in rng.integers(0, 200, (260, 2)).tolist()] + [(300 + i, 301 + i) for i in range(30)] + [(5, 5), (1000, 3), (3, 1000)]
    nodes = sorted({x for p in pairs for x in p} | set(range(200)) | {2000})
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    graph = Graph(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame([(a, b, "r", 1.0) for a, b in pairs], "src long, dst long, rel string, weight double"))
    return graph, near, nodes


@pytest.mark.parametrize("most", [None, 0])
def test_closeness_and_diameter(mixed, monkeypatch, most):
    """By bits without a row for each pair of nodes; by joins where the links are too many."""
    graph, near, nodes = mixed
    if most is None:
        monkeypatch.setattr(Graph, "bfs", lambda *_, **__: pytest.fail("rows of node pairs"))
    else:
        monkeypatch.setattr("quarrystone.operators.graph.ADJACENCY_LINKS", most)
    depths = {i: _depths(near, i) for i in nodes}
    got = {r["id"]: r["value"] for r in graph.closeness_centrality().collect()}
    assert got == pytest.approx({i: (len(d) - 1) / sum(d.values()) if len(d) > 1 else 0.0 for i, d in depths.items()})
    assert [r["diameter"] for r in graph.diameter().collect()] == [30]
    if most is None:
        none = Graph(graph.nodes, graph.edges.limit(0))
        assert {r["value"] for r in none.closeness_centrality().collect()} == {0.0}
        assert none.diameter().first()[0] == 0
        assert Graph(graph.nodes.limit(0), graph.edges.limit(0)).diameter().first()[0] is None


def _brandes(near, nodes):
    score = dict.fromkeys(nodes, 0.0)
    for s in near:
        depth, paths, order = {s: 0}, {s: 1}, [s]
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y], paths[y] = depth[x] + 1, 0
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        delta = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    delta[x] += paths[x] / paths[y] * (1 + delta[y])
            score[y] += delta[y] if y != s else 0
    return score


def test_betweenness_of_a_hub(mixed, monkeypatch):
    """No component is gathered in a row of links for each of several tasks."""
    graph, near, nodes = mixed
    monkeypatch.setattr(Graph, "components", lambda *_: pytest.fail("components aren't needed"))
    n = len(nodes)
    got = {r["id"]: r["value"] for r in graph.betweenness_centrality().collect()}
    assert got == pytest.approx({i: s * 2 / ((n - 1) * (n - 2)) for i, s in _brandes(near, nodes).items()})


def test_shares_of_sources_add_up(mixed, monkeypatch):
    """Whatever the number of tasks and of sources at once, each source is followed once."""
    _, near, _ = mixed
    a, b = np.array([(x, y) for x, ys in near.items() for y in ys]).T
    row = next(_Adjacency.pack(iter([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])])))
    g = _Adjacency({x: row.column(x)[0] for x in ("ids", "start", "near")})
    want = {i: sum(_depths(near, i).values()) for i in near}
    for matrix, part in ((1, 1), (3 * len(near), 100)):
        monkeypatch.setattr("quarrystone.operators.graph.MATRIX", matrix)
        monkeypatch.setattr("quarrystone.operators.graph.PART", part)
        for tasks in (1, 3):
            total = np.zeros(len(near), np.int64)
            for t in range(tasks):
                for depth, new in g.levels(t, tasks):
                    total += depth * np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            assert dict(zip(g.ids.tolist(), total.tolist(), strict=True)) == want


def test_few_keys_join(spark, monkeypatch):
    """Each pair once, nulls match nothing, and no task has a whole value's pairs."""
    monkeypatch.setattr(R, "TASK_PAIRS", 100)
    left = spark.createDataFrame([(i % 3 if i % 10 else None, i) for i in range(120)], "k int, a long")
    right = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(90)] + [(9, 900)], "k int, b long")
    got = R.few_keys_join(left, right, "k")
    assert got.columns == ["k", "a", "b"]
    rows = got.select("k", "a", "b", F.spark_partition_id().alias("p")).collect()
    assert sorted((r["k"], r["a"], r["b"]) for r in rows) == sorted((i % 3, i, j) for i in range(120) for j in range(90) if i % 10 and j % 7 and i % 3 == j % 3)
    assert max(Counter(r["p"] for r in rows).values()) < len(rows) / 8
    assert R.few_keys_join(left.limit(0), right, "k").count() == 0


def test_geo_ranking_is_spread(spark, tmp_path, monkeypatch):
    """One nation's pairs are those of several tasks."""
    monkeypatch.setattr(R, "TASK_PAIRS", 1000)
    spark.createDataFrame([(i, "s", 4, float(i)) for i in range(200)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    parts = QUERIES["q25_geo_ranking"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 200 * 199 and max(r["count"] for r in parts) < 200 * 199 / 4
