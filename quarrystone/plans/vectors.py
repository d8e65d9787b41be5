"""Queries of vector search, graphs and retrieval. The graph joins every embedding with its three nearest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.engine import Connection
from quarrystone.functions import vector as V
from quarrystone.operators import rag
from quarrystone.operators import vector as S
from quarrystone.operators.graph import Graph
from quarrystone.plans.registry import query
from quarrystone.sources.shared import cut, shared_path
from quarrystone.sources.tables import load

# Vectors.


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """What searches ask for: every row whose id is divisible by 50, against all rows."""
    return _embeddings(spark, sf).where(F.col("id") % 50 == 0)


_Q = "q AS (SELECT * FROM e WHERE id % 50 = 0)"
_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_COSINE = "round(list_cosine_similarity(a.v, b.v), 6)"


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One mean vector for each label, with ids 1,000,000,000 + label."""
    x = load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = x.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return v.select((F.col("label") + 1_000_000_000).cast("bigint").alias("id"), F.transform("v", lambda p: p.x).alias("vector"))


_CENTROIDS = "c AS (SELECT 1000000000 + label AS id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e) GROUP BY label, i) GROUP BY label)"


def _pairwise(name: str, sql: str, f) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = F.broadcast(_centroids(spark, sf).select(F.col("id").alias("centre"), F.col("vector").alias("w")))  # one row per label
        return _embeddings(spark, sf).crossJoin(c).select("id", "centre", F.round(f(F.col("vector"), F.col("w")), 6).alias("value"))

    run.__name__ = name
    query(f"WITH {_E}, {_CENTROIDS} SELECT a.id, b.id AS centre, round({sql}, 6) AS value FROM e a CROSS JOIN c b")(run)


_pairwise("v1_dot", "list_inner_product(a.v, b.v)", V.dot)
_pairwise("v2_cosine", "list_cosine_similarity(a.v, b.v)", V.cosine)
_pairwise("v3_euclidean", "list_distance(a.v, b.v)", V.l2)
_pairwise("v4_similarity", "1 / (1 + list_distance(a.v, b.v))", lambda a, b: V.similarity(a, b, "euclidean"))


@query(f"WITH {_E} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS unit, true AS finite FROM e")
def v5_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vector")
    return _embeddings(spark, sf).select("id", F.round(V.norm(v), 6).alias("norm"), V.rounded(V.normalize(v), 6).alias("unit"), V.is_finite(v).alias("finite"))


@query(f"WITH {_E} SELECT id, round(list_inner_product(v, list_resize([1.0::DOUBLE, 2.0], 64, 0.0)), 6) AS made, round(list_distance(v, list_resize([0.0::DOUBLE], 64, 0.0)), 6) AS from_zero FROM e")
def v6_factory(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that are made, with those of the table: a product with one, the distance from zero."""
    v = F.col("vector")
    return _embeddings(spark, sf).select("id", F.round(V.dot(v, V.create([1, 2] + [0] * 62)), 6).alias("made"), F.round(V.l2(v, V.zero(64)), 6).alias("from_zero"))


def _near(threshold: str = "-2", k: int = 5, a: str = "e", b: str = "e", where: str = "a.id <> b.id", score: str = _COSINE) -> str:
    return f"(SELECT * FROM (SELECT a.id AS src, b.id AS dst, {score} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {score} DESC, b.id) AS rank FROM {a} a JOIN {b} b ON {where}) WHERE rank <= {k} AND score >= {threshold})"


@query(f"WITH {_E}, {_Q} SELECT * FROM {_near('0.3', 10, a='q')}")
def v7_linear_search(spark: SparkSession, sf: str) -> DataFrame:
    """Up to ten others with a cosine of 0.3 or more."""
    return S.knn_join(_queries(spark, sf), _embeddings(spark, sf), 10).where("score >= 0.3").select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query()
def v8_lsh_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same by hashing, with a cosine of 0.5 or more: approximate, so without SQL. A pair at the threshold is found with a chance of 0.95."""
    e = _embeddings(spark, sf)
    hashes, turns, tables = S.lsh_layout(e.count(), 0.5, 0.95)
    index = S.lsh_index(e, 64, tables, hashes)
    return S.lsh_join(index.where(F.col("id") % 50 == 0), index, 10, 0.5, hashes, turns)


@query(f"WITH {_E}, {_Q}, few AS (SELECT * FROM e WHERE label < 5) SELECT src, dst, score, rank FROM {_near(k=3, a='q', b='few', where='true')}")
def v9_engine(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    store = S.VectorStore(spark.createDataFrame([], S.VectorStore.SCHEMA)).store(rows)
    some = store.rows.where(F.col("metadata")["label"].cast("int") < 5)
    return S.VectorStore(some).search_all(_queries(spark, sf), 3).select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_E}, {_Q} SELECT * FROM {_near(a='q')}")
def v10_knn(spark: SparkSession, sf: str) -> DataFrame:
    return S.knn_join(_queries(spark, sf), _embeddings(spark, sf), 5).select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_E}, {_Q} SELECT * FROM {_near(a='q', score='round(list_inner_product(a.v, b.v), 6)')}")
def v10_knn_dot(spark: SparkSession, sf: str) -> DataFrame:
    return S.knn_join(_queries(spark, sf), _embeddings(spark, sf), 5, "dot").select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query()
def i6_cell_index(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of each query by an index of cells: approximate, so without SQL."""
    index = S.CellIndex.build(_embeddings(spark, sf))
    return index.search(_queries(spark, sf), 10).select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT count(*) FILTER (WHERE vec_id % 7 <> 3) AS vectors FROM embeddings")
def i6_index_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the vectors are inserted after the index was built, and some are deleted."""
    e = _embeddings(spark, sf)
    index = S.CellIndex.build(e.where("id % 2 = 0")).insert(e.where("id % 2 = 1")).delete(e.where("id % 7 = 3"))
    return index.stats().select("vectors")


@query(f"WITH {_E}, {_Q} SELECT * FROM {_near(a='q', score='round(1 / (1 + list_distance(a.v, b.v)), 6)')}")
def v11_knn_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbours by distance, exactly."""
    return S.knn_join(_queries(spark, sf), _embeddings(spark, sf), 5, "euclidean").select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_E}, {_Q} SELECT src, dst, score, rank FROM {_near(k=10, a='q', where='true')}")
def v12_similarity_search(spark: SparkSession, sf: str) -> DataFrame:
    """The command over a table, for every query: its ten most like rows."""
    c = Connection.open_in_memory(spark)
    c.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, vector VECTOR[64])")
    c.catalog.insert("items", _embeddings(spark, sf))
    return c.similarity_join("items", "vector", _queries(spark, sf), 10, "id").select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_E}, {_Q} SELECT src, dst, round(1 / score - 1, 3) AS distance FROM {_near(k=20, a='q', score='round(1 / (1 + list_distance(a.v, b.v)), 6)')}")
def v13_vector_distance(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors of every query, with their distance."""
    near = S.knn_join(_queries(spark, sf), _embeddings(spark, sf), 20, "euclidean")
    return near.select("src", "dst", F.round(1 / F.col("score") - 1, 3).alias("distance"))


@query(f"WITH {_E}, changed AS (SELECT id, CASE WHEN label = 1 THEN list_transform(v, lambda x: -2 * x) ELSE v END AS v FROM e WHERE label <> 0) SELECT id, len(v) AS parts, round(list_sum(v), 6) AS total FROM changed")
def v14_store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert of one label's vectors, deletion of another's."""
    rows = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.create_map().cast("map<string,string>").alias("metadata"), "label")
    store = S.VectorStore(rows.drop("label"))
    store = store.store(rows.where("label = 1").withColumn("vector", F.transform("vector", lambda x: -2 * x)).drop("label")).delete(rows.where("label = 0"))
    return store.rows.select("id", F.size("vector").cast("bigint").alias("parts"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {_E} SELECT id, round(list_sum(v), 6) AS before, CASE WHEN label = 3 THEN NULL ELSE round(list_sum(v), 6) END AS staged FROM e")
def v15_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """A deletion that is rolled back: the staged store lacks a label's vectors, the store of before has all."""
    total = F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6)
    before = S.VectorStore(_embeddings(spark, sf))
    staged = before.delete(load(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("id")))
    return before.rows.select("id", total.alias("before")).join(staged.rows.select("id", total.alias("staged")), "id", "left")


# Graphs.


def _graph(spark: SparkSession, sf: str) -> Graph:
    e = _embeddings(spark, sf)
    label = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = S.knn_join(e, e, 3)
    ends = near.join(label.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("y")), "dst")
    edges = ends.select("src", "dst", F.when(F.col("x") == F.col("y"), "same").otherwise("cross").alias("rel"), F.round(1 - F.col("score"), 6).alias("weight"))
    return Graph(label, cut(edges))


_EDGES = f"{_E}, edges AS (SELECT src, dst, CASE WHEN x.label = y.label THEN 'same' ELSE 'cross' END AS rel, round(1 - score, 6) AS weight FROM {_near(k=3)} n JOIN e x ON x.id = n.src JOIN e y ON y.id = n.dst), links AS (SELECT DISTINCT * FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) WHERE a <> b)"


@query(f"WITH {_EDGES} SELECT count(DISTINCT n.id) AS nodes, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM e WHERE label = 0) AND dst NOT IN (SELECT id FROM e WHERE label = 0)) AS edges FROM e n WHERE label <> 0")
def g1_remove_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Removing a label's nodes takes their edges along."""
    g = _graph(spark, sf)
    g = g.remove_nodes(g.nodes.where("label = 0"))
    return g.nodes.agg(F.count_distinct("id").alias("nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges")))


for _direction, _sql in (("both", "links"), ("out", "(SELECT src AS a, dst AS b FROM edges)"), ("in", "(SELECT dst AS a, src AS b FROM edges)")):

    def _neighbors(spark: SparkSession, sf: str, direction: str = _direction) -> DataFrame:
        return _graph(spark, sf).neighbors(direction)

    _neighbors.__name__ = f"g2_neighbors_{_direction}"
    query(f"WITH {_EDGES} SELECT a AS id, list_sort(list(DISTINCT b)) AS neighbors FROM {_sql} GROUP BY a")(_neighbors)


@query("SELECT vec_id AS id FROM embeddings WHERE label = 3 ORDER BY id")
def g3_find_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return Graph(load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), None).find_nodes(F.col("label") == 3)


_WALK = "walk(source, id, depth) AS (SELECT id, id, 0 FROM e UNION SELECT source, b, depth + 1 FROM walk JOIN links ON id = a WHERE depth < {}), tree AS (SELECT source, id, min(depth) AS depth FROM walk GROUP BY source, id)"


@query(f"WITH RECURSIVE {_EDGES}, {_WALK.format(4)} SELECT source, id, depth FROM tree")
def g5_traverse(spark: SparkSession, sf: str) -> DataFrame:
    """Breadth first from every node, four steps deep."""
    g = _graph(spark, sf)
    return g.bfs(g.nodes.select("id"), 4).select("source", "id", "depth")


@query(f"WITH RECURSIVE {_EDGES}, {_WALK.format(3)} SELECT t.source, t.id, t.depth, min(p.id) AS parent FROM tree t LEFT JOIN (SELECT p.source, p.id, p.depth, l.b FROM tree p JOIN links l ON l.a = p.id) p ON p.source = t.source AND p.b = t.id AND p.depth = t.depth - 1 GROUP BY t.source, t.id, t.depth")
def g9_visitor(spark: SparkSession, sf: str) -> DataFrame:
    """Depths and least parents from every node, three steps deep."""
    g = _graph(spark, sf)
    return g.bfs(g.nodes.select("id"), 3)


@query(f"WITH RECURSIVE {_EDGES}, {_WALK.format(6)}, goal AS (SELECT t.source, min(depth) AS found FROM tree t JOIN e ON e.id = t.id WHERE e.label = 7 GROUP BY t.source) SELECT t.source, t.id, t.depth FROM tree t LEFT JOIN goal g ON g.source = t.source WHERE t.depth <= coalesce(g.found, 6)")
def g9_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """A visitor that stops a source's search at the first depth that has a node of a label, six steps deep at most."""
    g = _graph(spark, sf)
    return g.bfs(g.nodes.select("id"), 6, stop=g.nodes.where("label = 7").select("id")).select("source", "id", "depth")


_TREE = "far(id, depth) AS (SELECT min(id), 0 FROM e UNION SELECT b, depth + 1 FROM far JOIN links ON id = a WHERE depth < 24), least AS (SELECT id, min(depth) AS depth FROM far GROUP BY id)"


@query(f"WITH RECURSIVE {_EDGES}, {_TREE}, back(id, depth) AS (SELECT id, depth FROM least WHERE id = (SELECT max(id) FROM e) UNION ALL SELECT p.id, p.depth FROM back JOIN LATERAL (SELECT l.id, l.depth FROM least l JOIN links k ON k.a = l.id WHERE k.b = back.id AND l.depth = back.depth - 1 ORDER BY l.id LIMIT 1) p ON true) SELECT CAST(depth AS INTEGER) AS place, id FROM back")
def g4_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """From the least node to the greatest, as (place, id); of several the one with the least nodes, from the end."""
    g = _graph(spark, sf)
    ends = g.nodes.agg(F.min("id"), F.max("id")).first()
    return spark.createDataFrame(list(enumerate(g.shortest_path(ends[0], ends[1]))), "place int, id long")


@query()
def g5_depth_first(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf)
    return g.dfs(g.nodes.agg(F.min("id")).first()[0])


@query(f"WITH {_EDGES} SELECT rel, count(DISTINCT id) AS n FROM (SELECT rel, unnest([src, dst]) AS id FROM edges) GROUP BY rel")
def g6_count_relationship(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).count_nodes_with_relationship()


@query(f"WITH {_EDGES} SELECT count(*) AS before, count(*) + 1 AS staged, (SELECT count(*) FROM edges) AS edges_before, (SELECT count(*) FROM edges WHERE weight <= 0.6) + 1 AS edges_staged FROM e")
def g7_transaction(spark: SparkSession, sf: str) -> DataFrame:
    """A staged node, its edge and removed edges are seen in the staged graph only; an edge to nowhere isn't taken."""
    g = _graph(spark, sf)
    some = g.nodes.agg(F.min("id")).first()[0]
    staged = g.remove_edges(F.col("weight") > 0.6).add_nodes(spark.createDataFrame([(-1, 0)], "id long, label int")).add_edges(spark.createDataFrame([(-1, some, "new", 1.0), (-1, -2, "new", 1.0)], "src long, dst long, rel string, weight double"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(g.nodes, "before").crossJoin(n(staged.nodes, "staged")).crossJoin(n(g.edges, "edges_before")).crossJoin(n(staged.edges, "edges_staged"))


@query(f"WITH {_EDGES} SELECT src, dst, rel, weight FROM edges")
def g8_persistent(spark: SparkSession, sf: str) -> DataFrame:
    """Edges written and read again."""
    path = shared_path(spark, "graph")
    _graph(spark, sf).edges.write.parquet(path)
    return spark.read.parquet(path)


_REACH = "reach(a, b) AS (SELECT id, id FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"


@query(f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT a AS id, min(b) AS root FROM reach GROUP BY a")
def g10_components(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).components()


@query(f"WITH {_EDGES} SELECT e.id, round(count(b) / ((SELECT count(*) FROM e) - 1), 6) AS value FROM e LEFT JOIN links ON e.id = a GROUP BY e.id")
def g11_degree(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).degree_centrality().select("id", F.round("value", 6).alias("value"))


_ALL = _WALK.format(24)


@query(f"WITH RECURSIVE {_EDGES}, {_ALL} SELECT source AS id, round(coalesce((count(*) - 1) / nullif(sum(depth), 0), 0), 6)::DOUBLE AS value FROM tree GROUP BY source")
def g12_closeness(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).closeness_centrality().select("id", F.round("value", 6).alias("value"))


@query()
def g13_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).betweenness_centrality().select("id", F.round("value", 9).alias("value"))


_RELAX = "both_ways AS (SELECT a, b, min(w) AS w FROM (SELECT src AS a, dst AS b, weight AS w FROM edges UNION ALL SELECT dst, src, weight FROM edges) WHERE a <> b GROUP BY a, b), relax(id, distance, hop) AS (SELECT min(id), 0.0::DOUBLE, 0 FROM e UNION ALL SELECT b, min(distance + w), any_value(hop) + 1 FROM (SELECT id, min(distance) AS distance, any_value(hop) AS hop FROM relax GROUP BY id) JOIN both_ways ON id = a WHERE hop < 24 GROUP BY b), best AS (SELECT id, min(distance) AS distance FROM relax GROUP BY id)"


@query(f"WITH RECURSIVE {_EDGES}, {_RELAX} SELECT (SELECT min(id) FROM e) AS source, id, round(distance, 6) AS distance FROM best")
def g14_dijkstra(spark: SparkSession, sf: str) -> DataFrame:
    """Distances from the least node."""
    g = _graph(spark, sf)
    return g.distances(g.nodes.orderBy("id").limit(1)).select("source", "id", F.round("distance", 6).alias("distance"))


@query(f"WITH RECURSIVE {_EDGES}, {_RELAX} SELECT (SELECT min(id) FROM e) AS source, id, round(distance, 6) AS distance FROM best WHERE id = (SELECT max(id) FROM e)")
def g15_astar(spark: SparkSession, sf: str) -> DataFrame:
    """The distance to one goal. The heuristic is the number of steps that are left, times the least weight: never too much."""
    g = _graph(spark, sf)
    goal = g.nodes.agg(F.max("id")).first()[0]
    least = g.edges.agg(F.min("weight")).first()[0] or 0.0
    steps = g.bfs(g.nodes.where(F.col("id") == goal)).select("id", (F.col("depth") * least).alias("h"))
    return g.a_star(g.nodes.orderBy("id").limit(1), goal, steps).select("source", "id", F.round("distance", 6).alias("distance"))


_LABELS = ", ".join(
    f"l{i} AS (SELECT e.id, coalesce(t.label, p.label) AS label FROM e JOIN l{i - 1} p ON p.id = e.id LEFT JOIN (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, label) AS r FROM links JOIN l{i - 1} ON b = id GROUP BY a, label) t ON t.a = e.id AND t.r = 1)"
    for i in (1, 2, 3)
)


@query(f"WITH {_EDGES}, l0 AS (SELECT id, id AS label FROM e), {_LABELS} SELECT id, label FROM l3")
def g16_label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).label_propagation(3)


_CLUSTER = "cluster AS (SELECT e.id, CASE WHEN count(DISTINCT l.b) >= 2 THEN (SELECT count(*) FROM links x JOIN links y ON x.a = y.a AND x.b < y.b JOIN links z ON z.a = x.b AND z.b = y.b WHERE x.a = e.id) / (count(DISTINCT l.b) * (count(DISTINCT l.b) - 1) / 2) ELSE 0 END AS value FROM e LEFT JOIN links l ON l.a = e.id GROUP BY e.id)"


@query(f"WITH {_EDGES}, {_CLUSTER} SELECT id, round(value, 6)::DOUBLE AS value FROM cluster")
def g17_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).clustering().select("id", F.round("value", 6).alias("value"))


@query(f"WITH {_EDGES}, {_CLUSTER} SELECT round(avg(value), 6) AS value FROM cluster")
def g17_average_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).average_clustering().select(F.round("value", 6).alias("value"))


@query(f"WITH RECURSIVE {_EDGES}, {_ALL} SELECT max(depth) AS diameter FROM tree")
def g18_diameter(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).diameter()


@query(f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT count(DISTINCT root) = 1 AS connected FROM (SELECT a, min(b) AS root FROM reach GROUP BY a)")
def g18_is_connected(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(_graph(spark, sf).is_connected(),)], "connected boolean")


@query(f"WITH RECURSIVE {_EDGES}, l0 AS (SELECT id, id AS label FROM e), {_LABELS} SELECT label AS community, count(*) AS members FROM l3 GROUP BY label")
def g18_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities by label propagation, and their sizes."""
    return _graph(spark, sf).detect_communities(3)


@query(f"WITH RECURSIVE {_EDGES}, {_TREE}, trails(path, id, depth) AS (SELECT [id], id, depth FROM least WHERE depth = 0 UNION ALL SELECT list_append(t.path, l.id), l.id, l.depth FROM trails t JOIN links k ON k.a = t.id JOIN least l ON l.id = k.b AND l.depth = t.depth + 1) SELECT path FROM trails WHERE id = (SELECT max(id) FROM e)")
def g18_all_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of the least number of edges from the least node to the greatest."""
    g = _graph(spark, sf)
    ends = g.nodes.agg(F.min("id"), F.max("id")).first()
    return g.all_shortest_paths(ends[0], ends[1])


@query(f"WITH RECURSIVE {_EDGES}, {_RELAX} SELECT id, round(distance, 6) AS distance FROM best WHERE distance <= 1.5")
def g18_within_distance(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf)
    return g.within(g.nodes.orderBy("id").limit(1), 1.5).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_EDGES}, p1 AS (SELECT src AS first_node, dst AS last, [src, dst] AS path, weight FROM edges WHERE src <> dst), p2 AS (SELECT first_node, e.dst AS last, list_append(path, e.dst) AS path, p1.weight + e.weight AS weight FROM p1 JOIN edges e ON e.src = last WHERE NOT list_contains(path, e.dst)), p3 AS (SELECT first_node, e.dst AS last, list_append(path, e.dst) AS path, p2.weight + e.weight AS weight FROM p2 JOIN edges e ON e.src = last WHERE NOT list_contains(path, e.dst)), p4 AS (SELECT first_node, e.dst AS last, list_append(path, e.dst) AS path, p3.weight + e.weight AS weight FROM p3 JOIN edges e ON e.src = last WHERE NOT list_contains(path, e.dst)), found AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) SELECT path, round(weight, 6) AS weight FROM found WHERE (first_node, last) = (SELECT (src, dst) FROM edges ORDER BY src, dst LIMIT 1) ORDER BY found.weight, path LIMIT 5")
def g18_k_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf)
    e = g.edges.orderBy("src", "dst").first()
    return g.k_shortest_paths(e["src"], e["dst"], 5, 4).select("path", F.round("weight", 6).alias("weight"))


@query(f"WITH {_EDGES} SELECT x.src AS source, y.dst AS id, [x.src, x.dst, y.dst] AS path, round(x.weight + y.weight, 6) AS weight FROM edges x JOIN edges y ON x.dst = y.src WHERE y.dst <> x.src AND x.dst <> x.src AND y.dst <> y.src AND x.rel = 'same' AND y.rel = 'same' UNION ALL SELECT src, dst, [src, dst], round(weight, 6) FROM edges WHERE rel = 'same'")
def g19_weighted_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf)
    return g.paths(g.nodes.select("id"), 2, F.col("rel") == "same").select("source", "id", "path", F.round("weight", 6).alias("weight"))


# Retrieval.

_TERMS = r"terms AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: strlen(w) > 2) AS w FROM documents), counts AS (SELECT doc_id, term, len(any_value(w)) AS size, count(*) AS n FROM (SELECT doc_id, w, unnest(w) AS term FROM terms) GROUP BY doc_id, term)"


@query(rf"WITH {_TERMS}, vocabulary AS (SELECT term, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM counts GROUP BY term ORDER BY count(*) DESC, term LIMIT 512), raw AS (SELECT doc_id, term, n / size * idf AS w FROM counts JOIN vocabulary USING (term)) SELECT doc_id AS id, term, round(w / norm, 6) AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm FROM raw) WHERE norm > 0")
def r1_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return rag.tfidf(load(spark, sf, "documents"), "doc_id", "text").select("id", "term", F.round("weight", 6).alias("weight"))


@query()
def r2_semantic(spark: SparkSession, sf: str) -> DataFrame:
    features = rag.semantic_features(load(spark, sf, "documents").select("doc_id", "text"), "text", 32)
    return features.select("doc_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query(f"WITH {_E}, {_Q} SELECT src, dst, score, rank FROM {_near('0.3', 10, a='q', where='true')}")
def r3_graphrag(spark: SparkSession, sf: str) -> DataFrame:
    return rag.graphrag_query(_embeddings(spark, sf), _queries(spark, sf), 0.3, 10).select("src", "dst", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_E} SELECT id, CASE WHEN label = 2 THEN 1 ELSE 64 END AS parts, round(CASE WHEN label = 2 THEN 1.0 ELSE list_sum(v) END, 6) AS total FROM e UNION ALL SELECT -1, 1, 1.0")
def r4_update_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A document is added and some embeddings are replaced."""
    e = load(spark, sf, "embeddings")
    none = F.create_map().cast("map<string,string>")
    store = S.VectorStore(e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), none.alias("metadata")))
    new = e.where("label = 2").select(F.col("vec_id").alias("id")).union(spark.createDataFrame([(-1,)], "id long"))
    return store.store(new.select("id", F.array(F.lit(1.0)).alias("vector"), none.alias("metadata"))).rows.select("id", F.size("vector").alias("parts"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {_EDGES} SELECT x.src AS source, y.dst AS id, [x.src, x.dst, y.dst] AS path FROM edges x JOIN edges y ON x.dst = y.src WHERE y.dst <> x.src AND x.dst <> x.src AND y.dst <> y.src UNION ALL SELECT src, dst, [src, dst] FROM edges")
def r5_reasoning_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf)
    return g.paths(g.nodes.select("id"), 2).select("source", "id", "path")


_HYBRID = """WITH {e}, {q}, near AS (SELECT src, dst, 1 / rank AS vector_score FROM {near}{only}), graph AS (SELECT src, dst, score AS graph_score FROM {graph}),
mixed AS (SELECT coalesce(n.src, g.src) AS src, coalesce(n.dst, g.dst) AS dst, {v} * coalesce(vector_score, 0) + {g} * coalesce(graph_score, 0) AS hybrid_score, vector_score, graph_score FROM near n FULL JOIN graph g ON n.src = g.src AND n.dst = g.dst)
SELECT src, dst, round(hybrid_score, 8) AS hybrid_score, round(vector_score, 6) AS vector_score, graph_score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY hybrid_score DESC, dst) AS r FROM mixed) WHERE r <= {n}"""
_PARTS = {"e": _E, "q": _Q, "near": _near(k=20, a="q", where="true"), "graph": _near("0.3", 3, a="q", where="true"), "v": 0.5, "g": 0.5, "n": 20}
_SETTINGS = rag.HybridConfig(similarity_threshold=0.3)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", F.round("hybrid_score", 8).alias("hybrid_score"), F.round("vector_score", 6).alias("vector_score"), "graph_score")


@query(_HYBRID.format(only="", **_PARTS))
def r6_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and graph relevance are weighted alike."""
    e = _embeddings(spark, sf)
    return _rounded(rag.hybrid_query(e, e, _queries(spark, sf), _SETTINGS))


for _name, _preset in rag.PRESETS.items():
    _own = _PARTS | {"near": _near(k=_preset.max_vector_results, a="q", where="true"), "graph": _near(str(_preset.similarity_threshold), _preset.max_graph_results, a="q", where="true"), "v": _preset.vector_weight, "g": _preset.graph_weight, "n": _preset.max_vector_results}

    def _with_preset(spark: SparkSession, sf: str, preset: rag.HybridConfig = _preset) -> DataFrame:
        e = _embeddings(spark, sf)
        return _rounded(rag.hybrid_query(e, e, _queries(spark, sf), preset))

    _with_preset.__name__ = f"r9_preset_{_name}"
    query(_HYBRID.format(only="", **_own))(_with_preset)


@query(_HYBRID.format(only=" WHERE dst IN (SELECT id FROM e WHERE label < 5)", **_PARTS))
def r7_hybrid_entities(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    entities = load(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("id"))
    return _rounded(rag.hybrid_query(e, e, _queries(spark, sf), _SETTINGS, entities))


@query("SELECT event_id, round(value * (1 / (1 + 0.1 * length(event_type))) * (1 + least(0.05 * (user_id % 20), 0.5)), 9) AS score FROM events")
def r8_graph_score(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.round(rag.graph_score(F.col("value"), F.length("event_type"), F.col("user_id") % 20), 9).alias("score"))


@query(rf"WITH {_TERMS}, hit AS (SELECT doc_id, term, n / size AS tf FROM counts WHERE term IN ('license', 'attion', 'erineer')), idf AS (SELECT term, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM hit GROUP BY term) SELECT doc_id AS id, round(sum(tf * idf), 6) AS score FROM hit JOIN idf USING (term) GROUP BY doc_id HAVING sum(tf * idf) > 0")
def x10_full_text(spark: SparkSession, sf: str) -> DataFrame:
    return rag.relevance(load(spark, sf, "documents"), "doc_id", "text", ["license", "attion", "erineer"]).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_E}, {_Q}, s AS (SELECT src, dst, score FROM {_near(k=20, a='q', where='true')}), hit AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'rights')) SELECT src, dst, round(score * 0.7 + CASE WHEN doc_id IS NULL THEN 0 ELSE 0.3 END, 8) AS score FROM s LEFT JOIN hit ON doc_id = dst")
def r10_keyword_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 rows most like each query, with a bonus for those whose document has a keyword."""
    semantic = S.knn_join(_queries(spark, sf), _embeddings(spark, sf), 20, exclude_self=False)
    return rag.keyword_bonus(load(spark, sf, "documents"), "doc_id", "text", ["license", "rights"], semantic, 0.3).select("src", "dst", F.round("score", 8).alias("score"))


@query(f"WITH {_E}, {_Q} SELECT n.src, n.dst, n.score FROM {_near(k=5, a='q')} n JOIN e ON e.id = n.dst WHERE e.label = 4 AND n.score >= 0.1")
def r11_filtered_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of scores, filtered by the node's kind and by similarity."""
    kind = load(spark, sf, "embeddings").where("label = 4").select(F.col("vec_id").alias("dst"))
    return S.knn_join(_queries(spark, sf), _embeddings(spark, sf), 5).where("score >= 0.1").join(kind, "dst", "left_semi").select("src", "dst", "score")


@query(f"WITH {_E}, {_Q} SELECT src, dst, score FROM {_near('0.35', 2, a='q')} UNION ALL SELECT src, dst, score FROM {_near('0.2', 1, a='q')}")
def u2_chained_scores(spark: SparkSession, sf: str) -> DataFrame:
    near = S.knn_join(_queries(spark, sf), _embeddings(spark, sf), 2)
    return near.where("score >= 0.35").select("src", "dst", "score").unionByName(near.where("rank = 1 and score >= 0.2").select("src", "dst", "score"))
