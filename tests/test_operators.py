"""Operators on literal rows: the expectations of the test inputs in FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import geo, text
from quarrystone.functions import json as J
from quarrystone.functions import vector as V
from quarrystone.operators import dml, rag
from quarrystone.operators import relational as R
from quarrystone.operators import vector as S
from quarrystone.operators.dml import ConstraintError, ForeignKey, TableSchema
from quarrystone.operators.graph import Graph


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_filters(spark):
    d = spark.createDataFrame([(1, "apple"), (2, "banana"), (3, "apple"), (4, None)], "a int, b string")
    assert values(d.where(R.predicate("b", "=", "apple")), "a") == [(1,), (3,)]
    assert values(d.where(R.predicate("b", "!=", "apple")), "a") == [(2,)]
    assert values(d.where(R.predicate("b", "<=>", None)), "a") == [(4,)]
    assert values(d.where(R.predicate("a", "between", (2, 3))), "a") == [(2,), (3,)]
    e = spark.createDataFrame([(5, "A", True), (15, "B", False), (20, "A", False), (5, "B", False)], "a int, b string, c boolean")
    assert e.where(((F.col("a") > 10) & (F.col("b") == "A")) | F.col("c")).count() == 2
    with pytest.raises(ValueError):
        R.predicate("a", "~", 1)


@pytest.mark.parametrize(
    ("pattern", "value", "hit"),
    [("h_l%", "hello", True), ("%l_o", "hello", True), ("h%z", "hello", False), ("", "", True), ("%", "", True), ("_", "", False), ("a\\%b", "a%b", True), ("a\\%b", "axb", False), ("a\\_b", "a_b", True), ("héllo", "héllo", True), ("你_世界", "你好世界", True), ("H%", "hello", False)],
)
def test_like(spark, pattern, value, hit):
    d = spark.createDataFrame([(value,)], "v string")
    assert (d.where(R.predicate("v", "like", pattern)).count() == 1) is hit
    assert (d.where(R.predicate("v", "not like", pattern)).count() == 0) is hit


def test_project(spark):
    d = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert R.project(d, [2, 0]).columns == ["c", "a"]
    assert R.project(d, []).columns == ["a", "b", "c"]
    with pytest.raises(IndexError):
        R.project(d, [3])


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, l string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "j int, r string")
    assert values(R.join(a, b, [("k", "j")]), "l", "r") == [("x", "p")]
    assert values(R.join(a, b, [("k", "j")], null_safe=True), "l", "r") == [("x", "p"), ("y", "q")]
    assert R.join(a, b, None).count() == 4


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "u", 10), (2, "u", 5), (3, "v", 7), (4, None, 7)], "id int, k string, t int")
    right = spark.createDataFrame([("u", 6, "a"), ("u", 10, "b"), ("u", 10, "c"), (None, 1, "n")], "k string, rt int, v string")
    got = {r["id"]: r["v"] for r in R.asof_join(left, right, "k", "t", "rt", ["v"]).collect()}
    assert got == {1: "c", 2: None, 3: None, 4: None}


def test_range_join(spark):
    p = spark.createDataFrame([(1.0,), (5.0,), (10.0,), (-3.0,)], "p double")
    r = spark.createDataFrame([("a", 0.0, 5.0), ("b", -10.0, 100.0)], "n string, lo double, hi double")
    assert values(R.range_join(p, r, "p", "lo", "hi", 4.0), "p", "n") == [(-3.0, "b"), (1.0, "a"), (1.0, "b"), (5.0, "b"), (10.0, "b")]


def test_aggregates(spark):
    d = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v int")
    specs = [R.AggSpec("count"), R.AggSpec("count", "v", "n"), R.AggSpec("sum", "v", "s")]
    assert {r["k"]: (r["COUNT(*)"], r["n"], r["s"]) for r in R.aggregate(d, ["k"], specs).collect()} == {"a": (2, 1, 1), None: (1, 1, 3)}
    assert R.aggregate(d.limit(0), [], specs).first()["s"] is None
    assert R.aggregate(d, ["k"], specs, F.col("n") > 1).count() == 0


def test_windows(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 2, 3, 1])], "g int, i int, v int")
    assert [r["w"] for r in R.sliding(d, ["g"], ["i"], 3, "v", "w").orderBy("i").collect()] == [[1, 2, 3], [2, 3, 1]]
    assert [r["s"] for r in R.running(d, ["g"], ["i"], F.sum("v"), "s").orderBy("i").collect()] == [1, 3, 6, 7]
    assert values(R.take_while(d, ["g"], ["i"], F.col("v") < 3), "i") == [(0,), (1,)]
    assert values(R.skip_while(d, ["g"], ["i"], F.col("v") < 3), "i") == [(2,), (3,)]
    assert [r["batch"] for r in R.batches(d, ["g"], ["i"], 3).orderBy("i").collect()] == [0, 0, 0, 1]
    assert R.top_k(d, [F.desc("v"), F.col("i")], 0).count() == 0
    assert values(R.top_k_per_group(d, ["g"], [F.desc("v"), F.col("i")], 2), "i") == [(1,), (2,)]


def test_json(spark):
    assert J.depth_of({"a": 1, "b": 2}) == 2
    assert J.depth_of({"a": {"b": {"c": {"d": [1, 2, 3]}}}}) == 6
    person = {"name": "x", "age": 3, "hobbies": ["a", "b"], "address": {"street": "s", "city": "c"}}
    assert len(J.leaves_of(person)) == 6
    assert [p for p, _ in J.leaves_of({"user": {"name": 1, "contacts": {"email": 2}}, "items": [3, 4]})] == ["user.name", "user.contacts.email", "items[0]", "items[1]"]
    ordered = [None, False, True, -1.5, 0, 42, "hello", [1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 4, 6], {"key": 1}]
    keys = [J.sort_key_of(v) for v in ordered]
    assert keys == sorted(keys)
    assert len(set(keys)) == len(keys)
    d = spark.createDataFrame([('{"a": [1, {"b": null}]}',), (None,), ("[]",)], "j string")
    rows = d.select(J.json_depth(F.col("j")).alias("d"), J.json_paths(F.col("j")).alias("p"), J.json_length(F.col("j")).alias("n")).collect()
    assert [r["d"] for r in rows] == [4, None, 1]
    assert rows[0]["p"] == ["a[0]", "a[1].b"]
    assert one(spark, J.json_set(F.lit('{"a":"1"}'), "a", F.lit("2"))) == '{"a":"2"}'
    assert one(spark, J.json_append(F.lit('["x"]'), F.lit("y"))) == '["x","y"]'
    assert one(spark, J.json_is_valid(F.lit("{"))) is False


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.dot(a(1, 2, 3), a(4, 5, 6))) == 32
    assert one(spark, V.dot(a(1, 2), a(1, 2, 3))) is None
    assert one(spark, V.cosine(a(1, 0), a(0, 1))) == 0
    assert one(spark, V.cosine(a(1, 2), a(3, 4))) == pytest.approx(0.98386991, abs=1e-6)
    assert one(spark, V.cosine(a(0, 0), a(1, 1))) is None
    assert one(spark, V.l2(a(0, 0), a(3, 4))) == 5
    assert one(spark, V.similarity(a(0, 0), a(3, 4), "euclidean")) == pytest.approx(1 / 6)
    assert one(spark, V.normalize(a(3, 4))) == [0.6, 0.8]
    assert one(spark, V.normalize(a(0, 0))) is None
    assert one(spark, V.is_finite(a(1, float("nan")))) is False
    for bad in ([], [float("inf")]):
        with pytest.raises(ValueError):
            V.create(bad)


def test_nearest(spark):
    d = spark.createDataFrame([(1, [0.12, 0.12]), (2, [0.12, 0.12]), (3, [0.5, 0.5]), (4, [0.17, 0.17]), (5, None), (6, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r["id"] for r in S.knn(d, [1.0, 0.0], 2, "dot").orderBy("rank").collect()] == [3, 4]
    assert S.knn(d, [1.0, 0.0], 0).count() == 0
    assert S.knn(d, [1.0, 0.0], 10).count() == 4
    v = d.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    got = {(r["src"], r["dst"]) for r in S.knn_join(v, v, 1).collect()}
    assert got == {(1, 2), (2, 1), (3, 1), (4, 1)}
    assert S.knn_join(v.limit(0), v, 3).count() == 0


def test_vector_store(spark):
    rows = spark.createDataFrame([(1, [1.0], {"a": "b"}), (2, [2.0], None)], S.VectorStore.SCHEMA)
    s = S.VectorStore(rows)
    t = s.store(spark.createDataFrame([(2, [9.0], None), (3, [3.0], None)], S.VectorStore.SCHEMA)).delete(spark.createDataFrame([(1,)], "id long"))
    assert (s.count(), t.count(), t.exists(1), t.retrieve(2).first()["vector"]) == (2, 2, False, [9.0])


def test_geometry(spark):
    r = geo.Rect(*(F.lit(float(x)) for x in (0, 0, 4, 2)))
    s = geo.Rect(*(F.lit(float(x)) for x in (3, 1, 6, 5)))
    far = geo.Rect(*(F.lit(float(x)) for x in (7, 6, 8, 8)))
    assert [one(spark, c) for c in (r.area(), r.perimeter(), r.overlap_area(s), r.enlargement(s), r.distance(far), r.intersects(far))] == [8, 12, 1, 22, 5, False]
    assert one(spark, r.contains_point(F.lit(4.0), F.lit(0.0))) is True
    assert one(spark, geo.distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))) == 5


def test_text(spark):
    assert one(spark, text.tokenize(F.lit("The cat-sat on é été 42 x"))) == ["the", "cat", "sat", "été"]
    assert one(spark, text.snippet(F.lit("a" * 300 + "needle" + "b" * 300), "needle")).startswith("...")
    assert one(spark, text.loosely_equal(F.lit("1.0"), F.lit(1))) is True


@pytest.fixture(scope="module")
def small(spark):
    def make(pairs, n):
        nodes = spark.createDataFrame([(i,) for i in range(1, n + 1)], "id long")
        return Graph(nodes, spark.createDataFrame([(a, b, "r", w) for a, b, w in pairs], "src long, dst long, rel string, weight double"))

    return make


def test_graph(spark, small):
    triangle = small([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], 3)
    assert values(triangle.degree_centrality()) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert values(triangle.clustering()) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    star = small([(1, i, 1.0) for i in range(2, 11)], 10)
    assert dict(values(star.clustering()))[1] == 0.0
    g = small([(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (1, 5, 1.0), (2, 3, 1.0), (3, 4, 1.0)], 5)
    assert dict(values(g.clustering()))[1] == pytest.approx(1 / 3)
    line = small([(1, 2, 1.0), (2, 3, 2.0)], 3)
    assert {r["id"]: r["distance"] for r in line.distances(line.nodes.where("id = 1")).collect()} == {1: 0.0, 2: 1.0, 3: 3.0}
    assert line.shortest_path(1, 3) == [1, 2, 3]
    assert line.shortest_path(2, 2) == [2]
    assert values(line.bfs(line.nodes.where("id = 1")), "id", "depth") == [(1, 0), (2, 1), (3, 2)]
    assert values(line.betweenness_centrality()) == [(1, 0.0), (2, 2.0), (3, 0.0)]
    two = small([(1, 2, 1.0), (3, 4, 1.0)], 4)
    assert values(two.components()) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert two.shortest_path(1, 4) == []
    assert not two.is_connected()
    assert triangle.is_connected()
    assert values(g.all_shortest_paths(2, 4), "path") == [([2, 1, 4],), ([2, 3, 4],)]
    assert values(g.neighbors("out"), "id", "neighbors") == [(1, [2, 3, 4, 5]), (2, [3]), (3, [4])]
    assert g.remove_nodes(spark.createDataFrame([(1,)], "id long")).edges.count() == 2
    assert g.add_edges(spark.createDataFrame([(5, 99, "r", 1.0), (5, 4, "r", 1.0)], "src long, dst long, rel string, weight double")).edges.count() == 7


def test_constraints(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    s = TableSchema(d.schema, primary_key="id", unique=("name",), checks=("id > 0",), foreign_keys=(ForeignKey("id", "o", "k"),))
    other = {"o": spark.createDataFrame([(1,), (2,), (3,)], "k long")}
    dml.check(spark.createDataFrame([(3, None)], d.schema), s, d, other)
    for rows in ([(1, "z")], [(None, "z")], [(3, "a")], [(3, "b"), (3, "c")], [(-1, "q")], [(7, "q")]):
        with pytest.raises(ConstraintError):
            dml.check(spark.createDataFrame(rows, d.schema), s, d, other)
    with pytest.raises(ConstraintError):
        dml.conform(spark.createDataFrame([(1,)], "zz int"), s)
    assert values(dml.update_df(d, {"name": F.lit("x")}, F.col("name") == "a")) == [(1, "x"), (2, None)]
    assert values(dml.delete_df(d, F.col("name") == "a"), "id") == [(2,)]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "apple banana cherry"), (2, "banana cherry date"), (3, "cherry date elderberry"), (4, None), (5, "")], "id long, t string")
    w = rag.tfidf(docs, "id", "t")
    norm = w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1, abs=0.01) for r in norm)
    assert rag.HybridConfig(0.7).graph_weight == pytest.approx(0.3)
    assert rag.HybridConfig(7).vector_weight == 1.0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    rows = {r["dst"]: r["hybrid_score"] for r in rag.hybrid_query(v, v, v.where("id = 1"), rag.HybridConfig(0.5, 20, 3, 0.5)).collect()}
    assert rows == {1: pytest.approx(1.0), 2: pytest.approx(0.25)}
