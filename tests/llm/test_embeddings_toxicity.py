"""Embedding near-dedup against all pairs; toxicity on held-out labels."""

import os

import numpy as np
import pytest

from quarrystone.llm import itq, queries, toxicity


def vectors(seed=0, n=400, dim=64, copies=150, shift=0.0):
    """Rows of which some are planted at cosine 0.9501 to 0.97 of others, equal rows and multiples; shift: what all have in common."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)) / np.sqrt(dim)
    base[:, 0] += shift
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    source = base[rng.integers(0, n, copies)]
    away = rng.standard_normal(source.shape)
    away -= (away * source).sum(axis=1, keepdims=True) * source
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(itq.COSINE + 1e-4, 0.97, (copies, 1))
    return np.vstack([base, c * source + np.sqrt(1 - c * c) * away, base[:3], base[:3] * 2])


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 1, "x", 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, key string, x int")


def brute(x, cosine=itq.COSINE):
    """Whether two rows are linked, and the class of each: the least row that is connected."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        after = np.where(linked.any(axis=1), np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1)), root)
        if (after == root).all():
            return linked, root
        root = after


@pytest.mark.parametrize("shift", [0.0, 1.0, 1.5])
def test_recall_against_all_pairs(spark, shift):
    """Also where all vectors share a mean, which widens the angles between codes."""
    x = vectors(n=3000, copies=1000, shift=shift)
    linked, root = brute(x)
    got = {r["vec_id"]: r for r in itq.near_duplicates(frame(spark, x)).collect()}
    want = linked.sum(axis=1)
    assert want.sum() > 2000
    assert all(0 < r["links"] <= want[i] for i, r in got.items())
    assert sum(r["links"] for r in got.values()) >= 0.95 * want.sum()
    assert np.mean([got[i]["class_id"] == root[i] if i in got else False for i in np.flatnonzero(want)]) >= 0.95


def test_rows_for_each_vector_do_not_follow_their_number():
    """The layout comes from the geometry of a bounded sample: as many tables for a hundred times the vectors."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((100_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = []
    for n in (1_000, 20_000, 100_000):
        fitted = x[:n][: itq.FIT]
        tables, reach = itq.layout(fitted, *itq.learn(fitted))
        assert sum(len(t) for t in tables) % 64 == 0
        sizes.append((len(tables), reach))
    assert max(t for t, _ in sizes) <= min(t for t, _ in sizes) + 3


def test_every_pair_within_the_turns_is_a_candidate_once(spark):
    """With no cosine limit the result is exactly the pairs of codes that differ by two bits at most in some table, within reach."""
    x = vectors(1, 150, 24, 60)
    unique = spark.createDataFrame([(i, v.tolist(), hash(tuple(v))) for i, v in enumerate(np.unique(x, axis=0))], "x long, v array<double>, h long").coalesce(3)
    rows = sorted(unique.collect(), key=lambda r: (r["h"], r["x"]))
    m = np.array([r["v"] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    mean, p = itq.learn(m)
    assert np.allclose(p.T @ p, np.eye(24), atol=1e-6)
    tables, reach = itq.layout(m, mean, p, -1.0, 0.0)
    signs = {r["x"]: (m[i] - mean) @ p >= 0 for i, r in enumerate(rows)}
    want = {(a, b) for a in signs for b in signs if a < b and (signs[a] != signs[b]).sum() <= reach and any((signs[a] != signs[b])[t].sum() <= itq.TURNS for t in tables)}
    got = [(r["x"], r["y"]) for r in itq.links(unique, 24, cosine=-1.0, target=0.0).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) ^ want) <= 0.01 * len(want)  # a sign at 0 may fall to either side


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, None]), (10, [0.0, 1.0]), (2, [0.0, 1.0]), (11, [0.999, 0.01]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in itq.near_duplicates(df).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (2, 2, 1), (10, 2, 1), (11, 1, 2)]
    assert itq.near_duplicates(df.limit(0)).count() == 0
    assert itq.near_duplicates(df.where("vec_id = 3")).count() == 0
    assert itq.near_duplicates(df.where("vec_id = 1")).count() == 0


def test_ties_of_dimension_go_to_the_larger(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in itq.near_duplicates(df).collect()) == [(3, 3, 1), (4, 3, 1)]


def test_embedding_query(spark, tmp_path):
    """Over the whole table, with near vectors planted since the given small tables have none."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.collect()
    x = np.array([r["embedding"] for r in rows], float)
    more = itq.partners(x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True), 0.955)
    planted = spark.createDataFrame([(10_000 + i, v.tolist(), 0) for i, v in enumerate(more)], "vec_id long, embedding array<double>, label int")
    e.select("vec_id", "embedding", "label").unionByName(planted.selectExpr("vec_id", "cast(embedding as array<float>) embedding", "label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(np.vstack([x, more.astype(np.float32)]))[0].sum(axis=1)
    ids = [*(r["vec_id"] for r in rows), *range(10_000, 10_300)]
    got = {r["vec_id"]: r["links"] for r in queries.QUERIES["op7_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    assert set(got) <= {i for i, k in zip(ids, want, strict=True) if k}
    assert sum(got.values()) >= 0.9 * want.sum() and want.sum() >= 600


@pytest.mark.parametrize(("name", "recall", "wrong"), [("check_s", 0.98, 0.003), ("sf0.1", 0.8, 0.015)])
def test_toxicity_on_held_out_labels(spark, name, recall, wrong):
    """With a thousand confirmed documents nearly all others are found; with two hundred, most."""
    sf = f"/root/testdata/{name}"
    if not os.path.exists(sf):
        pytest.skip(f"no {sf}")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "toxic").collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([scored[r["doc_id"]] for r in held if r["toxic"] == 1]) >= recall
    assert np.mean([scored[r["doc_id"]] for r in held if r["toxic"] == 0]) <= wrong


def softplus(z):
    return np.log1p(np.exp(z))


def own_risk(positive, unlabelled, names, w, bias, prior):
    """Positive part and bracket of the risk, document by document."""
    z = lambda f: bias + sum(w[i] for i, x in enumerate(names) if x in f)
    bracket = np.mean([softplus(z(f)) for f in unlabelled]) - prior * np.mean([softplus(z(f)) for f in positive])
    return prior * np.mean([softplus(-z(f)) for f in positive]), bracket


@pytest.mark.parametrize("shift", [0.0, 3.0, -6.0])
def test_gradient_is_the_numeric_one(shift):
    """Of the whole risk where the bracket is positive; against that of the bracket where it is negative."""
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(6)]
    draw = lambda n, p: [{x for i, x in enumerate(names) if rng.random() < p[i]} for _ in range(n)]
    positive, unlabelled = draw(30, [0.9, 0.5, 0.2, 0.2, 0.1, 0.1]), draw(90, [0.1, 0.3, 0.2, 0.2, 0.1, 0.1])
    prior = 0.45
    w, bias = rng.standard_normal(6) + (shift < 0) * 2.0, shift
    p, u = (toxicity.Csr(toxicity.numbered(x, names)) for x in (positive, unlabelled))
    bracket, g, gb = toxicity.gradient(p, u, w, bias, prior)
    assert bracket == pytest.approx(own_risk(positive, unlabelled, names, w, bias, prior)[1])

    def aim(w, bias):
        rest, bracket_ = own_risk(positive, unlabelled, names, w, bias, prior)
        return rest + bracket_ if bracket >= 0 else -bracket_

    e = 1e-5
    numeric = [(aim(w + e * np.eye(6)[i], bias) - aim(w - e * np.eye(6)[i], bias)) / (2 * e) for i in range(6)]
    assert g == pytest.approx(numeric, abs=1e-7)
    assert gb == pytest.approx((aim(w, bias + e) - aim(w, bias - e)) / (2 * e), abs=1e-7)


def test_both_signs_of_the_bracket_are_met():
    """The correction is needed: with features that only positive documents have, the bracket does turn negative."""
    positive = [{"a", f"x{i}"} for i in range(20)]
    unlabelled = [{"b"} for _ in range(80)]
    names = ["a", *(f"x{i}" for i in range(20))]
    p, u = (toxicity.Csr(toxicity.numbered(x, names)) for x in (positive, unlabelled))
    signs = {toxicity.gradient(p, u, np.full(21, v), -2.0, 0.3)[0] < 0 for v in (0.0, 5.0)}
    assert signs == {False, True}
    w, bias = toxicity.descend(p, u, 21, 0.3)
    # Without it the risk falls without end; with it the bracket stays about 0.
    assert toxicity.gradient(p, u, w, bias, 0.3)[0] > -0.2


def independent(texts, ids, labels):
    """nnPU from single documents, in plain numpy: who is toxic."""
    import regex

    def words(t):
        w = set(regex.findall(r"\p{L}[\p{L}\p{M}'’]+", (t or "").lower()))
        return w | {f"{n}{x[:n]}" for n in (4, 5) for x in w if len(x) > n}

    toxic = {}
    for r in labels:
        if r["doc_id"] is not None and r["toxic"] is not None:
            toxic[r["doc_id"]] = max(r["toxic"], toxic.get(r["doc_id"], 0))
    prior = min(0.5, max(0.01, sum(v == 1 for v in toxic.values()) / len(toxic)))
    sets = [words(t) for t in texts]
    pos = [s for s, i in zip(sets, ids, strict=True) if toxic.get(i) == 1]
    names = []
    common = {x for s in pos for x in s if sum(x in t for t in pos) >= 2}
    for x in sorted(common):
        rate, base = sum(x in s for s in pos) / len(pos), (sum(x in s for s in sets) + 1) / (len(sets) + 1)
        kl = rate * np.log(rate / base) + ((1 - rate) * np.log((1 - rate) / (1 - base)) if rate < 1 else 0)
        if rate > base and prior * rate / base >= 0.7 and np.exp(-len(pos) * kl) * len(common) < 1:
            names.append(x)
    a, b = (np.array([[x in s for x in names] for s in side], float) for side in (pos, sets))
    w, c, h, hc = np.zeros(len(names)), np.log(prior / (1 - prior)), np.full(len(names), 1e-8), 1e-8
    sig = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(300):
        za, zb = a @ w + c, b @ w + c
        bracket = softplus(zb).mean() - prior * softplus(za).mean()
        minus = b.T @ sig(zb) / len(b) - prior * a.T @ sig(za) / len(a), sig(zb).mean() - prior * sig(za).mean()
        plus = -prior * a.T @ sig(-za) / len(a), -prior * sig(-za).mean()
        g, gc = (plus[0] + minus[0], plus[1] + minus[1]) if bracket >= 0 else (-minus[0], -minus[1])
        h, hc = h + g * g, hc + gc * gc
        step = 0.5 / np.sqrt(h)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * 2e-3 * prior, 0)
        c -= 0.5 / np.sqrt(hc) * gc
    return {i for i, s in zip(ids, sets, strict=True) if min(c, 0) + sum(w[k] for k, x in enumerate(names) if x in s) > 0}


def test_toxicity_query_against_an_independent_learner(spark):
    """Every document of the table, learned again from its definition in plain numpy."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"] for r in queries.QUERIES["op8_toxicity"](spark, sf).collect()}
    want = independent([r["text"] for r in docs], [r["doc_id"] for r in docs], labels.collect())
    assert got and len(got ^ want) <= 0.02 * len(want)
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(got & clean) <= 0.01 * len(clean)


def test_patterns_in_tasks_give_the_same_scores(spark):
    """As many patterns as there may be on the driver, or fewer: the same sums."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = [{r["doc_id"]: r["logit"] for r in toxicity.score(docs, labels, max_patterns=m, steps=12).collect()} for m in (200_000, 0)]
    assert got[0] == pytest.approx(got[1], rel=1e-9)


def test_scripts_without_spaces():
    assert toxicity.features("你好世界 hello") == {"2你好", "2好世", "2世界", "hello", "4hell"}
    assert toxicity.features("坏") == {"2坏"}
    positive = [{*toxicity.features(f"今天坏蛋来了{chr(0x4E00 + i)}")} for i in range(60)]
    clean = [{*toxicity.features(f"今天天气好{chr(0x5E00 + i % 90)}{chr(0x6E00 + i)}")} for i in range(600)]
    w, bias = toxicity.fit(positive, clean + positive, 0.1)
    assert bias + sum(w.get(x, 0) for x in toxicity.features("坏蛋来了")) > 0 > bias + sum(w.get(x, 0) for x in toxicity.features("今天天气好"))


def test_toxicity_on_odd_rows(odd, labels, empty):
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count()
    assert not any(r["toxic"] for r in rows if r["doc_id"] in (3, 4, 6))
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.toxic_documents(odd, labels.limit(0)).count() == 0
    assert toxicity.score(odd, labels.limit(0)).count() == odd.count()
