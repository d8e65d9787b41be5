"""Near-duplicates against weighted Jaccard similarity of all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarrystone.llm import minhash as M
from quarrystone.llm import queries


def groups_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def shingle_sets(texts):
    """Counts of runs of words, from strings; a shorter text is one run."""
    out = []
    for t in texts:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        n = min(M.SHINGLE, len(w))
        out.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter())
    return out


def brute(df):
    """Pairs over the threshold, with exact document frequencies, without a hash or a sketch."""
    rows = df.collect()
    sets = shingle_sets([r["text"] for r in rows])
    n = sum(bool(s) for s in sets)
    df_ = Counter(x for s in sets for x in s)
    rare = min(1.0, max(M.RARE, sum(map(len, sets)) / max(n, 1) / M.HEAVY_ROWS))
    weighed = [{x: (1 + np.log(k)) * (1 + min(1.0, np.log(n / df_[x]) / np.log(1 / rare))) for x, k in s.items()} for s in sets]
    total = [sum(w.values()) for w in weighed]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    near = Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    pairs = []
    for a, b in near:
        both = sum(min(w, weighed[b][x]) for x, w in weighed[a].items() if x in weighed[b])
        if (j := both / (total[a] + total[b] - both)) >= M.THRESHOLD:
            pairs.append((rows[a]["doc_id"], rows[b]["doc_id"], j))
    return pairs


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c", "x\n\ny Z!", "é É ß", "one two three four two three four", "!!!"])
def test_shingles(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    n = min(M.SHINGLE, len(w))
    want = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()
    for other in ([], ["zz yy xx"]):
        h, tf = list(M.shingles(pa.array([*other, text, *other])))[len(other)]
        assert len(h) == len(want) and sorted(tf.tolist()) == sorted(want.values())
        assert (np.diff(h.astype(object)) > 0).all()


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(2)
    s = M.Sampler(hashes=4000, seed=1)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = 1 + rng.random(300)
    for keep, scale in ((150, 1.0), (240, 1.0), (300, 1.4)):
        a, b = (h, w), (h[-keep:], w[-keep:] * scale)
        agree = (s.sample(*a) == s.sample(*b)).mean()
        assert agree == pytest.approx(M.similarity(a, b), abs=0.04)


def test_sampling_in_parts_is_the_same(monkeypatch):
    h = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = np.linspace(1, 3, len(h))
    whole = M.Sampler(16).sample(h, w)
    monkeypatch.setattr(M, "PART", 97)
    assert (M.Sampler(16).sample(h, w) == whole).all()


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    pairs = brute(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r["doc_id"]: r["group_id"] for r in queries.QUERIES["op9_minhash"](spark, sf).collect()}
    hit = sum(a in got and got[a] == got.get(b) for a, b, _ in pairs)
    assert hit >= 0.95 * len(pairs)
    want = groups_of((a, b) for a, b, _ in pairs)
    assert set(got) <= set(want)  # no document without a partner
    for d, g in got.items():
        assert want[d] == want[g] and g <= d


def test_large_group_of_near_copies(spark):
    """Copies of one original, each with other edits: found as one group, with few links."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        words = list(base)
        for k in rng.integers(0, 300, 14):
            words[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 100))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in M.near_duplicates(df).collect()}
    assert sum(got.get(i) == 0 for i in range(700)) >= 0.99 * 700
    assert not any(i in got for i in range(1000, 1200))
    kept = {r["doc_id"] for r in M.drop_near_duplicates(df).collect()}
    assert 0 in kept and len(kept & set(range(700))) <= 7 and set(range(1000, 1200)) <= kept


def test_frequencies_are_exact(spark):
    """Every shingle in a share RARE of the documents is known with its frequency, and no other; noise of the sketch doesn't show."""
    rng = np.random.default_rng(9)
    texts = [" ".join(["common start here"] * (i % 2) + ["less common words"] * (i % 500 == 0) + [f"u{x}" for x in rng.integers(0, 10**9, 40)]) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes, idf = M.frequencies(df)
    sets = [h.tolist() for h, _ in M.shingles(pa.array(texts))]
    count = Counter(x for s in sets for x in s)
    want = {h: 1 + min(1.0, np.log(3000 / c) / np.log(1 / M.RARE)) for h, c in count.items() if c >= 3}
    assert dict(zip(hashes.tolist(), idf.tolist(), strict=True)) == pytest.approx(want)
    assert len(want) == 2
    w = M.weights(np.array(sorted(count), np.uint64), np.ones(len(count)), (hashes, idf))
    assert w.max() == 2 and w.min() == pytest.approx(1 + np.log(2) / np.log(1 / M.RARE), abs=1e-3)


def test_weights_do_not_depend_on_the_number_of_documents(spark):
    """A shingle that half of the documents have weighs the same among a thousand and among eight thousand."""
    got = []
    for n in (1000, 8000):
        df = spark.range(n).selectExpr("id as doc_id", "concat(if(id % 2 = 0, 'shared three words ', ''), 'a', id, ' b', id, ' c', id) as text")
        got.append(M.weights(next(M.shingles(pa.array(["shared three words"])))[0], np.ones(1), M.frequencies(df))[0])
    assert got[0] == got[1]


def test_buckets_in_pieces_connect_the_same(spark):
    """A hot bucket of one group, and one of several groups and of loners, searched in pieces of a few members."""
    rng = np.random.default_rng(10)
    base = rng.integers(0, 16, (4, 96)).astype(np.uint8)
    rows = []
    for i in range(260):
        if i < 120:
            s = base[0].copy()
        elif i < 200:
            s = base[1 + i % 3].copy()
        else:
            s = rng.integers(0, 16, 96).astype(np.uint8)
        edit = rng.integers(0, 96, 9)
        s[edit] = rng.integers(0, 16, 9)
        rows.append((i * 7 - 300, [1] if i < 100 else [2, 1000 + i], bytes(s[0::2] << 4 | s[1::2])))
    signed = spark.createDataFrame(rows, "id long, bands array<long>, halves binary").repartition(3)
    whole = groups_of((r["u"], r["v"]) for r in M.candidate_links(signed, 4).collect())
    for piece in (7, 40):
        links = [(r["u"], r["v"]) for r in M.candidate_links(signed, 4, piece).collect()]
        assert groups_of(links) == whole
    assert len(links) < 120 * 119 / 2


def test_chunks_of_a_pivots_partners(spark):
    """As many streams as its partners need, and the same groups."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = [(i, " ".join(f"e{i}x{k}" if rng.random() < 0.03 else w for k, w in enumerate(base))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r["doc_id"], r["group"]) for r in M.groups(df, piece_rows=p, partners=k).collect()) for p, k in ((100_000, 512), (11, 4))]
    assert got[0] == got[1] and len(got[0]) == 60


def test_links_of_a_bucket():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 16, (2, 96)).astype(np.uint8)
    s = np.array([a, a, b, b, a])
    assert {frozenset(x) for x in M.link(np.arange(5), s)} == {frozenset(x) for x in ((0, 1), (0, 4), (2, 3))}


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-50, 50, (70, 2))] + [(i, i + 1) for i in range(100, 160)]
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {r["id"]: r["root"] for r in M.components(df).collect()}
    want = groups_of(p for p in pairs if p[0] != p[1])
    assert {**got, **{r: r for r in got.values()}} == want
    assert M.components(df.limit(0)).count() == 0


def test_odd_rows(odd, empty):
    got = {(r["doc_id"], r["group_id"]) for r in M.near_duplicates(odd).collect()}
    assert got == {(7, 7), (None, None)}
    rows = M.drop_near_duplicates(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["text"]) == sorted([(False, i) for i in (1, 2, 5, 6, 7, 7, 8, 9, 10, 11, 12)] + [(True, 0)])
    assert sum(r["text"] is None for r in rows) == 2 and sum(r["text"] == "" for r in rows) == 1
    assert all((r["_id"], r["band"], r["h"]) == ("z", "b", 4) for r in rows)
    assert M.near_duplicates(empty).count() == 0 == M.drop_near_duplicates(empty).count()
