"""Packing and mixing against their definitions by brute force."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm import mixing, packing, queries
from quarrystone.llm.common import TOKENIZER, count_tokens


def check_packs(rows, capacity):
    packs = defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            packs[r["pack_id"]].append((r["slot"], r["pack_offset"], r["n_tokens"]))
        else:
            assert (r["pack_id"], r["slot"], r["pack_offset"]) == (None, None, None)
    for p in packs.values():
        p.sort()
        assert [s for s, _, _ in p] == list(range(len(p)))
        assert [o for _, o, _ in p] == list(itertools.accumulate([0] + [n for _, _, n in p[:-1]]))
        assert sum(n for _, _, n in p) <= capacity
    assert sorted(packs) == list(range(len(packs)))
    return packs


def brute(lengths, capacity):
    """Shortest-pack-first on single documents, longest first: the fill of every pack."""
    packs = []
    for n in sorted(lengths, reverse=True):
        least = min(packs, default=capacity + 1)
        if least + n <= capacity:
            packs.remove(least)
            packs.append(least + n)
        else:
            packs.append(n)
    return sorted(packs)


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=100, deadline=None)
def test_patterns_equal_single_documents(lengths):
    patterns = packing.pack_histogram(Counter(lengths), 40)
    assert sorted(itertools.chain(*[[sum(p)] * n for p, n in patterns])) == brute(lengths, 40)
    assert Counter(itertools.chain(*[list(p) * n for p, n in patterns])) == Counter(lengths)


@pytest.mark.parametrize(("rank_rows", "search_rows"), [(1_000_000, 2_000_000), (2, 0)])
def test_packing_of_odd_rows(odd, rank_rows, search_rows):
    rows = packing.pack_documents(odd, 64, rank_rows=rank_rows, search_rows=search_rows).collect()
    check_packs(rows, 64)
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    want = defaultdict(int)
    for r in odd.collect():
        want[r["doc_id"]] += count_tokens([r["text"]], TOKENIZER)[0]
    assert got == want


def test_packing_query(spark, sf):
    rows = queries.QUERIES["op1_packing"](spark, sf).collect()
    packs = check_packs(rows, packing.CAPACITY)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    lengths = []
    for n in count_tokens([d["text"] for d in docs], TOKENIZER):
        lengths += [packing.CAPACITY] * (n // packing.CAPACITY) + ([n % packing.CAPACITY] if n % packing.CAPACITY else [])
    assert sorted(sum(n for _, _, n in p) for p in packs.values()) == brute(lengths, packing.CAPACITY)


def test_ranks_do_not_depend_on_the_ranges(spark):
    """The same documents share packs however many ranges a frequent length is cut into."""
    d = spark.range(300).selectExpr("id as doc_id", "repeat('word ', cast(1 + id % 3 as int)) as text")
    got = [sorted(map(tuple, packing.pack_documents(d.repartition(k), 16, rank_rows=r).collect())) for k, r in ((1, 1_000_000), (4, 7), (2, 50))]
    assert got[0] == got[1] == got[2]


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 200))
@settings(max_examples=150, deadline=None)
def test_budget_is_filled_as_well_as_possible_after_the_shares(pairs, budget):
    lengths, counts = (np.array(x) for x in zip(*pairs, strict=True))
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    used = int((take * lengths).sum())
    total = int((lengths * counts).sum())
    if budget >= total:
        assert used == total
        return
    assert used <= budget
    base = (counts * (budget / total)).astype(int) if budget else np.zeros_like(counts)
    best = max(s for s in (sum(int(l) * k for l, k in zip(lengths, c, strict=True)) for c in itertools.product(*[range(int(b), int(n) + 1) for b, n in zip(base, counts, strict=True)])) if s <= budget)
    assert used == best


def test_every_length_gets_its_share():
    """Lengths that occur once, of 100 to 20,000 tokens: each tenth of them, short to long, gives about half of its documents."""
    lengths = np.unique(np.geomspace(100, 20_000, 1000).astype(int))
    counts = np.ones_like(lengths)
    budget = int(lengths.sum()) // 2
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == budget
    assert all(0.35 <= part.mean() <= 0.65 for part in np.array_split(take, 10))


def test_budgets_by_source():
    assert mixing.source_budgets({"a": 100, "b": 1000}, None, 600) == {"a": 100, "b": 500}
    assert mixing.source_budgets({"a": 100, None: 100}, {"a": 3, None: 1}, 100) == {"a": 75, None: 25}
    assert mixing.source_budgets({"a": 100}, {"b": 1}, 50) == {"a": 0}
    assert mixing.source_budgets({}, None, 5) == {}
    assert mixing.source_budgets({"a": 100, "c": 100}, {"b": 1, "a": 3}, 100, 1.0) == {"a": 75, "c": 25}


def test_selection_does_not_depend_on_the_ranges(spark):
    """The least hashes of a frequent length go in, in however many ranges they are ranked."""
    d = spark.range(500).selectExpr("id as doc_id", "concat('word ', id % 7) as text", "if(id % 3 = 0, 'a', null) as source")
    got = [sorted(map(str, mixing.mix_ids(d.repartition(k), rank_rows=r).collect())) for k, r in ((1, 1_000_000), (3, 5), (2, 60))]
    assert got[0] == got[1] == got[2] and got[0]


def test_mixing_of_odd_rows(odd):
    whole = mixing.mix_documents(odd, budget_share=1.0)
    assert whole.columns == odd.columns
    assert whole.count() == sum(1 for r in odd.collect() if r["text"])
    half = mixing.mix_documents(odd, budget_share=0.5).collect()
    tokens = lambda rows: sum(count_tokens([r["text"] for r in rows], TOKENIZER))
    assert 0 < tokens(half) <= 0.5 * tokens(odd.collect())
    assert sorted(map(str, half)) == sorted(map(str, mixing.mix_documents(odd.repartition(5), budget_share=0.5).collect()))
    assert all(r["_row"] == 1 and r["key"] == "k" for r in half)


def test_mixing_of_nothing(empty):
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.mix_ids(empty).count() == 0


def test_mixing_query(spark, sf):
    """Every source gets its share, less than the shortest document left over short of it."""
    rows = queries.QUERIES["op5_mixing"](spark, sf).collect()
    docs = {d["doc_id"]: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = dict(zip(docs, count_tokens([d["text"] for d in docs.values()], TOKENIZER), strict=True))
    have = defaultdict(int)
    for i, d in docs.items():
        have[d["source"]] += n[i]
    budgets = mixing.source_budgets(have, mixing.WEIGHTS, int(sum(have.values()) * mixing.BUDGET_SHARE), mixing.OTHER)
    used = defaultdict(int)
    for r in rows:
        assert r["n_tokens"] == n[r["doc_id"]] and r["source"] == docs[r["doc_id"]]["source"]
        used[r["source"]] += r["n_tokens"]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    left = {i for i in docs} - {r["doc_id"] for r in rows}
    for s, b in budgets.items():
        rest = [n[i] for i in left if docs[i]["source"] == s and n[i]]
        assert used[s] <= b
        assert not rest or b - used[s] < min(rest)
