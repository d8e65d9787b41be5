"""Quality rules and the Kneser-Ney classifier against brute force."""

import math
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

from quarrystone.llm import kneser_ney as K
from quarrystone.llm import quality_rules as Q
from quarrystone.llm import queries, words
from quarrystone.llm.common import spent_shuffles_go, text_bytes


def test_exact_binomial_bound():
    for k, n, delta in ((0, 50, 0.05), (3, 80, 0.01), (10, 30, 0.2)):
        p = Q.upper_bound(k, n, delta)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(delta, rel=1e-6)
    assert Q.upper_bound(0, 0, 0.05) == 1.0 and Q.upper_bound(5, 5, 0.05) == 1.0


def test_bound_holds_in_repeated_trials():
    """The true rate is above the bound in at most a share delta of trials."""
    rng = np.random.default_rng(1)
    wrong = sum(Q.upper_bound(int(rng.binomial(60, 0.1)), 60, 0.1) < 0.1 for _ in range(400))
    assert wrong <= 0.1 * 400 + 3 * math.sqrt(400 * 0.09)


def test_measures():
    texts = ["", "ABC def!", "a a a a", "$$$ %%%", None, "one two\nthree 42"]
    m = Q.measures(*text_bytes(pa.array(texts)))
    get = lambda i, r: m[i, Q.RULES.index(r)]
    assert m[0].tolist() == [0] * len(Q.RULES) == m[4].tolist()
    assert get(1, "upper") == 5000 and get(1, "exclaim") == 5000
    assert get(2, "repeats") == int(10_000 * (1 - 1 / 3))
    assert get(3, "symbols") == 10_000
    assert get(5, "digits") == 10_000 * 2 // 13 and get(5, "lines") == 2500


def _labelled(spark, n=3600):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = ["word" + str(rng.integers(500)) for _ in range(30)]
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "en" if i % 5 else None))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_reject_bad_and_keep_good(spark):
    docs, labels = _labelled(spark)
    judged, force = Q.judge(docs, labels)
    rows = judged.join(labels, "doc_id").collect()
    assert "en" in {r["lang"] for r in force.collect()}
    for lang in ("en", None):
        good = [r["keep"] for r in rows if r["quality"] == 1 and r["lang"] == lang]
        bad = [r["keep"] for r in rows if r["quality"] == 0 and r["lang"] == lang]
        assert np.mean(good) >= 1 - Q.ALPHA
        assert np.mean(bad) == 0


def test_certify_against_definition():
    """Levels are tested in order, at the corrected confidence, on the holdout's good documents only."""
    t = pd.DataFrame([("a", 1, 1, len(Q.GRID), 500), ("a", 1, 1, 3, 40), ("a", 0, 0, 0, 10), ("a", 0, 0, 1, 10), ("a", 0, 0, len(Q.GRID), 5), ("b", 1, 1, len(Q.GRID), 20)], columns=["lang", "half", "quality", "level", "n"])
    assert Q.upper_bound(0, 540, 0.05 / 2) <= Q.ALPHA < Q.upper_bound(40, 540, 0.05 / 2)
    assert Q.certify(t) == {"a": 1}


def _by_definition(docs, labels):
    """Who is kept, from single documents: cutoffs from sorted good documents, levels certified in order."""
    quality, text = {}, {}
    for r in labels:
        quality[r["doc_id"]] = min(r["quality"], quality.get(r["doc_id"], 1))
    for r in docs:
        if r["doc_id"] in quality:
            k = r["lang"], r["text"]
            text[k] = min(quality[r["doc_id"]], text.get(k, (1, 0))[0]), r["half"]
    measured = lambda t: dict(zip(Q.RULES, Q.measures(*text_bytes(pa.array([t])))[0].tolist(), strict=True))
    each = [(lang, q, half, measured(t)) for (lang, t), (q, half) in text.items()]
    languages = {lang for lang, *_ in each}
    force = {}
    for lang in languages:
        own = [x for x in each if x[0] == lang]
        good, bad = ([m for _, q, half, m in own if q == k and half == 0] for k in (1, 0))
        holdout = [m for _, q, half, m in own if q == 1 and half == 1]
        cuts = {}
        for rule in Q.RULES:
            if not good or not bad:
                continue
            values, last, row = sorted(m[rule] for m in good), None, []
            for level in Q.GRID:
                c = min(v for v in values if sum(w > v for w in values) <= level * len(values))
                if sum(m[rule] > c for m in bad) > sum(v > c for v in values) and (last is None or c < last):
                    last = c
                row.append(last)
            cuts[rule] = row
        hit = lambda m, k, cuts=cuts: any(c[k] is not None and m[r] > c[k] for r, c in cuts.items())
        certified = []
        for k in range(len(Q.GRID)):
            lost = sum(hit(m, k) for m in holdout)
            if Q.upper_bound(lost, len(holdout), Q.DELTA / len(languages)) > Q.ALPHA:
                break
            certified.append(sum(hit(m, k) for m in bad))
        if certified:
            least = next(k for k, n in enumerate(certified) if n >= certified[-1] - Q.TOLERANCE * len(bad))
            force[lang] = {r: c[least] for r, c in cuts.items() if c[least] is not None}
    return [r["i"] for r in docs if not any(measured(r["text"])[rule] > c for rule, c in force.get(r["lang"], {}).items())]


@pytest.mark.parametrize("copies", [1, 3])
def test_judge_against_its_definition(spark, copies):
    """Rows that repeat count once in the bound, and rules that are certified do reject."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = []
    for i in range(1600):
        bad = rng.random() < 0.3
        words = [f"word{rng.integers(60)}" for _ in range(12)]
        t = " ".join(w.upper() if bad and rng.random() < 0.5 or rng.random() < 0.01 else w for w in words) + "!" * int(rng.integers(0, 9 if bad else 2))
        rows.append((i, t, ["en", "de", None][i % 20 // 9], int(not bad) if rng.random() < 0.98 else int(bad)))
    again = [(10_000 * k + i, t, lang, q) for k in range(copies) for i, t, lang, q in rows]
    docs = spark.createDataFrame([r[:3] for r in again], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in again], "doc_id long, quality int")
    halves = docs.select("doc_id", "text", "lang", F.col("doc_id").alias("i"), F.pmod(F.xxhash64(F.xxhash64("text"), F.lit(Q.SEED)), F.lit(2)).alias("half")).collect()
    got = sorted(r["doc_id"] for r in Q.keep_by_rules(docs, labels).collect())
    assert got == sorted(_by_definition(halves, labels.collect()))
    assert 0.5 * len(again) < len(got) < 0.95 * len(again)


def test_copies_do_not_certify(spark):
    """Too few documents for the bound stay too few, however often each occurs."""
    docs, labels = _labelled(spark, 240)
    many = docs.crossJoin(spark.range(5)).selectExpr("doc_id + id * 1000 AS doc_id", "text", "lang")
    also = labels.crossJoin(spark.range(5)).selectExpr("doc_id + id * 1000 AS doc_id", "quality")
    judged, force = Q.judge(many, also)
    assert force.count() == 0 and judged.where("not keep").count() == 0


def test_rules_on_odd_rows(odd, labels, empty):
    assert Q.keep_by_rules(odd, labels).count() == odd.count()
    assert Q.keep_by_rules(empty, labels).count() == 0
    assert Q.keep_by_rules(odd, labels.limit(0)).count() == odd.count()


def test_rules_query_keeps_good_documents(spark, sf):
    kept = {r["doc_id"] for r in queries.QUERIES["op6_quality_rules"](spark, sf).collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(good & docs & kept) >= 0.98 * len(good & docs)


WORD = re.compile(rb"[\xe3-\xe9]..|(?:(?![\xe3-\xe9])[0-9A-Za-z_\x80-\xff])+|[^\x00-\x20\x7f]", re.S)


class Brute:
    """Interpolated modified Kneser-Ney over word pairs, words and spellings, from its definition."""

    def __init__(self, texts):
        self.pairs, letters = Counter(), Counter()
        for t in texts:
            w = [None, *WORD.findall(t.encode())]
            self.pairs.update(zip(w, w[1:], strict=False))
            for x in w[1:]:
                b = b"\xff\xff" + x + b"\xfe"
                letters.update(b[i - 2 : i + 1] for i in range(2, len(b)))
        self.ends = Counter(w for _, w in self.pairs)
        self.context = Counter()
        for (u, _), c in self.pairs.items():
            self.context[u] += c
        self.d2, self.d1 = self.discounts(self.pairs), self.discounts(self.ends)
        self.held = Counter()
        for (u, _), c in self.pairs.items():
            self.held[u] += self.d2[min(c, 3) - 1]
        self.total = sum(self.ends.values())
        self.c = {3: letters}
        for n in (2, 1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d = {n: self.discounts(c) for n, c in self.c.items()}

    @staticmethod
    def discounts(c):
        return K.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])

    def letter(self, g):
        n = len(g)
        if n == 0:
            return 1 / 256
        own = {x: v for x, v in self.c[n].items() if x[:-1] == g[:-1]} if n < 3 else None
        if n == 3:
            self.by = getattr(self, "by", None) or defaultdict(dict)
            if not self.by:
                for x, v in self.c[3].items():
                    self.by[x[:-1]][x] = v
            own = self.by.get(g[:-1], {})
        if not own:
            return self.letter(g[1:])
        total, d = sum(own.values()), self.d[n]
        v = own.get(g, 0)
        return ((v - d[min(v, 3) - 1] if v else 0.0) + sum(d[min(x, 3) - 1] for x in own.values()) * self.letter(g[1:])) / total

    def spelling(self, w):
        b = b"\xff\xff" + w + b"\xfe"
        return math.prod(self.letter(b[i - 2 : i + 1]) for i in range(2, len(b)))

    def word(self, w):
        below = sum(self.d1[min(v, 3) - 1] for v in self.ends.values()) / self.total
        v = self.ends[w]
        return (v - self.d1[min(v, 3) - 1] if v else 0.0) / self.total + below * self.spelling(w)

    def after(self, u, w):
        if not self.context[u]:
            return self.word(w)
        v = self.pairs[u, w]
        return ((v - self.d2[min(v, 3) - 1] if v else 0.0) + self.held[u] * self.word(w)) / self.context[u]

    def perplexity(self, t):
        w = [None, *WORD.findall(t.encode())]
        return math.exp(-sum(math.log(self.after(*x)) for x in zip(w, w[1:], strict=False)) / (len(w) - 1))


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.where("length(text) < 2000"), spark.read.parquet(f"{sf}/labels.parquet")


def test_words_against_a_pattern():
    texts = ["", "a", "It's 3.5 o'clock_now!", "\n\n x\ty ", "你好，世界 mixed世界text é-ü", None, "\x00\x7f", "a\u2028b ..."]
    for chosen in (texts, texts[::-1], ["你"], ["x" * 1000, "y z"]):
        data, offsets = text_bytes(pa.array(chosen, pa.string()))
        h, start, length, counts = words.words(data, offsets)
        want = [WORD.findall((t or "").encode()) for t in chosen]
        assert counts.tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert [bytes(data[s : s + n]) for s, n in zip(start, length, strict=True)] == flat
        assert len(set(zip(h.tolist(), flat, strict=True))) == len(set(h.tolist())) == len(set(flat))
        code, first = words.spellings(data, start, length)
        for k, w in enumerate(flat):
            b = b"\xff\xff" + w + b"\xfe"
            assert code[first[k] : first[k] + len(w) + 1].tolist() == [b[i - 2] << 16 | b[i - 1] << 8 | b[i] for i in range(2, len(b))]


def test_packed_numbers():
    rng = np.random.default_rng(3)
    for x in ([], [0], [5, 5, 9], rng.integers(0, 2**44, 1000)):
        x = np.sort(np.array(x, np.int64))
        assert (words.unpack_sorted(words.pack_sorted(x), len(x)) == x).all() and (words.unpack(words.pack(x), len(x)) == x).all()
    assert len(words.pack_sorted(np.sort(rng.integers(0, 2**30, 10_000)))) < 2.9 * 10_000


@pytest.mark.parametrize("shards", [3, 8])
def test_perplexity_against_brute_force(tables, shards):
    docs, labels = tables
    from pyspark.sql import functions as F

    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    rows = docs.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(K.HELD))).collect()
    model = Brute([r["text"] for r in rows if r["doc_id"] in good and r["fold"]])
    assert sum(model.letter(b"th" + bytes([x])) for x in range(256)) == pytest.approx(1)
    assert sum(model.after(b"the", w) - model.held[b"the"] / model.context[b"the"] * model.word(w) for w in model.ends) + model.held[b"the"] / model.context[b"the"] == pytest.approx(1)
    got = {r["doc_id"]: r["perplexity"] for r in K.classify(docs.repartition(3) if shards == 3 else docs, labels, spare=40, shards=shards).collect()}
    few = [r for r in rows if WORD.findall(r["text"].encode())][:25]
    for r in few:
        assert got[r["doc_id"]] == pytest.approx(model.perplexity(r["text"]), rel=1e-6)
    short = {r["doc_id"]: r["perplexity"] for r in K.classify(docs, labels, shards=shards).collect()}
    assert np.mean([abs(math.log(short[i] / got[i])) < 0.02 for i in got if got[i]]) >= 0.95


def test_limits_are_quantiles_of_the_held_out(spark):
    """By language, of held-out documents where there are enough; ties, nulls and languages with one document included."""
    rng = np.random.default_rng(12)
    rows = [(lang, float(rng.integers(5, 9)), float(rng.random()), int(rng.integers(1, 400))) for lang in ["en"] * 300 + ["de"] * 40 + [None] * 20 + ["fr"] for _ in range(2)]
    rows += [("en", None, None, 0), ("it", None, None, 0)]
    held = [r for r in rows if r[0] == "en"][:500] + [("de", 6.0, 0.5, 100)] * 3 + [r for r in rows if r[0] is None]
    schema = "lang string, mean double, deviation double, size long"
    got = {r["lang"]: r["limit"] for r in K.limits(spark.createDataFrame(rows, schema), spark.createDataFrame(held, schema)).collect()}
    measure = lambda t, lang: sorted(m - K.Z * d / math.sqrt(n) for x, m, d, n in t if x == lang and m is not None)
    for lang in ("en", "de", None, "fr"):
        rank = lambda own, q: own[math.ceil(q * len(own)) - 1]
        at = lambda own: rank(own, K.QUANTILE) + K.CAUTION / math.sqrt(len(own)) * (rank(own, K.QUANTILE) - rank(own, 0.5))
        own = measure(held, lang)
        want = at(own) if own else at(measure(rows, lang))
        if 0 < len(own) < K.LEAST_HELD:
            want = max(want, at(sorted(x for y in {r[0] for r in held} for x in measure(held, y))))
        assert got[lang] == pytest.approx(want + K.MARGIN)
    assert set(got) == {"en", "de", None, "fr"}
    assert K.limits(spark.createDataFrame([], schema)).count() == 0


def test_classifier_keeps_good_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in queries.QUERIES["op10_quality_classifier"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.15


def test_answers_must_fit_the_asks(spark, tmp_path):
    """A scan that can't be repeated isn't scored with another block's answers."""
    data = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([1, 2]), pa.array(["en", "en"]), pa.array([1, 2]), pa.array([1, 1]), pa.array(["a b", "c"])], names=["pid", "doc_id", "lang", "key", "fold", "text"])

    class Shared:
        value = None

    with pytest.raises(RuntimeError, match="another order"):
        list(K._score(Shared, f"file://{tmp_path}", {K.PAIRS: 44, K.WORDS: 44})(iter([data])))


def test_held_out_documents_are_kept(spark):
    """Good documents that the model never saw are kept like those that it was trained on."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in K.classify(docs, labels.where("doc_id % 2 = 0")).where("keep").collect()}
    held = [r["doc_id"] in kept for r in labels.where("doc_id % 2 = 1 and quality = 1").collect()]
    assert np.mean(held) >= 0.98


def test_junk_share_does_not_move_the_limit(spark):
    """With as many junk documents as others in every language, none of them labelled, they are rejected all the same."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where("quality = 1")
    junk = docs.join(labels.where("quality = 0"), "doc_id", "left_semi").select("doc_id", "text", "lang")
    clean = docs.join(good, "doc_id", "left_semi").select("doc_id", "text", "lang")
    copies = -(-clean.count() // junk.count())
    many = junk.crossJoin(spark.range(1, copies + 1)).selectExpr("doc_id + id * 1000000000 AS doc_id", "text", "lang")
    kept = {r["doc_id"]: r["keep"] for r in K.classify(clean.unionByName(many), good).collect()}
    assert np.mean([v for d, v in kept.items() if d < 1_000_000_000]) >= 0.99
    assert np.mean([v for d, v in kept.items() if d >= 1_000_000_000]) <= 0.2


def test_classifier_on_odd_rows(odd, labels, empty):
    rows = K.classify(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r["keep"] is False for r in rows if r["perplexity"] is None)
    kept = K.keep_documents(odd, labels)
    assert kept.columns == odd.columns
    assert all((r["_key"], r["key"]) == ("y", "k") and r["text"] for r in kept.collect())
    assert K.classify(empty, labels).count() == 0 == K.keep_documents(empty, labels).count()
    none = K.classify(odd, labels.limit(0)).collect()
    assert all(r["keep"] for r in none if r["doc_id"] in (1, 2, 5)) and not any(r["keep"] for r in none if r["doc_id"] in (3, 4))


def test_repeated_numbers_round_trip():
    rng = np.random.default_rng(5)
    for x in (np.zeros(0, np.int64), np.array([7]), np.zeros(9, np.int64), rng.integers(0, 1 << 44, 1000), rng.integers(0, 50, 1000) << 38):
        assert np.array_equal(words.unpack_repeated(words.pack_repeated(x), len(x)), x)


def _block(n):
    rng = np.random.default_rng(5)
    texts = [" ".join("w" + format(x, "x") for x in rng.zipf(1.3, 600) % 100_000) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])


def test_a_block_is_scored_in_slices():
    """What scoring holds beside the text is a slice of its words and what the block asks for; the slices don't change the results."""
    batch = _block(2000)
    bits = {K.PAIRS: 44, K.WORDS: 44}
    code = np.unique(words.spellings(*(lambda d, o: (d, *words.words(d, o)[1:3]))(*text_bytes(batch.column("text"))))[0])
    parameters = {K.PAIRS: (0.5, 1.0, 1.5), K.WORDS: (0.5, 1.0, 1.5)}, 10_000, 0.1, K.Spelling(code, np.ones(len(code), np.int64))

    def score(batch):
        block = K.Block([batch], bits)
        told = {k: [1 + block.asks[k] % m for m in own] for k, own in {K.PAIRS: (3,), K.WORDS: (50, 3, 5, 7, 9)}.items()}
        return list(K.log_probabilities(block, told, parameters))

    score(batch.slice(0, 2))
    tracemalloc.start()
    try:
        got = score(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    n = int(sum(c.sum() for c, _ in got))
    assert n > 1_000_000 and len(got) > 1
    assert peak - 8 * n < 45 * n  # bytes a word beside the results, which this test alone keeps
    some = score(batch.slice(700, 3))
    start = int(np.concatenate([c for c, _ in got])[:700].sum())
    assert np.concatenate([x for _, x in got])[start : start + sum(len(x) for _, x in some)] == pytest.approx(np.concatenate([x for _, x in some]))


def _shuffled(spark):
    """Bytes of shuffle files, by path."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f): f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data") if f.exists()}


def test_spent_shuffle_files_go(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), _shuffled(spark)
    with spent_shuffles_go(spark):
        spark.range(300_000).repartition(4, "id").write.parquet(str(tmp_path / "t"))
    left = lambda: {f for f, size in _shuffled(spark).items() if size > 10_000} - set(before)
    for _ in range(50):  # they are removed in the background
        if not left():
            break
        time.sleep(0.2)
    assert not left() and spark.conf.get(name) == setting
    assert spark.read.parquet(str(tmp_path / "t")).count() == 300_000


def test_no_table_of_the_classifier_leaves_shuffle_files(spark, sf, monkeypatch):
    """Asks and answers are written one after the other, and the first table goes."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    written, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        written[path.rsplit("/", 1)[1].split("-")[0]] = path, spark.conf.get(name)
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    K.perplexities(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert list(written) == ["pairs", "words", "served", "answers"]
    assert {x for _, x in written.values()} == {"true"}
    assert not Path(written["served"][0].removeprefix("file://")).exists() and Path(written["answers"][0].removeprefix("file://")).exists()
