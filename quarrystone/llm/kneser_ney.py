"""Quality classifier: an interpolated modified Kneser-Ney model of word pairs over trusted text, with a spelling model below.

Trusted are the documents that `labels` marks with quality 1. One in HELD of them (by a hash of the text, so that equal
texts stay together) is held out; of all others all words are counted. Three levels are interpolated: a word after the
word before it (counts), a word by itself (in how many different pairs it ends), and its spelling, byte after byte given
two bytes (counts; then how many different bytes stand before). Each level has three discounts from its counts of counts; what they free goes
to the level below. A word that was never seen has the probability of its spelling, so every text has a perplexity.

Counts and scores are joined in shards, and what moves grows with the text, not the model to every task:

1. Tasks count pairs and send them to shards of the first word (a word's pairs go over SPLIT shards, so that no frequent word is one
   task's). Shards add up, and tell of each word what it needs as context and as continuation; these go to shards of words.
2. Tasks ask for the different pairs and words of a block of documents; shards look them up in their sorted counts, and the answers are
   written by the task that asked, once the asks are gone. Keys are sorted and packed as differences; a pair is asked for by the first bits of its hash, SPARE more than
   the number of pairs needs, so an unseen pair is taken for a seen one with chance 2^-SPARE.
3. Tasks read their answers, and score their documents. Texts never move. The scan must be repeatable (files are):
   a block whose answers don't fit what it asks raises an error.

Only the spelling model is broadcast: at most 2^24 codes of three bytes, by definition.

A document is rejected if its perplexity is above its language's limit even after allowing for its length: log perplexity
minus Z standard errors over the QUANTILE quantile of the same measure of the language's n held-out trusted documents, plus
MARGIN and, since few documents tell little of a tail, CAUTION / sqrt(n) times the quantile's distance from the median.
What else is in the table doesn't move the limit, however much of it is junk. A language with fewer than LEAST_HELD
held-out documents with text takes the quantile of the held-out documents of all languages, or its own if that is higher; only
one without any takes the quantile of all its documents.

Defined results: a null text, and a text without visible characters, has perplexity null and is rejected, as there is nothing to train on;
a null language is a language of its own; without any trusted text that isn't held out every document with text is kept,
with null perplexity. Rows alike in doc_id, language and text share one verdict; repeated labels count once, and a null or
conflicting label isn't trusted. An empty table gives no rows. Extra columns are ignored, and kept by `keep_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import byte_chunks, cut, kept, lean, restrict, shared_path, spent_shuffles_go, text_bytes
from quarrystone.llm.words import BEGIN, BITS, before, mix, pack, pack_repeated, pack_sorted, pair, spellings, unpack, unpack_repeated, unpack_sorted, words
from quarrystone.sources.shared import remove

HELD = 5

QUANTILE = 0.99

#: Standard errors of its mean that a document is granted.
Z = 3.0

#: Added to the limit, in log perplexity of a word.
MARGIN = 0.1

CAUTION = 3.0

#: A language has a limit of its own held-out documents from so many on.
LEAST_HELD = 8

#: Text that a block of asks covers at least; with what Arrow batches hold, a block is a batch of usual documents.
BLOCK_BYTES = 4 << 20

#: Text for each shard, about; there are no fewer shards than shuffle partitions.
SHARD_BYTES = 256 << 20

#: Counts that a training task gathers before it merges them.
MERGE_ROWS = 1_000_000

#: Text of a block whose words are held at once, about.
SLICE_BYTES = 1 << 20

#: Words that are scored at once.
STEP = 1 << 18

SPLIT = 8

SPARE = 12

PAIRS, WORDS, TALLY, SPELLING = range(4)

_VALUES = ["v0", "v1", "v2", "v3", "v4"]
_STORE = "kind int, shard int, n int, k binary, " + ", ".join(f"{v} binary" for v in _VALUES)
_NAMES = ["kind", "shard", "n", "k", *_VALUES]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]


def _rows(rows: list[tuple], names: list[str] = _NAMES, types: list[pa.DataType] = _TYPES) -> pa.RecordBatch:
    rows = [r + (None,) * (len(names) - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, sorted, and the sums of each value."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _pair_sums(u: np.ndarray, w: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Different pairs, sorted, and the sums of their counts; without counts how often each occurs."""
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
    counts = np.diff(np.r_[first, len(u)]) if c is None else np.add.reduceat(c[order], first)
    return u[first], w[first], counts


def _distinct(x: np.ndarray) -> np.ndarray:
    """Different numbers, sorted (sorting is faster here than the hash table of numpy.unique)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _shard(keys: np.ndarray, shards: int, bits: int = BITS) -> np.ndarray:
    """Equal ranges of keys of so many bits."""
    return (keys >> max(0, bits - 30)) * shards >> min(bits, 30)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams that occur 1, 2, 3 and 4 times; 0.5, 1, 1.5 where they give none."""
    n1, n2, n3, n4 = n
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), out, strict=True))


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def _tally(c: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4; the sum of all; how many are 3 or more."""
    return np.r_[np.bincount(np.minimum(c, 5), minlength=6)[1:5], c.sum(), (c > 2).sum()]


# Counting


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        codes: list[tuple[np.ndarray, ...]] = []
        size, most = 0, MERGE_ROWS

        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            h, start, length, counts = words(data, offsets)
            if not len(h):
                continue
            parts.append(_pair_sums(before(h, counts), h))
            _, at, k = np.unique(h, return_index=True, return_counts=True)
            code, first = spellings(data, start[at], length[at])
            codes.append(_sums(code, np.repeat(k, np.diff(np.r_[first, len(code)]))))
            if len(codes) > 8:
                codes = [_sums(*(np.concatenate(x) for x in zip(*codes, strict=True)))]
            size += len(parts[-1][0])
            del h, start, length, code, first
            if size > most:
                parts = [_pair_sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                size = len(parts[0][0])
                most = 2 * size + MERGE_ROWS
        if not parts:
            return
        u, w, c = _pair_sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        del parts
        shard = (mix(u.astype(np.uint64)) + (w % SPLIT).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        out = []
        for k in range(shards):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                out.append((PAIRS, k, len(own), pack_sorted(u[own]), pack_repeated(w[own]), pack(c[own])))
            if len(out) >= 64:
                yield _rows(out)
                out = []
        code, c = _sums(*(np.concatenate(x) for x in zip(*codes, strict=True)))
        for k in range(min(16, shards)):
            own = code % 16 % shards == k
            out.append((SPELLING, k, int(own.sum()), pack_sorted(code[own]), pack(c[own])))
        yield _rows(out)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[dict]]]:
    """Rows of a stream that is sorted by kind and shard, by both."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["kind"], r["shard"]) != key:
                if rows:
                    yield *key, rows
                key, rows = (r["kind"], r["shard"]), []
            rows.append(r)
    if rows:
        yield *key, rows


def _add_pairs(shards: int):
    """Sums of a shard's pairs; of their words what they need as context (total, pairs that occur once, twice, more often) and
    as continuation (different pairs they end); and tallies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, shard, rows in _grouped(batches):
            if kind == SPELLING:
                code, c = _sums(np.concatenate([unpack_sorted(r["k"], r["n"]) for r in rows]), np.concatenate([unpack(r["v0"], r["n"]) for r in rows]))
                yield _rows([(SPELLING, shard, len(code), pack_sorted(code), pack(c))])
                continue
            u, w, c = (np.concatenate([f(r[x], r["n"]) for r in rows]) for x, f in (("k", unpack_sorted), ("v0", unpack_repeated), ("v1", unpack)))
            u, w, c = _pair_sums(u, w, c)
            yield _rows([(PAIRS, shard, len(u), pack_sorted(u), pack_repeated(w), pack(c)), (TALLY, PAIRS, 6, pack(_tally(c)))])
            one = np.ones(len(u), np.int64)
            context = _sums(u, c, (c == 1) * one, (c == 2) * one, (c > 2) * one)
            end, k = _sums(w, one)
            both = np.concatenate([context[0], end])
            z, y = np.zeros(len(end), np.int64), np.zeros(len(context[0]), np.int64)
            told = _sums(both, *(np.concatenate([v, z]) for v in context[1:]), np.concatenate([y, k]))
            edges = np.searchsorted(_shard(told[0], shards), np.arange(shards + 1))
            out = [(WORDS, s, int(j - i), pack_sorted(told[0][i:j]), *(pack(v[i:j]) for v in told[1:])) for s, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]
            for at in range(0, len(out), 64):
                yield _rows(out[at : at + 64])

    return run


def _add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, shard, rows in _grouped(batches):
        told = _sums(np.concatenate([unpack_sorted(r["k"], r["n"]) for r in rows]), *(np.concatenate([unpack(r[v], r["n"]) for r in rows]) for v in _VALUES))
        yield _rows([(WORDS, shard, len(told[0]), pack_sorted(told[0]), *map(pack, told[1:])), (TALLY, WORDS, 6, pack(_tally(told[5])))])


def _by_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "shard")


class Spelling:
    """Probabilities of codes (a byte after two) from their counts."""

    def __init__(self, code: np.ndarray, c: np.ndarray):
        two = _sums(code & 0xFFFF, np.ones(len(code), np.int64))
        one = _sums(two[0] & 0xFF, np.ones(len(two[0]), np.int64))

        def level(k: np.ndarray, c: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
            """The discounted share of each code, and of each context what is left for the level below."""
            d = discounts(_tally(c)[:4].tolist())
            total = np.bincount(k >> 8, c, contexts)
            own = _discounted(c, d)
            left = np.where(total > 0, 1 - np.bincount(k >> 8, own, contexts) / np.maximum(total, 1), 1.0)
            return own / total[k >> 8], left

        share, left = level(*one, 1)
        p1 = np.full(256, left[0] / 256)
        p1[one[0]] += share
        share, left = level(*two, 256)
        p2 = left[:, None] * p1
        p2[two[0] >> 8, two[0] & 0xFF] += share
        self.p2 = p2.ravel()
        self.code = code
        self.share, self.left = level(code, c, 65_536)

    def log(self, code: np.ndarray) -> np.ndarray:
        p = self.left[code >> 8] * self.p2[code & 0xFFFF]
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.log(p + np.where(self.code[at] == code, self.share[at], 0.0))


class Model:
    """What the driver knows: discounts, totals, the spelling model, and the tables of pairs and words."""

    def __init__(self, pairs: DataFrame, told: DataFrame, bits: dict[int, int], discount: dict[int, tuple], total: int, below: float, spelling: Spelling):
        self.pairs, self.words, self.bits = pairs, told, bits
        self.parameters = discount, total, below, spelling


def train(trusted: DataFrame, shards: int, spare: int = SPARE) -> Model | None:
    """The model of a table (text); None if there is no word in it."""
    counted = _by_shard(trusted.select("text").mapInArrow(lean(_count(shards)), _STORE), shards)
    with spent_shuffles_go(trusted.sparkSession):
        pairs = kept(counted.mapInArrow(lean(_add_pairs(shards)), _STORE), "pairs")
        told = kept(_by_shard(pairs.where(F.col("kind") == WORDS), shards).mapInArrow(lean(_add_words), _STORE), "words")
    tally = {PAIRS: np.zeros(6, np.int64), WORDS: np.zeros(6, np.int64)}
    number = {}
    for kind, t in ((PAIRS, pairs), (WORDS, told)):
        for r in t.where(F.col("kind") == TALLY).select("k").toLocalIterator():  # a row per shard
            tally[kind] += unpack(bytes(r["k"]), 6)
        number[kind] = t.where(F.col("kind") == kind).agg(F.sum("n")).first()[0] or 0
    if not number[PAIRS]:
        return None
    discount = {k: discounts(t[:4].tolist()) for k, t in tally.items()}
    t, d = tally[WORDS], discount[WORDS]
    total = int(t[4])
    below = (t[0] * d[0] + t[1] * d[1] + t[5] * d[2]) / total
    rows = pairs.where(F.col("kind") == SPELLING).select("n", "k", "v0").collect()  # 2^24 codes at most
    code = np.concatenate([unpack_sorted(bytes(r["k"]), r["n"]) for r in rows])
    c = np.concatenate([unpack(bytes(r["v0"]), r["n"]) for r in rows])
    bits = {k: min(BITS, int(n).bit_length() + spare + 4 * (k == WORDS)) for k, n in number.items()}
    return Model(pairs.where(F.col("kind") == PAIRS), told.where(F.col("kind") == WORDS), bits, discount, total, below, Spelling(*_sums(code, c)))


# Asking and scoring

_ASK = "kind int, shard int, block bigint, " + _STORE.split(", ", 2)[2]
_ASK_NAMES = ["kind", "shard", "block", *_NAMES[2:]]
_ASK_TYPES = [pa.int32(), pa.int32(), pa.int64(), *_TYPES[2:]]


class Slice(NamedTuple):
    """The words of some documents of a block, under the keys that are asked for."""

    data: np.ndarray
    h: np.ndarray
    pair: np.ndarray
    start: np.ndarray
    length: np.ndarray
    counts: np.ndarray


class Block:
    """The words of some batches of documents. Only what they ask for is held; the words are found again, slice by slice."""

    def __init__(self, batches: list[pa.RecordBatch], bits: dict[int, int]):
        self.texts = [text_bytes(b.column("text")) for b in batches]
        self.bits = bits
        self.begin = BEGIN >> (BITS - bits[WORDS])
        asks: dict[int, list[np.ndarray]] = {PAIRS: [np.zeros(0, np.int64)], WORDS: [np.array([self.begin])]}
        for s in self.slices():
            asks[PAIRS].append(_distinct(s.pair))
            asks[WORDS].append(_distinct(s.h))
        self.asks = {kind: _distinct(np.concatenate(x)) for kind, x in asks.items()}

    def slices(self) -> Iterator[Slice]:
        for data, offsets in self.texts:
            for i, j in byte_chunks(offsets, SLICE_BYTES):
                h, start, length, counts = words(data, offsets[i : j + 1])
                u = before(h, counts)
                for k in range(0, len(h), STEP):  # in place: a pair's hash takes the place of its first word
                    u[k : k + STEP] = pair(u[k : k + STEP], h[k : k + STEP]) >> (BITS - self.bits[PAIRS])
                h >>= BITS - self.bits[WORDS]
                yield Slice(data, h, u, start, length, counts)


def _blocks(batches: Iterator[pa.RecordBatch], bits: dict[int, int]) -> Iterator[tuple[int, list[pa.RecordBatch], Block]]:
    parts, size, number, first = [], 0, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        first = b.column("pid")[0].as_py() << 20  # of the scan: a task may have another number
        parts.append(b)
        size += b.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield first + number, parts, Block(parts, bits)
            parts, size, number = [], 0, number + 1
    if parts:
        yield first + number, parts, Block(parts, bits)


def _ask(bits: dict[int, int], shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in _blocks(batches, bits):
            out = []
            for kind, keys in block.asks.items():
                edges = np.searchsorted(_shard(keys, shards, bits[kind]), np.arange(shards + 1))
                for s, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                    if j > i:
                        out.append((kind, s, number, int(j - i), pack_sorted(keys[i:j])))
            for at in range(0, len(out), 256):
                yield _rows(out[at : at + 256], _ASK_NAMES, _ASK_TYPES)

    return run


def _shorten(bits: dict[int, int], shards: int):
    """The counts of pairs and words under the keys that are asked for, with their shards; block -1 comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                kind, n = r["kind"], r["n"]
                if kind == PAIRS:
                    keys = pair(unpack_sorted(r["k"], n), unpack_repeated(r["v0"], n)) >> (BITS - bits[kind])
                    values = [unpack(r["v1"], n)]
                else:
                    keys = unpack_sorted(r["k"], n) >> (BITS - bits[kind])
                    values = [unpack(r[v], n) for v in _VALUES]
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], [v[order] for v in values]
                edges = np.searchsorted(_shard(keys, shards, bits[kind]), np.arange(shards + 1))
                out = [(kind, s, -1, int(j - i), pack_sorted(keys[i:j]), *(pack(v[i:j]) for v in values)) for s, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]
                for at in range(0, len(out), 256):
                    yield _rows(out[at : at + 256], _ASK_NAMES, _ASK_TYPES)

    return run


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers, in a stream that is sorted by kind, shard and block: counts first, then the asks, each looked up."""
    key, parts, table = None, [], None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if (r["kind"], r["shard"]) != key:
                key, parts, table = (r["kind"], r["shard"]), [], None
            width = 1 if r["kind"] == PAIRS else 5
            if r["block"] < 0:
                parts.append((unpack_sorted(r["k"], r["n"]), *(unpack(r[v], r["n"]) for v in _VALUES[:width])))
                continue
            if table is None:
                table = _sums(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),)
            asked = unpack_sorted(r["k"], r["n"])
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], asked), len(table[0]) - 1)
                there = table[0][at] == asked
                values = [pack(np.where(there, v[at], 0)) for v in table[1:]]
            else:
                values = [pack(np.zeros(r["n"], np.int64))] * width
            out.append((r["kind"], r["shard"], r["block"], r["n"], None, *values))
        if out:
            yield _rows(out, _ASK_NAMES, _ASK_TYPES)


def _answers(path: str, pid: int) -> dict[int, list[dict]]:
    """The answers to a task's blocks, by block, in the order of kinds and shards."""
    files, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/pid={pid}"
    out: dict[int, list[dict]] = {}
    if files.get_file_info(folder).type == fs.FileType.Directory:
        for f in files.get_file_info(fs.FileSelector(folder)):
            if f.base_name.endswith(".parquet"):
                with files.open_input_file(f.path) as source:
                    for r in pq.ParquetFile(source).read().to_pylist():
                        out.setdefault(r["block"], []).append(r)
    for rows in out.values():
        rows.sort(key=lambda r: (r["kind"], r["shard"]))
    return out


def log_probabilities(block: Block, told: dict[int, list[np.ndarray]], parameters: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each slice the number of words of each document, and of each word its log probability after the one before it; told: the
    values of what the block asks for."""
    discount, total, below, spelling = parameters
    asked = block.asks[WORDS]
    context, once, twice, more, ends = told[WORDS]
    left = np.where(context > 0, (discount[PAIRS][0] * once + discount[PAIRS][1] * twice + discount[PAIRS][2] * more) / np.maximum(context, 1), 1.0)
    p1 = _discounted(ends, discount[WORDS]) / total
    spelt = np.zeros(len(asked), bool)
    begin = np.searchsorted(asked, block.begin)
    for s in block.slices():
        steps = range(0, len(s.h), STEP)
        at = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(asked, s.h[i : i + STEP]).astype(np.int32) for i in steps)])
        # Spellings of the words that no slice before had, from one place of each.
        place = np.full(len(asked), -1)
        place[at] = np.arange(len(at))
        place[spelt] = -1
        new = np.flatnonzero(place >= 0)
        for i in range(0, len(new), STEP // 8):
            own = new[i : i + STEP // 8]
            code, first = spellings(s.data, s.start[place[own]], s.length[place[own]])
            p1[own] += below * np.exp(np.add.reduceat(spelling.log(code), first))
        spelt[new] = True
        # Counts of the pairs: in their order, as sorted keys are found faster, then back.
        order = np.argsort(s.pair)
        count = np.empty(len(order), np.int64)
        count[order] = told[PAIRS][0][np.searchsorted(block.asks[PAIRS], s.pair[order])]
        u = before(at, s.counts, begin)
        out = np.empty(len(at))
        for i in steps:
            x = u[i : i + STEP]
            c = np.minimum(count[i : i + STEP], context[x])
            p2 = _discounted(c, discount[PAIRS]) / np.maximum(context[x], 1) + left[x] * p1[at[i : i + STEP]]
            out[i : i + STEP] = np.log(np.maximum(p2, 1e-300))
        yield s.counts, out


def _score(shared, path: str, bits: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = None
        for number, parts, block in _blocks(batches, bits):
            if answers is None:
                answers = _answers(path, number >> 20)
            told: dict[int, list[np.ndarray]] = {}
            for kind, width in ((PAIRS, 1), (WORDS, 5)):
                rows = [r for r in answers.get(number, []) if r["kind"] == kind]
                if sum(r["n"] for r in rows) != len(block.asks[kind]):
                    raise RuntimeError("the documents were read in another order the second time: write them to a table first")
                told[kind] = [np.concatenate([np.zeros(0, np.int64), *(unpack(r[v], r["n"]) for r in rows)]) for v in _VALUES[:width]]
            answers.pop(number, None)
            sums = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
            for counts, x in log_probabilities(block, told, shared.value):
                np.negative(x, out=x)
                first = np.cumsum(counts) - counts
                some = counts > 0
                total, squares = np.zeros(len(some)), np.zeros(len(some))
                if len(x):
                    total[some] = np.add.reduceat(x, first[some])
                    squares[some] = np.add.reduceat(np.square(x, out=x), first[some])
                sums.append((counts, total, squares))
            sums = [np.concatenate(v) for v in zip(*sums, strict=True)]
            at = 0
            for b in parts:
                own = slice(at, at + b.num_rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "key", "fold")), *(pa.array(v[own]) for v in sums)], names=["doc_id", "lang", "key", "fold", "size", "total", "squares"])
                at += b.num_rows

    return run


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), "text")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Kept bigint doc_ids that labels mark as good."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = 1 and r = 1").select("doc_id")
    return cut(good)


def perplexities(docs: DataFrame, labels: DataFrame, spare: int = SPARE, shards: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """One kept row per document: doc_id, lang, key, size in words, mean and deviation of -log p over its words.

    And those of the held-out trusted documents; None without any word to train on.
    """
    spark = docs.sparkSession
    d = docs.select(F.spark_partition_id().alias("pid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), _key().alias("key"), F.pmod(F.xxhash64("text"), F.lit(HELD)).cast("int").alias("fold"), F.col("text").alias("text"))
    good = trusted_ids(labels)
    if shards is None:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    model = train(restrict(d.where("fold > 0"), good, ["doc_id"]), shards, spare)
    if model is None:
        visible = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x20\x7f]")), F.lit(0))
        return cut(d.select("doc_id", "lang", "key", visible.cast("bigint").alias("size"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("deviation"))), None
    bits = model.bits
    counts = model.pairs.unionByName(model.words).mapInArrow(lean(_shorten(bits, shards)), _ASK)
    asks = d.mapInArrow(lean(_ask(bits, shards)), _ASK)  # of the same columns as below, so that batches end at the same rows
    met = counts.unionByName(asks).repartitionById(2 * shards, F.col("kind") * shards + F.col("shard")).sortWithinPartitions("kind", "shard", "block")
    served, path = shared_path(spark, "served"), shared_path(spark, "answers")
    answers = met.mapInArrow(lean(_serve), _ASK).drop("k").withColumn("pid", F.shiftright("block", 20))
    with spent_shuffles_go(spark):  # two tables, so that asks and answers are never both shuffle files
        answers.write.parquet(served)
        spark.read.schema(answers.schema).parquet(served).repartition("pid").sortWithinPartitions("pid").write.partitionBy("pid").parquet(path)
    remove(spark, served)
    shared = spark.sparkContext.broadcast(model.parameters)
    scored = cut(d.mapInArrow(lean(_score(shared, path, bits)), "doc_id bigint, lang string, key bigint, fold int, size bigint, total double, squares double"))
    mean = F.when(F.col("size") > 0, F.col("total") / F.col("size"))
    deviation = F.sqrt(F.greatest(F.col("squares") / F.col("size") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    out = scored.withColumn("mean", mean).select("doc_id", "lang", "key", "fold", "size", "mean", F.when(F.col("size") > 0, deviation).alias("deviation"))
    return out.drop("fold"), restrict(out.where("fold = 0"), good, ["doc_id"]).drop("fold")


def _measure() -> Column:
    """Log perplexity less what a document is granted for its length."""
    return F.col("mean") - Z * F.col("deviation") / F.sqrt("size")


def limits(scores: DataFrame, held: DataFrame | None = None, quantile: float = QUANTILE) -> DataFrame:
    """lang and limit: the highest measure that is kept. Of the held-out trusted documents of a language where it has LEAST_HELD of
    them; of those of all languages where it has fewer, if that is higher; of all its documents where it has none."""

    def of(t: DataFrame, *by: str) -> DataFrame:
        t = t.where("mean is not null").groupBy(*by).agg(F.percentile_approx(_measure(), [0.5, quantile], 10_000).alias("q"), F.count(F.lit(1)).alias("n"))
        return t.withColumn("q", F.col("q")[1] + CAUTION / F.sqrt("n") * (F.col("q")[1] - F.col("q")[0]))

    q = of(scores, "lang")
    if held is not None:
        own = of(held, "lang").select(F.col("lang").alias("_lang"), F.col("q").alias("_q"), F.col("n").alias("_n"))
        pooled = of(held).first()["q"]
        few = F.when(F.col("_n") < LEAST_HELD, F.greatest("_q", F.lit(pooled).cast("double"))).otherwise(F.col("_q"))
        q = q.join(own, q["lang"].eqNullSafe(own["_lang"]), "left").select("lang", F.coalesce(few, "q").alias("q"))
    return q.select("lang", (F.col("q") + MARGIN).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, spare: int = SPARE, shards: int | None = None) -> DataFrame:
    """doc_id, lang, key, perplexity, limit and keep of every document."""
    scores, held = perplexities(docs, labels, spare, shards)
    top = cut(limits(scores, held).withColumnRenamed("lang", "_lang"))
    joined = scores.join(F.broadcast(top) if top.count() <= 100_000 else top, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    over = _measure() > F.col("limit")
    return joined.select("doc_id", "lang", "key", F.exp("mean").alias("perplexity"), F.exp("limit").alias("limit"), ((F.col("size") > 0) & ~F.coalesce(over, F.lit(False))).alias("keep"))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns. What goes is told by a hash of its content and its doc_id."""
    none = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_d")
    rejected = cut(classify(docs, labels).where("not keep").select(F.col("key").alias("_key"), none).distinct())
    return restrict(docs.select(F.struct("*").alias("_row"), _key().alias("_key"), none), rejected, ["_key", "_d"], "left_anti").select("_row.*")
