"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are runs of SHINGLE words (a shorter text is one shingle), hashed to 64 bits; words are runs of ASCII letters, digits
and bytes beyond ASCII, ASCII letters in lower case. The weight of a shingle is (1 + ln tf) * (1 + idf), where idf = ln(N / df) /
ln(1 / rare), at most 1: shingles that are everywhere count half of those in fewer than one in 1 / rare documents, which
count alike. So a weight depends on the share of documents that have the shingle, not on how many documents there are,
and a group of a thousand copies is still alike among themselves. rare is RARE, or more where documents are so long that
more than HEAVY_ROWS shingles could be that frequent.

Document frequencies are exact. A count-min sketch over all documents (ROWS rows of WIDTH counters, whatever the corpus is)
never underestimates, so it tells which shingles may occur in a share rare of the documents; these are counted exactly in a second pass,
and those that do are the only ones whose frequency matters: at most HEAVY_ROWS, by the definition of rare. Sketch noise costs
rows in that count, never a wrong weight.

Improved consistent weighted sampling (Ioffe) draws HASHES samples of each document: for every shingle and hash r, c ~
Gamma(2, 1) and beta ~ U(0, 1) from seeded tables that three parts of the shingle's hash index, t = floor(ln w / r +
beta), and the shingle with the least ln c - r (t - beta + 1) is the sample (with t). Two documents have the same sample with
the probability of their weighted Jaccard similarity.

1. Rows of equal text are one document: the one with the least doc_id stands for them.
2. BANDS bands of HASHES / BANDS samples. Buckets are counted; only members of buckets with several get the four bits of
   each sample that tell an estimate. Within a bucket members are linked by a breadth-first search over the estimate:
   a pivot claims what is alike, near-certain ones leave the search, others stay open to later pivots. Pivots come in the
   order of their agreement with the bucket's most frequent samples, so that the original of a group comes first and a
   bucket of n copies gives about n links, not n^2. Nothing is capped: a bucket of unlike documents is searched through all
   its pairs. A bucket of more than PIECE members is searched in pieces, by other tasks; then the leaders of what the pieces
   found are searched; what isn't connected with the largest of these groups meets every piece again (`_hot_links`).
3. A link counts if the weighted Jaccard similarity of the two whole texts reaches THRESHOLD. The pivot's text meets
   those of its partners in sorted streams of about PARTNERS partners.
4. Groups are the connected components of the links that count (alternating large and small stars, cut by checkpoints).

Defined results: a null text, and a text without words, is no document's duplicate. Rows that repeat, or that share a doc_id
without being alike, are told apart by a hash of the text; alike ones are one group. A null doc_id takes part and comes first
in its group. An empty table gives no rows. Extra columns are ignored, and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import byte_chunks, cut, kept, lean, restrict, text_bytes
from quarrystone.llm.components import components

SHINGLE = 3

HASHES = 96

BANDS = 24

THRESHOLD = 0.55

SEED = 5

#: Share of the documents below which shingles count alike.
RARE = 1e-3

#: Shingles at most whose frequency is told to the workers.
HEAVY_ROWS = 4_000_000

ROWS, WIDTH = 2, 1 << 21

#: Members of a bucket that one task searches at once.
PIECE = 100_000

#: Partners of a pivot in one stream.
PARTNERS = 512

#: Counters in a row of the sketch's exchange.
BLOCK = 1 << 13

#: Rows of the tables of random numbers (a power of 2).
TABLE = 1 << 13

#: Shingles that are sampled at once.
PART = 1 << 10

#: How far under the threshold an estimate still makes a link to verify, and over it one that is near-certain.
MARGIN = 0.15

_P = np.uint64(0x9E3779B97F4A7C15)
#: Its inverse modulo 2^64.
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Words are runs of ASCII letters, digits and bytes beyond ASCII; ASCII letters in lower case. 0 separates.
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_LETTER[[i for i in range(128) if not chr(i).isalnum()]] = 0

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _P and of its inverse."""
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _INVERSE)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, n: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the distinct shingle hashes, sorted, and how often each occurs.

    A word's hash is the sum of its bytes times powers of an odd number, which one pass over the bytes of many texts gives.
    """
    data, offsets = text_bytes(texts)
    with np.errstate(over="ignore"):
        for i, j in byte_chunks(offsets):
            bounds = offsets[i : j + 1] - offsets[i]
            x = _LETTER[data[offsets[i] : offsets[j]]]
            begins = x != 0
            inner = begins[1:] & ~begins[:-1]
            edges = bounds[(bounds > 0) & (bounds < len(x))]
            begins[1:] = inner
            begins[edges] = x[edges] != 0
            start = np.flatnonzero(begins)
            if len(start):
                power, inverse = _power(len(x))
                h = _mix(np.add.reduceat(x * power[: len(x)], start) * inverse[start])
                s = h
                for k in range(1, n):
                    s = _mix(s[: len(h) - k] * _P + h[k:]) if len(h) > k else s[:0]
            at = np.searchsorted(start, bounds)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= n:
                    own = np.sort(s[a : b - n + 1])
                elif b > a:
                    own = h[a : a + 1]
                    for k in range(a + 1, b):
                        own = _mix(own * _P + h[k : k + 1])
                else:
                    yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    continue
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                yield own[first], np.diff(np.r_[first, len(own)])


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The counters of a shingle, one in each row of the sketch."""
    return [((h >> np.uint64(1 + 21 * i)) & np.uint64(WIDTH - 1)).astype(np.int64) for i in range(ROWS)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of a task's documents, in blocks; the last row, row ROWS, has the number of documents."""
    counts = np.zeros((ROWS, WIDTH), np.int64)
    n = 0
    for b in batches:
        pending, size = [], 0
        for h, _ in shingles(b.column("text")):
            n += len(h) > 0
            pending.append(h)
            size += len(h)
            if size > 1 << 18:
                for i, s in enumerate(_slots(np.concatenate(pending))):
                    counts[i] += np.bincount(s, minlength=WIDTH)
                pending, size = [], 0
        if pending:
            for i, s in enumerate(_slots(np.concatenate(pending))):
                counts[i] += np.bincount(s, minlength=WIDTH)
    if n:
        ids = [(i, k) for i in range(ROWS) for k in range(WIDTH // BLOCK)]
        for at in range(0, len(ids), 16):
            part = ids[at : at + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i * (WIDTH // BLOCK) + k for i, k in part], pa.int32()), pa.array([_narrow(counts[i, k * BLOCK : (k + 1) * BLOCK]) for i, k in part], pa.binary())], names=["block", "counts"]
            )
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.int64(n).tobytes()], pa.binary())], names=["block", "counts"])


def _narrow(a: np.ndarray) -> bytes:
    """A kind byte and the numbers in as few bytes as they need."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if a.max() <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + a.astype(kind).tobytes()
    return bytes([8]) + a.astype(np.uint64).tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.dtype(f"u{b[0]}"), offset=1).astype(np.int64)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a partition in which every block is whole."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(c, np.int64) if block < 0 else _wide(c)
            sums[block] = sums[block] + x if block in sums else x.copy()
    for block, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes() if block < 0 else _narrow(x)], pa.binary())], names=["block", "counts"])


def sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch over all documents and the number of those with words."""
    parts = docs.select("text").mapInArrow(lean(_sketch), "block int, counts binary")
    rows = parts.repartition(F.col("block")).mapInArrow(lean(_add), "block int, counts binary").toArrow()
    out, n = np.zeros(ROWS * WIDTH, np.uint32), 0
    for block, c in zip(rows.column("block").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        if block < 0:
            n = int(np.frombuffer(c, np.int64)[0])
        else:
            out[block * BLOCK : (block + 1) * BLOCK] = np.minimum(_wide(c), 0xFFFFFFFF)
    return out.reshape(ROWS, WIDTH), n


def _heavy(shared):
    """Counts of a task's documents by shingle, of shingles that the sketch lets be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        pending: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(pending), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        for b in batches:
            for h, _ in shingles(b.column("text")):
                if len(h):
                    maybe = np.logical_and.reduce([marks[i][s] for i, s in enumerate(_slots(h))])
                    pending.append(h[maybe])
                    size += len(pending[-1])
            if size > 1 << 20:
                yield counted()
                pending, size = [], 0
        if size:
            yield counted()

    return run


def frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and 1 + idf of each; what isn't among them has 2."""
    counts, n = sketch(docs)
    occurrences = int(counts[0].sum(dtype=np.int64))
    rare = min(1.0, max(RARE, occurrences / max(n, 1) / HEAVY_ROWS))
    least = max(1, int(np.ceil(rare * n)))
    shared = docs.sparkSession.sparkContext.broadcast(counts >= min(least, 0xFFFFFFFF))  # ROWS * WIDTH booleans
    found = docs.select("text").mapInArrow(lean(_heavy(shared)), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    idf = np.log(n / found.column("c").to_numpy()[order]) / np.log(1 / rare) if rare < 1 else np.zeros(len(h))
    return h[order], 1 + np.minimum(idf, 1.0)


def weights(h: np.ndarray, tf: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = 1 + np.log(tf)
    hashes, idf = frequent
    if not len(hashes):
        return 2 * w
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return w * np.where(hashes[at] == h, idf[at], 2.0)


class Sampler:
    """The random tables, made once per worker."""

    def __init__(self, hashes: int = HASHES, seed: int = SEED):
        g = np.random.default_rng(seed)
        self.r = g.gamma(2, 1, (TABLE, hashes)).astype(np.float32).clip(1e-3)
        self.c = np.log(g.gamma(2, 1, (TABLE, hashes)).clip(1e-9)).astype(np.float32)
        self.beta = g.random((TABLE, hashes), np.float32)
        self.hashes = hashes
        self.scratch = [np.empty((PART, hashes), np.float32) for _ in range(4)]

    def sample(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One 64-bit value for each hash: of the sampled shingle and its t."""
        best = np.full(self.hashes, np.inf, np.float32)
        out = np.zeros(self.hashes, np.uint64)
        log_w = np.log(w).astype(np.float32)
        m = np.uint64(TABLE - 1)
        columns = np.arange(self.hashes)
        for at in range(0, len(h), PART):
            x = h[at : at + PART]
            r, beta, c, t = (z[: len(x)] for z in self.scratch)
            for z, source, shift in ((r, self.r, 0), (beta, self.beta, 13), (c, self.c, 26)):
                source.take((x >> np.uint64(shift) & m).astype(np.intp), axis=0, out=z, mode="clip")
            np.divide(log_w[at : at + PART, None], r, out=t)
            t += beta
            np.floor(t, out=t)
            np.subtract(t, beta, out=beta)
            beta += 1
            beta *= r
            c -= beta
            first = c.argmin(axis=0)
            least = c[first, columns]
            better = least < best
            best = np.where(better, least, best)
            with np.errstate(over="ignore"):
                value = (x[first] ^ (t[first, columns].astype(np.int64).astype(np.uint64) * _P)) * _P
            out = np.where(better, value ^ (value >> np.uint64(31)), out)
        return out


_samplers: dict[int, Sampler] = {}


def _signatures(shared, bands: int):
    """Of each document one row per band: the band with its hash, and four bits of every sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        if HASHES not in _samplers:
            _samplers[HASHES] = Sampler()
        sampler = _samplers[HASHES]
        for b in batches:
            ids, hashes, halves = [], [], []
            for id_, (h, tf) in zip(b.column("id").to_pylist(), shingles(b.column("text")), strict=True):
                if len(h):
                    s = sampler.sample(h, weights(h, tf, frequent))
                    ids.append(id_)
                    hashes.append(s)
                    half = s.astype(np.uint8) & 15
                    halves.append((half[0::2] << 4 | half[1::2]).tobytes())
            if ids:
                s = np.stack(hashes).reshape(len(ids), bands, -1)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(ids), bands)).copy()
                with np.errstate(over="ignore"):
                    for k in range(s.shape[2]):
                        band = (band ^ s[:, :, k]) * _P
                        band ^= band >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(band.view(np.int64)), pa.list_(pa.int64())), pa.array(halves, pa.binary())], names=["id", "bands", "halves"])

    return run


def link(ids: np.ndarray, s: np.ndarray, threshold: float = THRESHOLD, margin: float = MARGIN) -> list[tuple[int, int]]:
    """Links to verify in one bucket, each (pivot, partner). s: four bits of every sample, a row per member."""
    n, hashes = s.shape
    if n == 2:
        return [(int(ids[0]), int(ids[1]))] if (s[0] == s[1]).mean() > threshold - margin else []
    # Agreement with what is most frequent at each place.
    agree = np.zeros(n, np.int64)
    for k in range(hashes):
        c = np.bincount(s[:, k], minlength=16)
        agree += c[s[:, k]] == c.max()
    order = np.lexsort((ids, -agree))
    ids, s = ids[order], s[order]
    free = np.arange(1, n)
    queue, out = [0], []
    while len(free):
        if not queue:
            queue.append(int(free[0]))
            free = free[1:]
            continue
        p = queue.pop(0)
        if not len(free):
            break
        same = (s[free] == s[p]).mean(axis=1)
        alike = (same - 1 / 16) / (1 - 1 / 16)
        near = alike >= threshold - margin
        out += [(int(ids[p]), int(ids[q])) for q in free[near]]
        sure = alike >= threshold + margin
        queue += free[sure].tolist()
        free = free[~sure]
    return out


def leaders(ids: np.ndarray, links: list[tuple[int, int]]) -> dict[int, int]:
    """Of each member the leader of those that are connected with it: the first pivot that reached them, or itself."""
    root = {int(i): int(i) for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in links:
        u, v = find(u), find(v)
        if u != v:
            root[v] = u
    return {i: find(i) for i in root}


def _buckets(tell: bool):
    """Links of the buckets in a stream that is sorted by band and piece; a bucket may go over batches.

    tell: rows (u, v) are followed by the members of every bucket with their leaders, as (member, leader) with the band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, s = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            own, packed = np.concatenate(ids), np.concatenate(s)
            out = link(own, np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)) if len(own) > 1 else []
            if out:
                u, v = np.array(out, np.int64).T
                yield _rows(u, v, np.full(len(u), np.nan))
            if tell:
                led = leaders(own, out)
                yield _rows(np.array(list(led), np.int64), np.array(list(led.values()), np.int64), np.full(len(led), key[0], np.int64))

        def _rows(u: np.ndarray, v: np.ndarray, band: np.ndarray) -> pa.RecordBatch:
            bands = pa.nulls(len(u), pa.int64()) if band.dtype.kind == "f" else pa.array(band)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), bands], names=["u", "v", "band"])

        for b in batches:
            if not b.num_rows:
                continue
            bands, pieces = (b.column(c).to_numpy(zero_copy_only=False) for c in ("band", "piece"))
            own = b.column("id").to_numpy(zero_copy_only=False)
            packed = np.frombuffer(b"".join(b.column("halves").to_pylist()), np.uint8).reshape(len(own), -1)
            edges = np.r_[0, np.flatnonzero((bands[1:] != bands[:-1]) | (pieces[1:] != pieces[:-1])) + 1, len(bands)]
            for i, j in zip(edges, edges[1:], strict=False):
                if (bands[i], pieces[i]) != key:
                    yield from done()
                    key, ids, s = (bands[i], pieces[i]), [], []
                ids.append(own[i:j])
                s.append(packed[i:j])
        yield from done()

    return run


_LINKS = "u bigint, v bigint, band bigint"


def _search(members: DataFrame, signed: DataFrame, tell: bool, partitions: int) -> DataFrame:
    """Links (u, v, band) of members (band, piece, id), with the samples of a kept table (id, halves)."""
    rows = members.join(signed.select("id", "halves"), "id")
    sorted_ = rows.repartition(partitions, "band", "piece").sortWithinPartitions("band", "piece", "id")
    return sorted_.select("band", "piece", "id", "halves").mapInArrow(lean(_buckets(tell)), _LINKS)


def _hot_links(hot: DataFrame, signed: DataFrame, piece_rows: int, partitions: int) -> DataFrame:
    """Links (u, v) of the members (band, id, n) of buckets with n > piece_rows members each.

    Pieces are searched by themselves; what each piece connects has a leader. The leaders of a band are searched, in pieces as long as they
    are many. Members of the largest group of a band are connected with each other; every other member meets every piece,
    so that no pair of the bucket is left out. Where a bucket is one group of copies, nothing is left to meet.
    """
    pieces = F.ceil(F.col("n") / piece_rows).cast("int")
    members = cut(hot.select("band", "id", "n", F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece")))
    found = cut(_search(members.select("band", "piece", "id"), signed, True, partitions))
    out = found.where("band is null").select("u", "v")
    led = cut(found.where("band is not null").select("band", F.col("u").alias("id"), F.col("v").alias("leader")))
    before = None
    for k in itertools.count():
        tops = kept(led.select("band", F.col("leader").alias("id")).distinct(), "leaders")
        sizes = tops.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        several = kept(tops.join(sizes, "band").select("band", "id", F.pmod(F.xxhash64("id", F.lit(k)), F.ceil(F.col("n") / piece_rows)).cast("int").alias("piece"), "n"), "leaders")
        many = several.where(F.col("n") > piece_rows).count()
        if several.isEmpty() or before is not None and many > before / 2:  # leaders of unlike groups don't get fewer
            break
        found = kept(_search(several.select("band", "piece", "id"), signed, True, partitions), "links")
        out = out.unionByName(found.where("band is null").select("u", "v"))
        up = found.where("band is not null").select("band", F.col("u").alias("leader"), F.col("v").alias("top"))
        led = kept(led.join(up, ["band", "leader"], "left").select("band", "id", F.coalesce("top", "leader").alias("leader")), "leaders")
        if not many:
            break
        before = many
    groups = cut(led.groupBy("band", "leader").agg(F.count(F.lit(1)).alias("k")))
    largest = groups.groupBy("band").agg(F.max(F.struct("k", "leader")).alias("m")).select("band", F.col("m.leader").alias("leader"))
    rest = cut(led.join(largest, ["band", "leader"], "left_anti").select("band", "id"))
    left = rest.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias("parts"))
    if rest.isEmpty():
        return out
    # Cells: a part of the rest with a piece of all.
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    counts = members.groupBy("band").agg(F.max("n").alias("n")).select("band", pieces.alias("pieces"))
    cell = F.xxhash64("part", "piece")
    a = rest.join(left, "band").join(counts, "band").select("band", "id", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    b = members.join(left, "band").select("band", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "piece")
    cells = a.unionByName(b).distinct().select("band", cell.alias("piece"), "id")
    return out.unionByName(_search(cells, signed, False, partitions).select("u", "v"))


def candidate_links(signed: DataFrame, partitions: int, piece_rows: int = PIECE) -> DataFrame:
    """Links (u, v) to verify of a kept table (id, bands, halves)."""
    banded = signed.select("id", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(banded.join(sizes, "band"))
    usual = members.where(F.col("n") <= piece_rows).select("band", F.lit(0).alias("piece"), "id")
    links = _search(usual, signed, False, partitions).select("u", "v")
    hot = members.where(F.col("n") > piece_rows)
    if not hot.isEmpty():
        links = links.unionByName(_hot_links(hot, signed, piece_rows, partitions))
    return links.where("u <> v").distinct()


def _pairs(x: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(x, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total > 0 else 0.0


def _verify(shared, threshold: float):
    """Links that hold, from a stream sorted by pivot and chunk in which the pivot's own text comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        pivot, own = None, None
        for b in batches:
            out = []
            for u, chunk, v, (h, tf) in zip(b.column("u").to_pylist(), b.column("chunk").to_pylist(), b.column("v").to_pylist(), shingles(b.column("text")), strict=True):
                x = h, weights(h, tf, frequent)
                if v is None:
                    pivot, own = (u, chunk), x
                elif (u, chunk) == pivot and similarity(own, x) >= threshold:
                    out.append((u, v))
            if out:
                yield _pairs(out)

    return run


def _id() -> Column:
    """A number for each row's doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), F.col("doc_id").isNull(), "text")


def groups(docs: DataFrame, threshold: float = THRESHOLD, piece_rows: int = PIECE, partners: int = PARTNERS) -> DataFrame:
    """A kept row (doc_id, id, g, group, first) for each document that has a near-duplicate.

    id: a hash of doc_id and text, g: another of the text. group: the least doc_id of the group (nulls come first). first: this
    document stays, and so do its repetitions.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), _id().alias("id"))
    # 1. Equal texts, by 128 bits of hashes; only ids and hashes move, and of a group of copies one row from each task.
    hashed = cut(d.where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).select("doc_id", "id", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(7)).alias("g")))
    sets = hashed.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "id")).alias("m")).where("n > 1")
    equal = cut(hashed.join(sets.select("h", "g", F.col("m.id").alias("rep")), ["h", "g"]).select("doc_id", "id", "rep"))
    copies = cut(equal.where("id <> rep").select("id").distinct())
    unique = restrict(d.select("id", "text").where("text is not null"), copies, ["id"], "left_anti")
    # 2. Frequencies over all documents, then samples of one document for each text.
    shared = spark.sparkContext.broadcast(frequencies(docs))  # HEAVY_ROWS rows at most
    signed = cut(unique.mapInArrow(lean(_signatures(shared, BANDS)), "id bigint, bands array<bigint>, halves binary").dropDuplicates(["id"]))
    links = cut(candidate_links(signed, n, piece_rows))
    # A pair may have come up from both sides: the pivot is the one that has more partners.
    degree = links.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    sided = cut(links.join(degree, "u").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max(F.struct("k", "u", "v")).alias("x")).select("x.k", "x.u", "x.v"))
    # 3. Texts of the linked documents only: one for each partner, one for each chunk of a pivot's partners.
    chunked = sided.select("u", F.pmod(F.xxhash64("v"), F.ceil(F.col("k") / partners)).cast("int").alias("chunk"), "v")
    wanted = cut(chunked.unionByName(chunked.select("u", "chunk", F.lit(None).cast("bigint").alias("v")).distinct()).withColumn("id", F.coalesce("v", "u")))
    texts = restrict(unique, cut(wanted.select("id").distinct()), ["id"]).dropDuplicates(["id"])
    stream = wanted.join(texts, "id").select("u", "chunk", "v", "text").repartition(n, "u", "chunk").sortWithinPartitions("u", "chunk", F.col("v").asc_nulls_first())
    held = stream.mapInArrow(lean(_verify(shared, threshold)), "u bigint, v bigint")
    # 4. Components over near and equal ones.
    root = components(held.unionByName(equal.select(F.col("id").alias("u"), F.col("rep").alias("v"))))
    member = root.unionByName(root.select(F.col("root").alias("id"), "root").distinct())
    alone = equal.select(F.col("rep").alias("id"), F.col("rep").alias("root")).distinct().join(member, "id", "left_anti")  # whole rows that repeat
    rows = cut(hashed.select("doc_id", "id", "g").join(member.unionByName(alone), "id"))
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("m"))
    return cut(rows.join(least, "root").select("doc_id", "id", "g", F.col("m.doc_id").alias("group"), (F.col("id") == F.col("m.id")).alias("first")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) of every document in a group of two or more; group_id is the doc_id that stays."""
    return groups(docs, threshold).select("doc_id", F.col("group").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, and all that have no near-duplicate, with all columns.

    Of rows that are alike in doc_id and text one stays. What goes is told by two hashes, of 128 bits together.
    """
    g = groups(docs, threshold)
    gone = cut(g.groupBy("id", "g").agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("k")).where("not stays or k > 1"))
    keys = F.col("id").alias("_id"), F.col("g").alias("_g")
    never = cut(gone.where("not stays").select(*keys))
    rest = restrict(docs.select(F.struct("*").alias("_row"), _id().alias("_id"), F.xxhash64("text", F.lit(7)).alias("_g")), never, ["_id", "_g"], "left_anti")
    repeated = cut(gone.where("stays and k > 1").select(*keys))
    if repeated.isEmpty():
        return rest.select("_row.*")
    once = restrict(rest, repeated, ["_id", "_g"]).dropDuplicates(["_id", "_g"])
    return restrict(rest, repeated, ["_id", "_g"], "left_anti").unionByName(once).select("_row.*")
