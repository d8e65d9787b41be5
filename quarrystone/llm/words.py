"""Words of many texts at once, as hashes, and sorted numbers in few bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarrystone.llm.common import byte_chunks

#: Bits of a word's hash, and of a pair's.
BITS = 44

#: 0: blank, 1: part of a word, 2: a word of its own.
_KIND = np.full(256, 2, np.uint8)
_KIND[: 33] = 0
_KIND[127] = 0
_KIND[[i for i in range(128) if chr(i).isalnum() or i == 95]] = 1
_KIND[128:] = 1

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _INVERSE)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _P
        x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of two words."""
    with np.errstate(over="ignore"):
        return (mix(u.astype(np.uint64) * _P + w.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


#: What stands before the first word of a text.
BEGIN = 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its hash, its first byte's place in data (less than 2^31, as in an Arrow string array) and its length in
    bytes; and the number of words of each text.

    Words are runs of ASCII letters, digits, "_" and bytes beyond ASCII; other visible characters are words of their own, and so are
    the characters U+3000 to U+9FFF (of scripts without spaces).
    """
    hashes, starts, lengths = [], [], []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for i, j in byte_chunks(offsets):
        x = data[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        kind = _KIND[x]
        begins = kind == 2
        inside = kind == 1
        begins |= inside & np.r_[True, ~inside[:-1]]
        lead = np.flatnonzero((x >= 0xE3) & (x <= 0xE9))
        begins[lead] = True
        after = lead[lead + 3 < len(x)] + 3
        begins[after] |= kind[after] > 0
        edges = bounds[(bounds > 0) & (bounds < len(x))]
        begins[edges] |= kind[edges] > 0
        start = np.flatnonzero(begins)
        if not len(start):
            continue
        power, inverse = _power(len(x))
        with np.errstate(over="ignore"):
            value = (x.astype(np.uint64) + np.uint64(1)) * power[: len(x)]
            value[kind == 0] = 0
            h = mix(np.add.reduceat(value, start) * inverse[start])
        hashes.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        starts.append((start + offsets[i]).astype(np.int32))
        lengths.append(np.add.reduceat(kind > 0, start, dtype=np.int32))
        counts[i:j] = np.diff(np.searchsorted(start, bounds))
    if not hashes:
        none = np.zeros(0, np.int32)
        return none.astype(np.int64), none, none, counts
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(lengths), counts


def before(h: np.ndarray, counts: np.ndarray, begin: int = BEGIN) -> np.ndarray:
    """Of each word (its hash or number) the one before it in its text, or begin."""
    u = np.empty_like(h)
    u[1:] = h[:-1]
    u[(np.cumsum(counts) - counts)[counts > 0]] = begin
    return u


END, EDGE = 0xFE, 0xFF


def spellings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The three-byte codes of words and the place of each word's first code: every byte, and the end, after the two bytes before it."""
    start, size = start.astype(np.int64), length.astype(np.int64) + 1
    first = np.cumsum(size) - size
    o = np.arange(int(size.sum())) - np.repeat(first, size)
    at = np.repeat(start, size) + o
    last = len(data) - 1
    b = np.where(o < np.repeat(length, size), data[np.minimum(at, last)], END).astype(np.int64)
    one = np.where(o > 0, data[np.clip(at - 1, 0, last)], EDGE).astype(np.int64)
    two = np.where(o > 1, data[np.clip(at - 2, 0, last)], EDGE).astype(np.int64)
    return two << 16 | one << 8 | b, first


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: high bytes that are all alike cost nothing."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True) if len(x) else b""


def unpack(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n))


def pack_repeated(x: np.ndarray) -> bytes:
    """Numbers of which many are alike: the different ones, and which of them each is."""
    own, which = np.unique(x, return_inverse=True)
    keys = pack_sorted(own)
    return len(own).to_bytes(8, "little") + len(keys).to_bytes(8, "little") + keys + pack(which)


def unpack_repeated(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    size, at = int.from_bytes(b[:8], "little"), 16 + int.from_bytes(b[8:16], "little")
    return unpack_sorted(b[16:at], size)[unpack(b[at:], n)]
