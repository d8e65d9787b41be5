"""Packing documents into fixed-length training sequences: shortest-pack-first over the length histogram.

The histogram has at most `capacity` rows whatever the corpus is, so the packing itself runs on the driver over counts:
lengths are placed longest first, each time into the packs with the most room left, and what changes is how many packs
follow a pattern of lengths, never single documents. Documents meet their packs by rank: the i-th document of a length
takes the i-th place that the patterns have for it.

Defined results: a document longer than `capacity` is cut into full pieces and a rest (piece 0, 1, ...), so no token is
lost. A null or empty text has no tokens: one row with n_tokens 0 and null pack_id, slot and pack_offset. Rows that
repeat are packed as often as they occur; rows with a null doc_id are packed like any other. Documents of one length are
ranked by a hash of doc_id, text and piece, whatever their number; equal hashes by doc_id and piece. An empty table gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import TOKENIZER, cut, n_tokens

CAPACITY = 4096

#: Rows that one window partition ranks; a length with more documents is ranked in ranges of the hash, which gives the same ranks.
RANK_ROWS = 1_000_000

#: Segments that go to the workers as a table to search; beyond it they are joined.
SEARCH_ROWS = 2_000_000

SCHEMA = "doc_id bigint, piece int, n_tokens int, pack_id bigint, slot int, pack_offset int"


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many packs follow each.

    `open_` has, by room left, the patterns that may still grow. Packs with the most room are the shortest ones: if even
    these can't take a length, no pack can.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], packs: int, room: int) -> None:
        if room == 0:
            done.append((pattern, packs))
            return
        if room not in open_:
            open_[room] = []
            heapq.heappush(rooms, -room)
        open_[room].append((pattern, packs))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"length {length} is over the capacity {capacity}")
        left = histogram[length]
        while left > 0:
            if not rooms or -rooms[0] < length:
                # Of the new packs each is filled before the next one is opened: it is the only one with room.
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put((length,) * each, full, capacity - each * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                break
            room = -rooms[0]
            pattern, packs = open_[room].pop()
            if not open_[room]:
                del open_[room]
                heapq.heappop(rooms)
            take = min(packs, left)
            if packs > take:
                put(pattern, packs - take, room)
            put((*pattern, length), take, room - length)
            left -= take
    for room in sorted(open_):
        done += open_[room]
    return done


def segments(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, count, first pack, slot, offset), by length and first rank.

    Places of one length follow each other in the order of the patterns.
    """
    used: dict[int, int] = {}
    rows = []
    pack = 0
    for lengths, packs in patterns:
        offset = 0
        for slot, n in enumerate(lengths):
            rank = used.get(n, 0)
            rows.append((n, rank, packs, pack, slot, offset))
            used[n] = rank + packs
            offset += n
        pack += packs
    out = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _place(places: np.ndarray):
    keys = (places[:, 0] << 44) | places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            p = places[np.searchsorted(keys, (n << 44) | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("n_tokens"), pa.array(p[:, 3] + rank - p[:, 1]), pa.array(p[:, 4].astype(np.int32)), pa.array(p[:, 5].astype(np.int32))],
                names=["doc_id", "piece", "n_tokens", "pack_id", "slot", "pack_offset"],
            )

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, rank_rows: int = RANK_ROWS, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, pack_id, slot in the pack and offset of its first token."""
    spark = docs.sparkSession
    lengths = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), n_tokens(F.col("text"), tokenizer).alias("n")))
    full = F.floor(F.col("n") / capacity).cast("int")
    pieces = lengths.where("n > 0").select(
        "doc_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece"), "n"
    ).select("doc_id", "piece", F.when(F.col("piece") < full, capacity).otherwise(F.col("n") % capacity).cast("int").alias("n_tokens"), F.xxhash64("doc_id", "t", "piece").alias("h"))
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # capacity rows at most
    places = segments(pack_histogram(histogram, capacity))
    # Ranks: the hashes of a length with many documents are cut into equal ranges, whose first ranks come from their counts.
    ranges = [(n, -(-c // rank_rows)) for n, c in histogram.items() if c > rank_rows]
    if ranges:
        many = F.broadcast(spark.createDataFrame(ranges, "n_tokens int, k int"))  # capacity rows at most
        share = (F.shiftright("h", 32).cast("double") + 2147483648.0) / 4294967296.0
        pieces = pieces.join(many, "n_tokens", "left").withColumn("bucket", F.coalesce(F.floor(share * F.col("k")).cast("int"), F.lit(0)))
        counts = cut(pieces.where("k is not null").groupBy("n_tokens", "bucket").count())
        before = F.sum("count").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        base = counts.select("n_tokens", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
        small = len(histogram) + sum(histogram.values()) // rank_rows <= search_rows
        pieces = pieces.join(F.broadcast(base) if small else base, ["n_tokens", "bucket"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    else:
        pieces = pieces.withColumn("bucket", F.lit(0)).withColumn("base", F.lit(0).cast("bigint"))
    w = Window.partitionBy("n_tokens", "bucket").orderBy("h", "doc_id", "piece")
    ranked = pieces.select("doc_id", "piece", "n_tokens", (F.row_number().over(w) - 1 + F.col("base")).cast("bigint").alias("rank"))
    if len(places) <= search_rows:
        placed = ranked.mapInArrow(_place(places), SCHEMA)
    else:
        names = ["n", "first", "packs", "pack", "slot", "offset"]
        seg = spark.createDataFrame([tuple(map(int, r)) for r in places], ", ".join(f"`{c}` bigint" for c in names))
        placed = ranked.join(seg, (ranked["n_tokens"] == seg["n"]) & (ranked["rank"] >= seg["first"]) & (ranked["rank"] < seg["first"] + seg["packs"])).select(
            "doc_id", "piece", "n_tokens", (F.col("pack") + F.col("rank") - F.col("first")).alias("pack_id"), F.col("slot").cast("int").alias("slot"), F.col("offset").cast("int").alias("pack_offset")
        )
    none = F.lit(None)
    empty = lengths.where("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), none.cast("bigint").alias("pack_id"), none.cast("int").alias("slot"), none.cast("int").alias("pack_offset"))
    return placed.unionByName(empty)
