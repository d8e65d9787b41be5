"""What the training-data operators share: tables, texts as bytes, token lengths and size-checked joins."""

from __future__ import annotations

import base64
import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quarrystone.sources.shared import cut, shared_path

__all__ = ["BROADCAST_ROWS", "CHUNK", "TOKENIZER", "bounded_batches", "byte_chunks", "count_tokens", "cut", "kept", "lean", "n_tokens", "restrict", "shared_path", "spent_shuffles_go", "table", "text_bytes"]

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Rows of ids that a broadcast may hold; beyond it the same join shuffles both sides.
BROADCAST_ROWS = 2_000_000

#: Bytes of an Arrow batch: what a worker holds of its input, whatever the texts' lengths.
BATCH_BYTES = 6 << 20

#: Rows that a task reads from Parquet at once. Spark's 4,096 rows of texts are arrays of tens of MB, doubled again and again, which
#: no young collection of the executor's heap moves, so that the heap grows to its limit.
SCAN_ROWS = 256

#: Bytes of text that a worker handles at once.
CHUNK = 1 << 18


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a table in the shared folder. For loops: its size is that of its files, where a checkpoint
    carries the estimate of the plan it came from, which joins multiply from round to round."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def spent_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """For queries that write a table and are done: inside, their shuffle files go as soon as the table is written. Else these
    stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _give_back() -> None:
    """Freed memory goes back to the system, so that a worker that waits holds little. Nothing happens where libc can't."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(size: str) -> int:
    """A size such as 268435456, 64k, 64KB or 256m."""
    m = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", size.strip().lower())
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ") if m else BATCH_BYTES + 1


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most BATCH_BYTES, and are read from Parquet SCAN_ROWS at a time: the session's settings are
    lowered, never raised, as they are read when a result is computed, after the call that asked for it has returned."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > SCAN_ROWS:
        spark.conf.set(name, str(SCAN_ROWS))


def restrict(df: DataFrame, ids: DataFrame, on: list[str], how: str = "left_semi", n: int | None = None) -> DataFrame:
    """Semi or anti join with a narrow table of ids that is already kept.

    The ids are broadcast only if there are no more than BROADCAST_ROWS of them (a count over a kept table); else both
    sides are shuffled.
    """
    small = (ids.count() if n is None else n) <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, on, how)


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a .tiktoken file, once per Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def forget_encoders() -> None:
    _encoders.clear()
    _give_back()


def count_tokens(texts: Iterable[str | None], path: str) -> list[int]:
    """Exact BPE length of each text; null counts as empty."""
    enc = encoder(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Exact token length as a column; only the text goes to Python and only an integer returns. The encoder and what it
    cached go when a task ends: loading it takes less than 0.1 s, and a worker that waits would hold some 90 MB."""

    @F.pandas_udf(IntegerType())
    def length(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for s in parts:
                yield pd.Series(count_tokens(s, path), dtype="int32")
        finally:
            forget_encoders()

    return length(text)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def byte_chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about so many bytes, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end
