"""Line deduplication: the first occurrence of every line stays.

Lines are hashed in the JVM; Python and the shuffle see 128-bit hashes with (document, position), never text. The hashes
are uniform, so equal ranges of the hash space are balanced ranges: the rows are partitioned by hash range, sorted within
it by (hash, document, position), and one pass over the stream marks the first row of each hash. A line that occurs in
very many documents is thinned before the shuffle: of equal hashes in one Arrow batch only the first can be a first
occurrence. What returns is one compressed bitmap per document, not text: the run lengths of kept and dropped lines,
beginning with kept ("12,1,3": 12 kept, 1 dropped, 3 kept; "0,2": 2 dropped).

Lines are compared without surrounding white space, which is SPACE: blank, tab, line feed, vertical tab, form feed and carriage return.
Lines without any other character always stay: they are structure, not content. Other separators (U+0085, U+2028) are
content: they neither end a line nor make it blank. The first occurrence is the one with the least (doc_id, text hash, position), nulls first.

Defined results: a null text has no lines (n_lines 0, bitmap ""); an empty text has one empty line ("1"). Rows alike in
doc_id and text are one document: one bitmap, which holds for each of them. Rows that share a doc_id but not the text,
and rows with a null doc_id, are told apart by a hash of the text. An empty table gives no rows. Extra columns are ignored,
and kept by `dedup_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrystone.llm.common import cut

#: Bytes of bitmaps that may be broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 64 << 20

SPACE = r"[ \t\n\x0B\f\r]"

ROWS = "h bigint, g bigint, doc bigint, none boolean, key bigint, pos int"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    """What is compared; a line is blank if nothing of it is left."""
    return F.regexp_replace(line, rf"\A{SPACE}+|{SPACE}+\z", "")


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    out = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g")]
    doc = b.column("doc")
    none = np.asarray(doc.is_null())
    return [*out, none, doc.fill_null(0).to_numpy(zero_copy_only=False), b.column("key").to_numpy(zero_copy_only=False), b.column("pos").to_numpy(zero_copy_only=False)]


def _firsts_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal hashes in a batch, the row that comes first."""
    for b in batches:
        if b.num_rows:
            h, g, none, doc, key, pos = _columns(b)
            order = np.lexsort((pos, key, doc, ~none, g, h))
            h, g = h[order], g[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            yield b.take(pa.array(np.sort(order[new])))


def _stream_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that begin a hash, in a stream sorted by hash, document and position."""
    last: tuple[int, int] | None = None
    for b in batches:
        if b.num_rows:
            h, g = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g"))
            new = np.r_[last != (h[0], g[0]), (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            last = (h[-1], g[-1])
            yield b.select(["doc", "key", "pos"]).filter(pa.array(new))


def runs(kept: np.ndarray, n: int) -> str:
    """Run lengths of kept and dropped lines, beginning with kept."""
    keep = np.zeros(n, bool)
    keep[kept] = True
    if not n:
        return ""
    edges = np.flatnonzero(keep[1:] != keep[:-1]) + 1
    lengths = np.diff(np.r_[0, edges, n])
    return ",".join(map(str, [*([] if keep[0] else [0]), *lengths.tolist()]))


def keep_positions(bitmap: str) -> list[int]:
    out, at, keep = [], 0, True
    for n in map(int, filter(None, bitmap.split(","))):
        if keep:
            out += range(at, at + n)
        at, keep = at + n, not keep
    return out


@F.pandas_udf(StringType())
def _bitmap(kept: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([runs(np.asarray(k, np.int64), int(m)) for k, m in zip(kept, n, strict=True)], dtype=object)


def line_bitmaps(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, key (a hash of the text), n_lines, n_kept, keep_bitmap."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64("text").alias("key"), F.col("text").alias("text"))
    each = d.select("doc", "key", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select("doc", "key", "pos", _trimmed(F.col("line")).alias("line"))
    hashed = each.where("line <> ''").select(F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(7)).alias("g"), "doc", "key", "pos")
    # Ranges of equal width over the signed 64-bit hashes: bounds that need no pass over the data.
    at = F.floor((F.shiftright("h", 32).cast("double") + 2147483648.0) / 4294967296.0 * n).cast("int")
    ranged = hashed.mapInArrow(_firsts_of_batch, hashed.schema).withColumn("range", at)
    sorted_ = ranged.repartitionById(n, F.col("range")).sortWithinPartitions("h", "g", "doc", "key", "pos")
    firsts = sorted_.drop("range").mapInArrow(_stream_firsts, "doc bigint, key bigint, pos int")
    # Lines that always stay come straight from the documents, as does the number of lines of each document.
    blank = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.when(_trimmed(x) == "", i)), lambda i: i.isNotNull())
    own = d.select("doc", "key", F.greatest(F.size(_lines(F.col("text"))), F.lit(0)).alias("n"), F.coalesce(blank, F.array().cast("array<int>")).alias("blank"))
    rows = own.select("doc", "key", "n", "blank", F.lit(None).cast("int").alias("pos")).unionByName(firsts.select("doc", "key", F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<int>").alias("blank"), "pos"))
    grouped = rows.groupBy("doc", "key").agg(F.max("n").alias("n"), F.first("blank", ignorenulls=True).alias("blank"), F.collect_list("pos").alias("kept"))
    kept = grouped.select("doc", "key", "n", F.concat("blank", "kept").alias("kept"))
    return kept.select(F.col("doc").alias("doc_id"), "key", F.col("n").alias("n_lines"), F.size("kept").alias("n_kept"), _bitmap("kept", "n").alias("keep_bitmap"))


@F.pandas_udf(StringType())
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    out = []
    for t, b in zip(text, bitmap, strict=True):
        lines = t.split("\n")
        out.append("\n".join([lines[i] for i in keep_positions(b)]))
    return pd.Series(out, dtype=object)


#: Evaluated once for each row: a deterministic UDF would be evaluated again below the filter on its result, with a second
#: Python worker for each task.
_apply_once = _apply.asNondeterministic()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines; a document of which no text is left goes, as does a null text.

    n_chars, if there is such a column, follows the text. Documents that lose nothing don't visit Python.
    """
    changed = cut(line_bitmaps(docs).where("n_kept < n_lines").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("keep_bitmap").alias("_bitmap")))
    size = changed.agg(F.sum(F.length("_bitmap") + 32)).first()[0] or 0
    changed = F.broadcast(changed) if size <= BROADCAST_BYTES else changed.hint("shuffle_hash")
    on = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k"))
    joined = docs.select(F.struct("*").alias("_row"), "doc_id", "text").join(changed, on, "left")
    text = joined.withColumn("_text", F.when(F.col("_bitmap").isNull(), F.col("text")).otherwise(_apply_once(F.coalesce(F.when(F.col("_bitmap").isNotNull(), F.col("text")), F.lit("")), F.coalesce("_bitmap", F.lit("")))))
    named = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return text.where(r"_text rlike '\\S'").select(*[named.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
