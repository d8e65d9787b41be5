"""Deterministic sharded WARC writer.

Records are sorted by (url, page_id) and cut into ranges of about SHARD_BYTES, at most MAX_SHARDS of them, whose bounds depend on the
records alone, never on their layout: a sample by hash of the sort key, about SAMPLE_KEYS keys (all of a small table), is sorted and cut
into equal bytes. So what reaches the driver is bounded, and larger tables have longer ranges. Within a range files roll before
their compressed size would pass FILE_BYTES; each record is a gzip member of its own, so a record can be read at its offset. Headers are
made anew from the record: the date is a parameter, the record id comes from a hash of url, page_id and payload, the digests are SHA-1 of
the payload and of the block. The same records give the same bytes in the same files.

Commit: a task writes files under temporary names of its attempt, with a row per record. The rows that Spark accepted are
written as the manifest, still below the temporary folder; a task that ran twice left files that no row names. Then the files that
this manifest names are renamed to their final names, by tasks again, a rename whose work is already done being none; then the
manifest gets its final name, the marker _COMMITTED is written and the temporary folder removed. So whatever a crash leaves is
explained by a manifest in the temporary folder, or not visible at all. A reader trusts only files named in the manifest
of a folder with the marker. A target that holds anything, but for the temporary folder of an attempt that failed, is refused.

Defined results: a null html is an empty payload, a null url is written as "urn:page:" with the page_id, a null page_id as "null"; nulls
come first. Line breaks and other control characters in a url are percent-escaped in the header. Rows that repeat are written each, with the same
record id and an ordinal that tells them apart. A record larger than FILE_BYTES has a file of its own. An empty table gives a
committed folder without files, and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import cut, shared_path

FILE_BYTES = 64 << 20

#: Uncompressed bytes that a range has, about.
SHARD_BYTES = 64 << 20

#: Ranges at most; beyond it they grow, and roll more files.
MAX_SHARDS = 10_000

#: Sort keys that the driver sorts, about.
SAMPLE_KEYS = 1 << 18

DATE = "2024-01-01T00:00:00Z"

LEVEL = 6

SCHEMA = "page_id bigint, url string, shard int, ordinal int, attempt string, file string, offset bigint, length bigint, record_id string, payload_digest string"


def target(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{'null' if page_id is None else page_id}"
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def _digest(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def record(url: str | None, page_id: int | None, html: str | None, date: str = DATE) -> tuple[bytes, str, str]:
    """An uncompressed response record, its id and the digest of its payload."""
    payload = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    to = target(url, page_id)
    name = uuid.UUID(bytes=hashlib.sha256(f"{to}\n{page_id}\n".encode() + payload).digest()[:16], version=4)
    digest = _digest(payload)
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {to}\r\n"
        f"WARC-Payload-Digest: {digest}\r\nWARC-Block-Digest: {_digest(block)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n", str(name), digest


def info(file: str, date: str = DATE) -> bytes:
    """The warcinfo record that begins a file."""
    body = b"software: quarrystone\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.UUID(bytes=hashlib.sha256(file.encode() + date.encode()).digest()[:16], version=4)
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {file}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def member(b: bytes) -> bytes:
    """A gzip member without time or name, the same on every machine."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = c.compress(b) + c.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(b).to_bytes(4, "little") + (len(b) & 0xFFFFFFFF).to_bytes(4, "little")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _write(path: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        attempt = uuid.uuid4().hex
        shard, number, out, file, offset, ordinal = None, 0, None, "", 0, 0

        def begin() -> None:
            nonlocal out, file, offset
            if out is not None:
                out.close()
            file = f"part-{shard:06d}-{number:05d}.warc.gz"
            files.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
            out = files.open_output_stream(f"{root}/_temporary/{attempt}/{file}", compression=None)
            first = member(info(file, date))
            out.write(first)
            offset = len(first)

        for b in batches:
            rows = []
            for s, page_id, url, html in zip(*(b.column(c) for c in ("shard", "page_id", "url", "html")), strict=True):
                s, page_id, url = s.as_py(), page_id.as_py(), url.as_py()
                raw, name, digest = record(url, page_id, html.as_py(), date)
                packed = member(raw)
                if s != shard:
                    shard, number, ordinal = s, 0, 0
                    begin()
                elif offset + len(packed) > file_bytes:
                    number += 1
                    begin()
                out.write(packed)
                rows.append((page_id, url, shard, ordinal, attempt, file, offset, len(packed), name, digest))
                offset += len(packed)
                ordinal += 1
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
        if out is not None:
            out.close()

    return run


def _rename(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        for b in batches:
            for attempt, file in zip(b.column("attempt").to_pylist(), b.column("file").to_pylist(), strict=True):
                source, goal = f"{root}/_temporary/{attempt}/{file}", f"{root}/{file}"
                if files.get_file_info(source).type == fs.FileType.File:
                    files.move(source, goal)
                elif files.get_file_info(goal).type != fs.FileType.File:
                    raise FileNotFoundError(source)
            yield b.select(["file"])

    return run


def _bounds(pages: DataFrame, shards: int, n: int, sample_keys: int = SAMPLE_KEYS) -> list[tuple]:
    """Sort keys that cut the records into ranges of about equal bytes, from a sample that the keys' own hashes choose."""
    if shards < 2:
        return []
    every = max(1, n // sample_keys)
    chosen = pages.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(every)) == 0)
    # Records of one key are one row, however many they are.
    keys = chosen.groupBy("url", "page_id").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 400).alias("size")).toArrow()
    rows = sorted(((u is not None, (u or "").encode(), p is not None, p or 0, n) for u, p, n in zip(*(keys.column(c).to_pylist() for c in ("url", "page_id", "size")), strict=True)))
    total, at, out = sum(r[4] for r in rows), 0, []
    for r in rows:
        if at >= total * (len(out) + 1) / shards and len(out) < shards - 1 and at:
            out.append((r[0], r[1].decode(), r[2], r[3]))
        at += r[4]
    return out


def _assign(bounds: list[tuple]):
    """The shard of each record, by binary search in the bounds."""
    import bisect

    order = [(u, k.encode(), p, i) for u, k, p, i in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = []
            for url, page_id in zip(b.column("url").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                shard.append(bisect.bisect_right(order, (url is not None, (url or "").encode(), page_id is not None, page_id or 0)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], names=[*b.schema.names, "shard"])

    return run


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE, sample_keys: int = SAMPLE_KEYS) -> DataFrame:
    """Writes the pages below path, a new or empty folder (else FileExistsError), and returns the manifest: one row per record, read from the committed folder."""
    spark = pages.sparkSession
    p = pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    size = p.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    shards = min(MAX_SHARDS, max(1, -(-(size[1] or 0) // shard_bytes)))
    files, root = _open(path)
    files.create_dir(root, recursive=True)
    for x in files.get_file_info(fs.FileSelector(root)):
        if x.base_name != "_temporary":
            raise FileExistsError(f"{path} isn't empty: {x.base_name}")
    if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:  # of an attempt that failed
        files.delete_dir(f"{root}/_temporary")
    placed = p.mapInArrow(_assign(_bounds(p, shards, size[0], sample_keys)), "page_id bigint, url string, html string, shard int")
    parts = max(shards, 1)
    sorted_ = placed.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", F.col("url").asc_nulls_first(), F.col("page_id").asc_nulls_first(), F.xxhash64("html"), "html")
    rows = cut(sorted_.mapInArrow(_write(path, file_bytes, date), SCHEMA))
    rows.write.parquet(f"{path}/_temporary/_manifest")
    named = spark.read.schema(rows.schema).parquet(f"{path}/_temporary/_manifest")
    moved = named.select("attempt", "file").distinct().mapInArrow(_rename(path), "file string").count()
    files.move(f"{root}/_temporary/_manifest", f"{root}/_manifest")
    with files.open_output_stream(f"{root}/_COMMITTED", compression=None) as f:
        f.write(f"{moved} files, {size[0]} records\n".encode())
    if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        files.delete_dir(f"{root}/_temporary")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    files, root = _open(path)
    if files.get_file_info(f"{root}/_COMMITTED").type != fs.FileType.File:
        raise FileNotFoundError(f"{path} isn't committed")
    return spark.read.schema(SCHEMA).parquet(f"{path}/_manifest").drop("attempt")


def read_records(path: str, file: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and payload of the response records of a file; digests and lengths are checked."""
    files, root = _open(path)
    with files.open_input_stream(f"{root}/{file}", compression=None) as f:
        data = gzip.decompress(f.read())
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        if data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record isn't closed")
        if head["WARC-Type"] == "response":
            payload = block.split(b"\r\n\r\n", 1)[1]
            if head["WARC-Block-Digest"] != _digest(block) or head["WARC-Payload-Digest"] != _digest(payload):
                raise ValueError("a digest differs")
            out.append((head, payload))
    return out


def write_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The manifest of all pages, written to a folder of its own in the shared folder."""
    return write_warc(pages, shared_path(spark, "warc"))
