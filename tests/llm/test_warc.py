"""WARC writer: exact round trips, the same bytes for any layout, and commits that failed attempts don't reach."""

import glob
import gzip
import hashlib
import os

import pytest

from quarrystone.llm import queries, warc

SCHEMA = "page_id long, url string, html string, shard string, file string"
PAGES = [
    (2, "http://b/", "<p>b</p>", "s", "f"),
    (1, "http://a/", "<p>a</p>", "s", "f"),
    (1, "http://a/", "<p>a</p>", "s", "f"),
    (3, None, "no url", "s", "f"),
    (None, "http://c/", None, "s", "f"),
    (4, "http://d/ x\r\nEvil: 1", "", "s", "f"),
    (None, None, None, None, None),
    (5, "http://e/é你", "x" * 300_000, "s", "f"),
]


def files(path):
    return {os.path.basename(f): hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/*.warc.gz")}


def read(path):
    return sorted((h["WARC-Target-URI"], p.decode()) for f in files(path) for h, p in warc.read_records(path, f))


def test_round_trip_of_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    out = []
    for name, p in (("a", pages), ("b", pages.repartition(5))):
        path = str(tmp_path / name)
        m = warc.write_warc(p, path, file_bytes=2_000, shard_bytes=100_000).collect()
        assert len(m) == len(PAGES)
        assert read(path) == sorted((warc.target(u, i), h or "") for i, u, h, _, _ in PAGES)
        assert not os.path.exists(f"{path}/_temporary")
        for r in m:
            with open(f"{path}/{r['file']}", "rb") as f:
                f.seek(r["offset"])
                assert r["record_id"].encode() in gzip.decompress(f.read(r["length"]))
        out.append(files(path))
    assert out[0] == out[1]
    assert len(out[0]) > 1


def test_attempts_that_failed_stay_out(spark, tmp_path):
    path = str(tmp_path / "w")
    os.makedirs(f"{path}/_temporary/dead")
    with open(f"{path}/_temporary/dead/part-000000-00000.warc.gz", "wb") as f:
        f.write(b"half")
    with pytest.raises(FileNotFoundError):
        warc.read_manifest(spark, path)
    warc.write_warc(spark.createDataFrame(PAGES, SCHEMA), path)
    assert len(read(path)) == len(PAGES)
    # A rename that ran before is none.
    rows = spark.createDataFrame([("gone", f) for f in files(path)], "attempt string, file string")
    assert rows.mapInArrow(warc._rename(path), "file string").count() == len(files(path))


def test_used_folders_are_refused(spark, tmp_path):
    """Neither a committed folder nor one with other files is written to, and nothing in it changes."""
    pages = spark.createDataFrame(PAGES, SCHEMA)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    before = files(path)
    with pytest.raises(FileExistsError):
        warc.write_warc(pages.limit(2), path)
    assert files(path) == before and warc.read_manifest(spark, path).count() == len(PAGES)
    os.makedirs(tmp_path / "x")
    (tmp_path / "x" / "part-000000-00000.warc.gz").write_bytes(b"other")
    with pytest.raises(FileExistsError):
        warc.write_warc(pages, str(tmp_path / "x"))


def test_a_crash_between_the_renames_stays_explained(spark, tmp_path, monkeypatch):
    """Until the marker is there a reader gets nothing, and the manifest of what was renamed lies in the temporary folder."""
    pages = spark.createDataFrame(PAGES, SCHEMA)
    path = str(tmp_path / "w")

    def broken(path):
        def run(batches):
            raise OSError("lost")
            yield

        return run

    with monkeypatch.context() as m:
        m.setattr(warc, "_rename", broken)
        with pytest.raises(Exception, match="lost"):
            warc.write_warc(pages, path)
    with pytest.raises(FileNotFoundError):
        warc.read_manifest(spark, path)
    assert spark.read.parquet(f"{path}/_temporary/_manifest").count() == len(PAGES)
    warc.write_warc(pages, path)
    assert len(read(path)) == len(PAGES)


def test_bounds_cut_equal_bytes(spark):
    """Also where sizes differ a lot, one key has a third of all records, and only a sample is sorted."""
    rows = [(i if i % 3 else 0, f"http://{i % 97:03d}/" if i % 3 else "http://050/", "x" * (5_000 if i % 97 > 90 else 50)) for i in range(3_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    exact = warc._bounds(pages, 8, len(rows))
    assert exact == warc._bounds(pages.repartition(7), 8, len(rows)) and exact == sorted(exact)
    assert len(set(exact)) == len(exact)
    keys = sorted(((True, r[1], True, r[0]), len(r[2]) + 400) for r in rows)
    import bisect

    load = [0] * (len(exact) + 1)
    for k, n in keys:
        load[bisect.bisect_right(exact, k)] += n
    one = sum(n for k, n in keys if k[1] == "http://050/" and k[3] == 0)
    assert max(load) <= max(one, sum(load) / 8) + sum(load) / 8
    assert len(warc._bounds(pages, 8, len(rows), 100)) <= 7


def test_nothing(spark, tmp_path):
    assert warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "e")).count() == 0


def test_query(spark, sf):
    m = queries.QUERIES["op3_warc"](spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert m.count() == pages.count()
    path = m.inputFiles()[0].split("/_manifest")[0].replace("file://", "")
    assert read(path) == sorted((warc.target(r["url"], r["page_id"]), r["html"]) for r in pages.collect())
    order = m.orderBy("shard", "ordinal").select("url", "page_id").collect()
    assert order == sorted(order)
