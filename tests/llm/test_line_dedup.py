"""Line dedup against brute force; op4's SQL over the given tables."""

from quarrystone.llm import line_dedup, queries
from tests.oracle import assert_same, connect


def text_key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


def test_against_sql(spark, sf):
    assert_same(queries.QUERIES["op4_line_dedup"](spark, sf), connect(sf), queries.ORACLES["op4_line_dedup"])


def test_runs_and_positions():
    import numpy as np

    for n in range(6):
        for mask in range(1 << n):
            kept = [i for i in range(n) if mask >> i & 1]
            assert line_dedup.keep_positions(line_dedup.runs(np.array(kept, int), n)) == kept


def test_odd_rows(odd):
    got = {(r["doc_id"], r["n_lines"], r["keep_bitmap"]) for r in line_dedup.line_bitmaps(odd).collect()}
    assert (4, 0, "") in got and (3, 1, "1") in got
    assert (7, 3, "2,1") in got and (7, 1, "1") in got
    assert (2, 3, "0,1,1,1") in got  # the first line is document 1's, the third too
    assert (6, 3, "3") in got
    assert len(got) == len({(r["doc_id"], r["text"]) for r in odd.collect()})


def test_first_line_of_ties_goes_to_the_least_document(spark):
    d = spark.createDataFrame([(3, "a\nb"), (2, "b\na\n a "), (None, "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_bitmap"] for r in line_dedup.line_bitmaps(d.repartition(3)).collect()}
    assert got == {None: "1", 2: "0,1,1,1", 3: "0,2"}


def test_documents_without_repeated_lines(odd):
    rows = line_dedup.dedup_lines(odd).collect()
    texts = {(r["doc_id"], r["text"]) for r in rows}
    assert (7, "one line\ntwo line") in texts
    assert (2, "All rights reserved.") in texts
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any(r["doc_id"] in (3, 4, 6) for r in rows)
    assert all((r["key"], r["line"], r["_row"], r["pos"]) == ("k", "l", 1, 5) for r in rows)
    again = line_dedup.dedup_lines(odd.sparkSession.createDataFrame(rows, odd.schema)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_hot_line_over_batches(spark):
    """A line in very many documents has one first occurrence."""
    d = spark.range(30_000).selectExpr("id as doc_id", "concat('shared line\n', id) as text").repartition(7)
    rows = line_dedup.line_bitmaps(d).where("n_kept = 2").collect()
    assert [r["doc_id"] for r in rows] == [0]


def test_one_definition_of_blank(spark, tmp_path):
    """Separators beyond ASCII and lines of odd white space, against the SQL."""
    texts = ["same\n\u0085", "same\n\u0085", "\u2028\nsame", "a \u0085\na\u0085", "\x0b\nsame \x0b", "\x0b\n\t\r\n\f", "\u00a0same\nsame\u2028", "x\r\nx\n\u2029", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    import glob
    import os

    os.rename(glob.glob(f"{tmp_path}/d/*.parquet")[0], f"{tmp_path}/documents.parquet")
    assert_same(queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)), connect(str(tmp_path)), queries.ORACLES["op4_line_dedup"])
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in line_dedup.line_bitmaps(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert got[0] == (2, 2) and got[1] == (2, 0) and all(k <= n for n, k in got.values())
    rest = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert rest[0] == "same\n\u0085" and 1 not in rest


def test_nothing(empty):
    assert line_dedup.line_bitmaps(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
