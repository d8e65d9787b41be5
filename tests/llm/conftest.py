"""Rows with everything that can go wrong: nulls in any column, empty and very long texts, ties, repeats, clashing names."""

import pytest

LONG = " ".join(f"word{i % 997} filler{i}" for i in range(40_000))
PLAIN = "The quick brown fox jumps over the lazy dog near the river bank while the sun sets over distant hills and valleys."

#: doc_id, text, lang, source, n_chars, and columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, n int, keep string, _row int, _key string, _id string, band string, size int, h int, pos int, line string, take int, piece string"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "k", "i", 7, "x", 1, "y", "z", "b", 3, 4, 5, "l", 6, "p")


ROWS = [
    row(1, PLAIN),
    row(2, PLAIN + "\nAll rights reserved.\n" + PLAIN),
    row(3, ""),
    row(4, None),
    row(5, LONG),
    row(6, "   \n\t\n  "),
    row(7, "one line\ntwo line\none line"),
    row(7, "one line\ntwo line\none line"),  # a whole row again
    row(7, "the same doc_id with another text"),
    row(None, "no id at all"),
    row(None, "no id at all"),
    row(None, None, None, None),
    row(8, "null language", None, "a"),
    row(9, "null source", "de", None),
    row(10, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. 你好，世界 🙂", "de", "b"),
    row(11, "!!! ??? ...", "en", "b"),
    row(12, "\x00odd\x0bbytes\r\n", "en", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (5, 1, 0), (7, 0, 1), (7, 1, None), (None, 1, 1), (8, None, None), (10, 1, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
