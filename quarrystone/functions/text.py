"""Text functions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PUNCTUATION = r"[!-/:-@\[-`{-~]"

#: Keyword indicators by class, in the order of the feature vector.
INDICATORS = {
    "person": ("mr.", "mrs.", "dr.", "prof.", "king", "queen", "lord"),
    "place": ("city", "country", "street", "river", "mountain", "castle", "london"),
    "organisation": ("company", "corp", "inc.", "university", "institute", "government", "army"),
}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """Words of more than two bytes."""
    return F.filter(words(text), lambda w: F.octet_length(w) > 2)


def text_stats(text: Column) -> dict[str, Column]:
    """Measures between 0 and 1: size in words, characters and sentences, share of distinct words, punctuation, word length."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    n = F.size(w)
    some = F.greatest(n, F.lit(1))
    chars = F.length(text)
    return {
        "word_score": F.least(n / 1000.0, F.lit(1.0)),
        "char_score": F.least(chars / 5000.0, F.lit(1.0)),
        "sentence_score": F.least((chars - F.length(F.replace(text, F.lit("."), F.lit("")))) / 50.0, F.lit(1.0)),
        "diversity": F.size(F.array_distinct(w)) / some,
        "punctuation": F.regexp_count(text, F.lit(PUNCTUATION)) / F.greatest(chars, F.lit(1)),
        "word_length": F.least(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / some / 10.0, F.lit(1.0)),
    }


def indicators(text: Column) -> Column:
    """1.0 or 0.0 for each keyword of INDICATORS, as an array."""
    low = F.lower(text)
    return F.array(*[low.contains(k).cast("double") for keys in INDICATORS.values() for k in keys])


def snippet(text: Column, needle: str, before: int = 50, size: int = 200) -> Column:
    """Text around the first match, with ellipses where it is cut; the beginning if there is no match."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(text, start, F.lit(size))
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start + size - 1 < F.length(text), "...").otherwise(""))


def best_snippet(text: Column, needles: list[str], size: int = 30) -> Column:
    """The run of size words in which the most words have a needle in them, the first of several; null without a word.

    Words are what blanks, tabs and line feeds separate. A running count over the words of each text, in Arrow batches.
    """
    low = [n.lower() for n in needles]

    @F.pandas_udf(StringType())
    def best(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            w = [x for x in t.replace("\n", " ").replace("\t", " ").split(" ") if x] if t else []
            hits = np.cumsum([0, *(any(n in x.lower() for n in low) for x in w)])
            last = max(0, len(w) - size)
            start = int(np.argmax(hits[np.minimum(np.arange(last + 1) + size, len(w))] - hits[: last + 1])) if w else 0
            out.append(" ".join(w[start : start + size]) if w else None)
        return pd.Series(out, dtype=object)

    return best(text)


def number_of(value: Column) -> Column:
    """The number that a text holds; null if it holds none."""
    return F.expr("try_cast(x as double)") if isinstance(value, str) else value.try_cast("double")


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal as numbers if both are numbers, else as texts."""
    x, y = number_of(a), number_of(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.cast("string") == b.cast("string"))
