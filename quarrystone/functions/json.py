"""JSON functions on text columns: built-ins where Spark has them, Arrow-batched UDFs where it doesn't."""

from __future__ import annotations

import json as _json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

class _Invalid:
    """What a text gives that isn't JSON, or nests deeper than the parser goes: all functions of it are null."""


def _load(s: str | None):
    if s is None:
        return _Invalid
    try:
        return _json.loads(s)
    except (ValueError, RecursionError):
        return _Invalid


def _of(f):
    """f of the parsed value, null where there is none."""

    def run(s: str | None):
        v = _load(s)
        return None if v is _Invalid else f(v)

    return run


def depth_of(v: object) -> int:
    """A scalar has depth 1; a container one more than its deepest member."""
    deepest, stack = 1, [(v, 1)]
    while stack:
        x, d = stack.pop()
        deepest = max(deepest, d)
        if isinstance(x, dict):
            stack += [(y, d + 1) for y in x.values()]
        elif isinstance(x, list):
            stack += [(y, d + 1) for y in x]
    return deepest


def leaves_of(v: object, path: str = "") -> list[tuple[str, str]]:
    """(path, JSON text) of each scalar, in document order; a path is like a.b[0]."""
    out, stack = [], [(path, v)]
    while stack:
        p, x = stack.pop()
        if isinstance(x, dict):
            stack += [(f"{p}.{k}" if p else k, y) for k, y in reversed(list(x.items()))]
        elif isinstance(x, list):
            stack += [(f"{p}[{i}]", y) for i, y in reversed(list(enumerate(x)))]
        else:
            out.append((p, _json.dumps(x, ensure_ascii=False)))
    return out


def sort_key_of(v: object) -> str:
    """A text whose order is: null, false, true, numbers, texts, arrays, objects; containers by length, then by content."""
    out: list[str] = []
    stack: list[object] = [v]  # a tuple is text that is done
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif x is None:
            out.append("0")
        elif isinstance(x, bool):
            out.append(f"1{int(x)}")
        elif isinstance(x, int | float):
            out.append("2" + _number_key(x))
        elif isinstance(x, str):
            out.append(_text_key(x))
        elif isinstance(x, list):
            stack += [*reversed(x), (f"4{len(x):08x}",)]
        else:
            for k in sorted(x, reverse=True):
                stack += [x[k], (_text_key(k),)]
            stack.append((f"5{len(x):08x}",))
    return "".join(out)


def _text_key(s: str) -> str:
    return "3" + "".join(f"{ord(c):06x}" for c in s) + "\x01"


def _number_key(x: float) -> str:
    """Sixteen digits in the order of the numbers; whole numbers beyond the range of a double are at its ends."""
    try:
        d = float(x)
    except OverflowError:
        d = float("inf") if x > 0 else float("-inf")
    bits = int.from_bytes(struct.pack(">d", d + 0.0), "big")
    return f"{bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63:016x}"


@F.pandas_udf(IntegerType())
def _depth(s: pd.Series) -> pd.Series:
    return s.map(_of(depth_of)).astype("Int32")


@F.pandas_udf(StringType())
def _sort_key(s: pd.Series) -> pd.Series:
    return s.map(_of(sort_key_of))


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
def _leaves(s: pd.Series) -> pd.Series:
    return s.map(_of(lambda v: [{"path": p, "value": x} for p, x in leaves_of(v)]))


@F.pandas_udf(BooleanType())
def _valid(s: pd.Series) -> pd.Series:
    def ok(x: str | None) -> bool | None:
        return None if x is None else _load(x) is not _Invalid

    return s.map(ok)


def json_depth(c: Column) -> Column:
    return _depth(c)


def json_exceeds_depth(c: Column, limit: int) -> Column:
    return _depth(c) > limit


def json_leaves(c: Column) -> Column:
    """Array of (path, value)."""
    return _leaves(c)


def json_paths(c: Column) -> Column:
    return F.transform(_leaves(c), lambda x: x.path)


def json_sort_key(c: Column) -> Column:
    return _sort_key(c)


def json_is_valid(c: Column) -> Column:
    return _valid(c)


def json_extract(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json_contains(c: Column, value: str) -> Column:
    """Whether a JSON array of texts holds the value."""
    return F.array_contains(F.from_json(c, "array<string>"), value)


def json_length(c: Column) -> Column:
    """Members of an array or an object; 1 for a scalar."""
    return F.coalesce(F.json_array_length(c), F.size(F.json_object_keys(c)), F.lit(1))


def json_set(c: Column, key: str, value: Column) -> Column:
    """An object of texts with one member replaced or added."""
    old = F.from_json(c, "map<string,string>")
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string"))))


def json_append(c: Column, value: Column) -> Column:
    """An array of texts with one member more."""
    return F.to_json(F.array_append(F.from_json(c, "array<string>"), value.cast("string")))


def json_object(**members: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]))
