"""JSON as it is: VARIANT values whose type is looked at before they are read, and walks and canonical text of values of any depth.

from_json makes what it finds into what it expects, so a number passes for a
string and a list with one odd element for no list at all. Here a value is read
only as what it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, col


def variant(json_col: Column | str) -> Column:
    """The value of a JSON text; null if it is none, or if an object in it has a key twice."""
    return F.try_parse_json(col(json_col))


def at(v: Column, key: str) -> Column:
    """The value under a key of an object; null if v is no object or has no such key."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def absent(v: Column) -> Column:
    """No value, or JSON's null."""
    return v.isNull() | F.is_variant_null(v)


def string(v: Column) -> Column:
    """The text of a string; null for everything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def no_items() -> Column:
    return F.try_variant_get(F.parse_json(F.lit("[]")), "$", "array<variant>")


def items(v: Column) -> Column:
    """The elements of a list; null for everything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def items_or_none(v: Column) -> Column:
    return F.coalesce(items(v), no_items())


def is_object(v: Column) -> Column:
    return keys(v).isNotNull()


def keys(v: Column) -> Column:
    """The keys of an object; null for everything else."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def spread(df: DataFrame, columns: list, array: Column, name: str, place: str = "_place") -> DataFrame:
    """df's columns with a row for each element of an array, and its place.

    The outer form and a test of the place, as from a plain one a filter on the array is
    inferred and moved below what the array is made of, which is then worked out again for every use in it.
    """
    return df.select(*columns, F.posexplode_outer(array).alias(place, name)).where(F.col(place).isNotNull())


def parsed(text: str | None):
    """A JSON value, or None: null, not JSON, or nested too deeply to read."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def walked(value) -> Iterator[tuple[str, str, object]]:
    """(path, key, value) of each member of each object in a value, in the order of the text. A stack, so depth is no limit."""
    stack: list[tuple[str, str | None, object]] = [("", None, value)]
    while stack:
        path, key, v = stack.pop()
        if key is not None:
            yield path, key, v
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, k, x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((f"{path}[{i}]", None, x) for i, x in reversed(list(enumerate(v))))


_MEMBERS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("key", T.StringType()), T.StructField("empty", T.BooleanType())]))


@F.pandas_udf(_MEMBERS)
def members(text: pd.Series) -> pd.Series:
    """(path, key, empty) of all members of objects at any depth; empty: null, "", [] or {}. No built-in walks without knowing the keys."""
    return text.map(lambda t: [{"path": p, "key": k, "empty": v is None or v == "" or v == [] or v == {}} for p, k, v in walked(parsed(t))])


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """JSON written in one way: keys sorted at every depth, nulls kept, no blanks, numbers at their shortest, characters as they are but for control characters; null if it is no JSON."""

    def of(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if t else None
        except (ValueError, RecursionError):
            return None

    return text.map(of)
