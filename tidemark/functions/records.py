"""Columns of records: numbers and texts as JSON takes them, and lists without repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_number(x: Column) -> Column:
    """Text of a number for JSON, which has no form of its own for NaN and the infinities; NULL stays NULL."""
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(x.cast("string"))


def plain(x: Column) -> Column:
    """A number with NaN as NULL."""
    return F.when(~F.isnan(x), x)


def json_constants(text: Column) -> Column:
    """The constants NaN, Infinity and -Infinity that a JSON text has outside its strings, which strict JSON refuses."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    return F.regexp_extract_all(bare, F.lit(r"(-?Infinity|NaN)"), 1)


def ordered_distinct(values: Column) -> Column:
    """The array without later repeats, in its order; NULLs count as equal."""
    return F.array_distinct(values)


def required_and_more(required: list[str], more: Column) -> Column:
    """The required values and then the others, each once, in order; a NULL array adds none."""
    return F.array_distinct(F.concat(F.array(*map(F.lit, required)), F.coalesce(more, F.array().cast("array<string>"))))
