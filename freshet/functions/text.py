"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def last_chars(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def first_number(text: Column) -> Column:
    """The first number inside a string; null if there is none."""
    return F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
