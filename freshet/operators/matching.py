"""Parts of an ordered group delimited by matching rows.

The delimiting row of each group comes from a grouped minimum or maximum, combined
before the shuffle, and is joined back. No group is gathered in one task, and the join
can be split where one group holds a large share of the rows. Missing group keys form a group.
A group without a match yields no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.operators.joins import join_matching_nulls


def _with_match(df: DataFrame, group: Sequence[str], order: str, condition: Column, pick) -> DataFrame:
    """Rows of the groups that have a match, with its place as ``_at``."""
    return join_matching_nulls(df, df.where(condition).groupBy(*group).agg(pick(order).alias("_at")), group, "inner")


def from_first_match(df: DataFrame, group: Sequence[str], order: str, condition: Column) -> DataFrame:
    """Rows from the first match to the end, the match included."""
    return _with_match(df, group, order, condition, F.min).where(F.col(order) >= F.col("_at")).select(*df.columns)


def up_to_first_match(df: DataFrame, group: Sequence[str], order: str, condition: Column) -> DataFrame:
    """Rows from the start to the first match, the match included."""
    return _with_match(df, group, order, condition, F.min).where(F.col(order) <= F.col("_at")).select(*df.columns)


def from_last_match(df: DataFrame, group: Sequence[str], order: str, condition: Column) -> DataFrame:
    """Rows from the last match to the end, the match included."""
    return _with_match(df, group, order, condition, F.max).where(F.col(order) >= F.col("_at")).select(*df.columns)


def first_match(df: DataFrame, group: Sequence[str], order: str, condition: Column) -> DataFrame:
    """The first matching date of each group."""
    return df.where(condition).groupBy(*group).agg(F.min(order).alias(order))
