"""Sorting, top-k and the first, last or largest row of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.quantiles import value_at_rank


def sort_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by several keys, ``-name`` for descending; missing values come last either way."""
    order = [
        F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys
    ]
    return df.orderBy(*order)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group. Spark cuts each map task to k rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out.withColumn(name, F.col(name).cast("long")) if rank else out.drop(name)


def last_rows(df: DataFrame, group: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """The last row of each group by date, as an aggregate with map-side combining."""
    picked = F.max_by(F.struct(*cols), F.col(order)).alias("_row")
    return df.groupBy(*group).agg(picked).select(*group, *[F.col("_row")[c].alias(c) for c in cols])


def first_rows(df: DataFrame, group: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    picked = F.min_by(F.struct(*cols), F.col(order)).alias("_row")
    return df.groupBy(*group).agg(picked).select(*group, *[F.col("_row")[c].alias(c) for c in cols])


def largest_rows(df: DataFrame, group: Sequence[str], value: str, date: str, cols: Sequence[str], ties: Sequence[Column] = ()) -> DataFrame:
    """The row with the largest value of each group; missing values never win.

    The earliest date wins a tie, then the smallest of ``ties``.
    """
    order = F.struct((-F.col(value)).alias("v"), F.col(date).alias("d"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])
    picked = F.min_by(F.struct(*cols), order).alias("_row")
    present = df.where(F.col(value).isNotNull())
    return present.groupBy(*group).agg(picked).select(*group, *[F.col("_row")[c].alias(c) for c in cols])


def upper_half(df: DataFrame, value: str, unique: str) -> DataFrame:
    """The floor(n/2) rows with the largest value, ties going to the smallest ``unique`` key.

    n counts all rows; rows without a value come last. The cut is found as an order
    statistic, first of the value and then of the key among the rows tied with the
    cut, so nothing is sorted as a whole.
    """
    n, present = df.agg(F.count(F.lit(1)), F.count(value)).first()
    wanted = n // 2
    if not wanted:
        return df.limit(0)
    if wanted > present:  # every row with a value, and some of those without
        above, tied, spare = F.col(value).isNotNull(), F.col(value).isNull(), wanted - present
    else:
        cut = value_at_rank(df, value, lambda m: m - wanted + 1)
        above, tied = F.col(value) > F.lit(cut), F.col(value) == F.lit(cut)
        spare = wanted - df.where(above).count()
    if spare < df.where(tied).count():
        last = value_at_rank(df.where(tied), unique, lambda _: spare) if spare else None
        tied = tied & (F.col(unique) <= F.lit(last)) if spare else F.lit(False)
    return df.where(above | tied)
