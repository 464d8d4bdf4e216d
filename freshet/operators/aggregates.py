"""Group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from freshet.functions.nulls import strict_mean, strict_sum


def sum_strict(df: DataFrame, keys: Sequence[str], **named: str) -> DataFrame:
    """Group sums that are null when any input is null: sum_strict(df, keys, total="x")."""
    return df.groupBy(*keys).agg(*[strict_sum(c).alias(n) for n, c in named.items()])


def mean_strict(df: DataFrame, keys: Sequence[str], digits: int | None = None, **named: str) -> DataFrame:
    def one(c: str):
        return strict_mean(c) if digits is None else F.round(strict_mean(c), digits)

    return df.groupBy(*keys).agg(*[one(c).alias(n) for n, c in named.items()])


def counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_share(df: DataFrame, keys: Sequence[str], within: Sequence[str], n: str = "n", total: str = "total_obs", share: str = "share") -> DataFrame:
    """Rows per key, rows per outer key and their ratio. The window runs over the counts only."""
    w = Window.partitionBy(*within)
    return (
        counts(df, keys, n)
        .withColumn(total, F.sum(n).over(w))
        .withColumn(share, F.col(n) / F.col(total))
    )
