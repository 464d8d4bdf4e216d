"""Equi-joins with explicit keys and missing-key semantics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_matching_nulls(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "full") -> DataFrame:
    """Equi-join in which a missing key matches a missing key.

    Null-safe equality is still an equi-join key for Spark, so this shuffles on
    the keys like an ordinary join.
    """
    l, r = left.alias("l"), right.alias("r")
    condition = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on])
    keys = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in on]
    rest = [F.col(f"l.{c}") for c in left.columns if c not in on]
    rest += [F.col(f"r.{c}") for c in right.columns if c not in on]
    return l.join(r, condition, how).select(*keys, *rest)


def full_chain(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of any number of tables that are each unique on the key.

    A union followed by one aggregation: one shuffle with map-side combining
    instead of a chain of outer joins. Missing keys form one group, so they
    match each other. A table that repeats a key is an error when the result is read.
    """
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in stacked.columns if c not in on and c != "_source"]
    most = [F.count(F.when(F.col("_source") == i, 1)) for i in range(len(frames))]
    repeated = F.greatest(*most) if len(most) > 1 else most[0]
    joined = stacked.groupBy(*on).agg(*[F.max(c).alias(c) for c in rest], repeated.alias("_rows"))
    # the check is part of a column that is read, or the optimizer would leave it out
    wrong = F.raise_error(F.lit("full_chain: a table has more than one row for a key"))
    return joined.where(F.when(F.col("_rows") <= 1, F.lit(True)).otherwise(wrong.cast("boolean"))).drop("_rows")


def join_months(daily: DataFrame, monthly: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach a table with one row per month to daily rows; Spark broadcasts it if it is small."""
    return daily.join(monthly, list(on), "left")
