"""Comparisons of two sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from freshet.functions.nulls import strict_sum
from freshet.operators.ranking import last_rows
from freshet.operators.reshape import to_wide


def difference(values: DataFrame, keys: Sequence[str], site: str, value: str, pair: tuple[str, str], suffix: str, relative: bool = True) -> DataFrame:
    """Second-minus-first site of a one-row-per-site table, absolute and relative to the first."""
    base, other = pair
    wide = to_wide(values.where(F.col(site).isin(base, other)), keys, site, [base, other], [value], "{level}")
    gap = F.col(other) - F.col(base)
    cols = [gap.alias(f"{other}minus{base}_abs_{suffix}")]
    if relative:
        cols.append(F.try_divide(gap, F.col(base)).alias(f"{other}minus{base}_per_{suffix}"))
    return wide.select(*keys, *cols)


def at_period_end(df: DataFrame, pair: tuple[str, str], suffix: str, value: str = "q_mm_cum") -> DataFrame:
    """Difference of a cumulative value on the last day present in each water year."""
    ends = last_rows(df.where(F.col("site").isNotNull()), ["site", "wyear"], "date", [value])
    return difference(ends, ["wyear"], "site", value, pair, suffix)


def of_totals(df: DataFrame, pair: tuple[str, str], suffix: str, value: str = "q_mm") -> DataFrame:
    """Difference of the totals over the rows given."""
    totals = df.groupBy("site", "wyear").agg(strict_sum(value).alias(value))
    return difference(totals, ["wyear"], "site", value, pair, suffix, relative=False)
