"""Column scaling. Statistics are one aggregate row that enters the plan as a scalar subquery."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from freshet.functions.nulls import weighted


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale each column to 0..1; a constant column becomes missing."""
    s = df.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]
        )
    ).scalar()
    return df.withColumns(
        {c: F.try_divide(F.col(c) - s[f"lo_{c}"], s[f"hi_{c}"] - s[f"lo_{c}"]) for c in cols}
    )


def z_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and divide by the sample standard deviation, over all rows; missing values are skipped."""
    s = df.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in cols], *[F.stddev_samp(c).alias(f"sd_{c}") for c in cols]
        )
    ).scalar()
    return df.withColumns(
        {c: F.try_divide(F.col(c) - s[f"mean_{c}"], s[f"sd_{c}"]) for c in cols}
    )


def scale_by(df: DataFrame, method: str, cols: Sequence[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Scaling by name as in a sweep grid: ``scale`` is the z-score, anything else min-max."""
    scaled = z_scores(df, cols) if method == "scale" else min_max(df, cols)
    return scaled.withColumns(weighted(weights)) if weights else scaled


def weight(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    return df.withColumns(weighted(weights))
