"""Simple regressions and correlations, one per group, as ordinary aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.tails import let, student_t_quantile, student_t_two_sided
from freshet.operators.joins import join_matching_nulls
from freshet.operators.moments import correlations


def slope_p_value(r2: Column, n: Column) -> Column:
    """p-value of a simple regression's slope, equally of a correlation with that r squared."""

    def p(fit: Column) -> Column:
        dof = fit["n"] - 2
        t = F.sqrt(dof * fit["r2"] / (F.lit(1.0) - fit["r2"]))
        return F.when((dof < 1) | fit["r2"].isNull(), None).when(fit["r2"] >= 1.0, 0.0).otherwise(student_t_two_sided(t, dof))

    return let(F.struct(r2.alias("r2"), n.alias("n")), p)


def linear_fit(df: DataFrame, y: str, x: str, group: Sequence[str] = ()) -> DataFrame:
    """n, slope, intercept, R squared (plain and adjusted) and p per group; pairs with a missing member are skipped."""
    fit = df.groupBy(*group).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    r2, n = F.col("r2"), F.col("n")
    adjusted = F.when(n > 2, F.lit(1.0) - (F.lit(1.0) - r2) * (n - 1) / (n - 2))
    return fit.withColumn("adj_r2", adjusted).withColumn("p_value", slope_p_value(r2, n))


def fitted_line(df: DataFrame, y: str, x: str, group: Sequence[str] = (), name: str = "fitted") -> DataFrame:
    """The fitted value of every row, from its group's regression."""
    if not group:
        line = linear_fit(df, y, x).select(F.struct("intercept", "slope").alias("s")).scalar()
        return df.withColumn(name, line["intercept"] + line["slope"] * F.col(x))
    fit = linear_fit(df, y, x, group).select(*group, "intercept", "slope")
    joined = join_matching_nulls(df, fit, list(group), "left")
    return joined.withColumn(name, F.col("intercept") + F.col("slope") * F.col(x)).drop("intercept", "slope")


_LINE = ("n_", "slope_", "intercept_", "mid_", "sxx_", "half_")


def _line(df: DataFrame, y: str, x: str, group: Sequence[str], level: float) -> DataFrame:
    """Per group the fitted line, the middle, spread and ends of x, and the half width of the band at a leverage of one."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    fit = df.groupBy(*group).agg(
        F.regr_count(y, x).alias("n_"),
        F.regr_slope(y, x).alias("slope_"),
        F.regr_intercept(y, x).alias("intercept_"),
        F.regr_avgx(y, x).alias("mid_"),
        F.regr_sxx(y, x).alias("sxx_"),
        F.regr_syy(y, x).alias("syy_"),
        F.regr_sxy(y, x).alias("sxy_"),
        F.min(F.when(both, F.col(x))).alias("from_"),
        F.max(F.when(both, F.col(x))).alias("to_"),
    )
    dof = F.col("n_") - 2
    left_over = F.greatest(F.col("syy_") - F.col("sxy_") * F.try_divide("sxy_", "sxx_"), F.lit(0.0))
    half = F.when(dof >= 1, student_t_quantile(level, dof) * F.sqrt(left_over / dof))
    return fit.withColumn("half_", half).select(*group, *_LINE, "from_", "to_")


def _bounds(x: Column) -> dict[str, Column]:
    """Fitted value and bounds; the leverage of a row is 1/n + (x - mean)^2 / sum of squares."""
    away = x - F.col("mid_")
    leverage = F.lit(1.0) / F.col("n_") + F.try_divide(away * away, F.col("sxx_"))
    fitted = F.col("intercept_") + F.col("slope_") * x
    half = F.when(F.col("n_") > 2, F.col("half_") * F.sqrt(leverage))
    return {"fitted": fitted, "lower": fitted - half, "upper": fitted + half}


def fitted_band(df: DataFrame, y: str, x: str, group: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Every row with its group's fitted value and the bounds of the confidence band of the line there.

    One aggregation gives a row per group, which is joined back. Pairs with a missing member do not count for the
    line; a row with a missing x has no value, one with a missing y has. Bounds need three pairs and two places.
    """
    line = _line(df, y, x, group, level)
    if group:
        joined = join_matching_nulls(df, line.drop("from_", "to_"), list(group), "left")
    else:
        one = line.select(F.struct(*_LINE).alias("s")).scalar()
        joined = df.withColumns({c: one[c] for c in _LINE})
    return joined.withColumns(_bounds(F.col(x))).drop(*_LINE)


def band_grid(df: DataFrame, y: str, x: str, group: Sequence[str] = (), level: float = 0.95, points: int = 80) -> DataFrame:
    """The band at evenly spaced places from the smallest to the largest x of each group's pairs, as a figure draws it."""
    each = _line(df, y, x, group, level).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    place = F.col("from_") + (F.col("to_") - F.col("from_")) * F.col("point") / float(points - 1)
    at = each.withColumn(x, place)
    return at.select(*group, "point", x, *[c.alias(n) for n, c in _bounds(F.col(x)).items()])


def correlation(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation with its two-sided p-value."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = both.groupBy(*group).agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("p_value", slope_p_value(F.col("r") * F.col("r"), F.col("n")))


def correlation_ranking(df: DataFrame, cols: Sequence[str], max_p: float = 0.05, top: int = 20) -> DataFrame:
    """The strongest correlations among all pairs of columns: one pass over the data for all of them."""
    ranked = correlations(df, cols)
    ranked = ranked.withColumn("p_value", slope_p_value(F.col("r") * F.col("r"), F.col("n")))
    return ranked.where(F.col("p_value") <= max_p).orderBy(F.abs("r").desc(), "var_a", "var_b").limit(top)
