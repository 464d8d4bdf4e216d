"""Gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.calendar import date_spine
from freshet.functions.nulls import strict_mean
from freshet.operators.ordered import BLOCK_ROWS, on_pieces, running


def _run_length(value: Column, keys: Sequence[str], island: str) -> Column:
    return F.sum(F.when(value.isNull(), 1).otherwise(0)).over(Window.partitionBy(*keys, island))


def carry_forward(df: DataFrame, group: Sequence[str], order: Sequence[str], cols: Sequence[str], max_gap: int, chunk: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repeat the last value over runs of at most ``max_gap`` missing rows."""

    def work(part: DataFrame, keys: Sequence[str], sort: Sequence[str]) -> DataFrame:
        w = running(keys, sort)
        part = part.withColumns(
            {f"_island_{c}": F.count(c).over(w) for c in cols}
            | {f"_last_{c}": F.last(c, ignorenulls=True).over(w) for c in cols}
        )
        for c in cols:
            short = _run_length(F.col(c), keys, f"_island_{c}") <= max_gap
            part = part.withColumn(c, F.when(F.col(c).isNull() & short, F.col(f"_last_{c}")).otherwise(F.col(c)))
        return part.drop(*[f"_{p}_{c}" for p in ("island", "last") for c in cols])

    return on_pieces(df, group, order, max_gap + 1, work, chunk, block_rows)


def interpolate(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, max_gap: int, position: Column, name: str | None = None, chunk: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear in ``position`` between the known neighbours of a run of at most ``max_gap`` missing rows.

    Nothing is filled before the first or after the last known value.
    """

    def work(part: DataFrame, keys: Sequence[str], sort: Sequence[str]) -> DataFrame:
        ahead = running(keys, sort)
        back = (
            Window.partitionBy(*keys)
            .orderBy(*[F.col(c).desc() for c in sort])
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        v = F.col(value)
        known = F.when(v.isNotNull(), F.struct(F.col("_x").alias("x"), v.alias("y")))
        part = part.withColumn("_x", position).withColumns(
            {
                "_island": F.count(v).over(ahead),
                "_p": F.last(known, ignorenulls=True).over(ahead),
            }
        )
        part = part.withColumn("_q", F.last(known, ignorenulls=True).over(back))
        p, q = F.col("_p"), F.col("_q")
        line = p["y"] + (q["y"] - p["y"]) * ((F.col("_x") - p["x"]) / (q["x"] - p["x"]))
        fill = v.isNull() & (_run_length(v, keys, "_island") <= max_gap)
        part = part.withColumn("_filled", F.when(fill, line).otherwise(v))
        return part.drop("_x", "_island", "_p", "_q").withColumn(name or value, F.col("_filled")).drop("_filled")

    return on_pieces(df, group, order, max_gap + 1, work, chunk, block_rows)


def from_second_source(df: DataFrame, second: DataFrame, on: str, value: str, spare: str, default: float | None = None) -> DataFrame:
    """Take missing values from a second source joined on a date key, then from a constant."""
    joined = df.join(second, on, "left").withColumn(value, F.coalesce(value, spare)).drop(spare)
    return joined if default is None else joined.withColumn(value, F.coalesce(value, F.lit(default)))


def by_regression(df: DataFrame, target: str, predictor: str, fit_rows: Column, outage: Column) -> DataFrame:
    """Overwrite ``target`` inside an outage by a line fitted on other rows.

    The model is one row; it enters the plan as a scalar subquery.
    """
    model = (
        df.where(fit_rows)
        .agg(F.struct(F.regr_slope(target, predictor).alias("slope"), F.regr_intercept(target, predictor).alias("intercept")))
        .scalar()
    )
    line = model["slope"] * F.col(predictor) + model["intercept"]
    return df.withColumn(target, F.when(outage, line).otherwise(F.col(target)))


def replace_range(df: DataFrame, date: str, start: str, end: str, **values: Column) -> DataFrame:
    """Delete the rows from start to end and put one row per day in their place."""
    d = F.col(date)
    outside = df.where(~d.between(F.lit(start).cast("date"), F.lit(end).cast("date")) | d.isNull())
    days = date_spine(df.sparkSession, start, end).withColumnRenamed("date", date)
    return outside.unionByName(days.withColumns(values), allowMissingColumns=True)


def by_neighbour_mean(df: DataFrame, date: str, value: str, start: str, end: str, days: int = 5) -> DataFrame:
    """Give every day of an outage the mean over its neighbourhood.

    The neighbourhood reaches ``days`` days beyond both ends and leaves out the
    two end days, which are only partly measured; one missing value in it makes
    the mean missing.
    """
    first, last, d = F.lit(start).cast("date"), F.lit(end).cast("date"), F.col(date)
    around = df.where(d.between(F.date_sub(first, days), F.date_add(last, days)) & (d != first) & (d != last))
    mean = around.agg(strict_mean(value)).scalar()
    return replace_range(df.select(date, value), date, start, end, **{value: mean})
