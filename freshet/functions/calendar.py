"""Water-year calendar, date parsing and date spines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.text import first_number, last_chars

FIRST_MONTH = 10  # a water year runs from 1 October and is named after the year it ends in


def water_year(date: Column) -> Column:
    return F.year(date) + F.when(F.month(date) >= FIRST_MONTH, 1).otherwise(0)


def calendar_year(wyear: Column, month: Column) -> Column:
    return wyear - F.when(month >= FIRST_MONTH, 1).otherwise(0)


def day_of_water_year(date: Column) -> Column:
    """1 on 1 October, counted in calendar days, whatever days a series has."""
    first = F.make_date(water_year(date) - 1, F.lit(FIRST_MONTH), F.lit(1))
    return (F.date_diff(date, first) + 1).cast("long")


def day_month_date(text: Column, wyear: Column) -> Column:
    """Date of a label such as ``1-Oct`` in a water year; null where no such day exists."""
    month = last_chars(text, 3)
    year = wyear - F.when(month.isin("Oct", "Nov", "Dec"), 1).otherwise(0)
    day = first_number(text).cast("int")
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MMM-d")


def parse_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(text, pattern)


def parse_timestamp(text: Column, pattern: str = "M/d/yyyy H:mm") -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


def date_spine(spark: SparkSession, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """One row per day from start to end, both included."""
    days = F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date"))


def position(df: DataFrame, name: str) -> Column:
    """A date (in days), time (in microseconds) or number as a double that keeps its order.

    A time without zone is taken apart rather than cast, so that the result does
    not depend on the session's time zone.
    """
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "timestamp_ntz":
        minutes = F.unix_date(F.to_date(c)).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
        micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return (minutes * 60_000_000 + micros).cast("double")
    return c.cast("double")
