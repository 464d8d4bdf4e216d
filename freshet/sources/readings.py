"""The logical inputs, mapped onto the star-schema tables.

Each function aggregates a whole fact table to the grain of the analysis (a day,
a month) with map-side combining; everything downstream works on that grain. A plan of
several series passes ``days``, a written ``line_days`` or ``order_days``, so that a fact table is read once.
Sums run over decimals or whole numbers so that they do not depend on the order
in which partial results arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.calendar import calendar_year, water_year

SITES = ("RB", "WB")  # the paired watersheds: the base and the other one
OUTAGE = ("1998-03-11", "1998-03-25")  # first and last day of the logger outage
LAST_MEAN_TEMP = "1998-12-31"  # the airport reports daily means up to here
END_OF_RECORD = "2001-09-30"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(c: str) -> Column:
    """An amount with cents as a decimal, for exact sums."""
    return F.col(c).cast("decimal(18,2)")


def line_days(spark: SparkSession, folder: str) -> DataFrame:
    """One row per flag and day of the line items with all that any daily series needs: one pass over the fact table.

    A series that reads a few of its columns and flags makes Spark compute and scan those only.
    """
    cents = F.round(F.col("l_discount") * 100)
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag", F.to_date("l_shipdate").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").alias("quantity"),
            F.count("l_quantity").alias("n_quantity"),
            F.sum(money("l_tax")).alias("tax"),
            F.min(cents).alias("cents_min"),
            F.max(cents).alias("cents_max"),
            F.sum(cents).alias("cents"),
            F.count(cents).alias("n_cents"),
        )
    )


def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """One row per day of the orders with all that any daily or monthly series needs: one pass over the fact table."""
    by = lambda p: F.count(F.when(F.col("o_orderpriority") == p, 1))
    daily = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
    return daily.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(money("o_totalprice")).alias("price"),
        by("1-URGENT").alias("urgent"),
        by("2-HIGH").alias("high"),
        by("5-LOW").alias("low"),
    )


def runoff(spark: SparkSession, folder: str, days: DataFrame | None = None) -> DataFrame:
    """site, date, q_mm: daily runoff of both watersheds."""
    lines = days or line_days(spark, folder)
    site = F.when(F.col("l_returnflag") == "A", "WB").otherwise("RB").alias("site")
    return lines.where(F.col("l_returnflag").isin("A", "R")).select(site, "date", F.col("quantity").alias("q_mm"))


def runoff_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Daily runoff with a missing value on 25 April of every year."""
    gap = (F.month("date") == 4) & (F.dayofmonth("date") == 25)
    return runoff(spark, folder).withColumn("q_mm", F.when(~gap, F.col("q_mm")))


def precipitation(spark: SparkSession, folder: str, days: DataFrame | None = None) -> DataFrame:
    """date, precip_mm: daily totals, missing on the 10th to 14th of each month."""
    kept = ~F.dayofmonth("date").between(10, 14)
    total = days or order_days(spark, folder)
    return total.select("date", F.when(kept, F.col("price").cast("double") / 10000.0).alias("precip_mm"))


def precipitation_spare(spark: SparkSession, folder: str, days: DataFrame | None = None) -> DataFrame:
    """date, precip_mm_vwc: a second gauge that reports from 1996 on."""
    since = (days or line_days(spark, folder)).where(F.col("date") >= F.lit("1996-01-01").cast("date"))
    return since.groupBy("date").agg((F.sum("tax").cast("double") / 10.0).alias("precip_mm_vwc"))


def airport(spark: SparkSession, folder: str, days: DataFrame | None = None) -> DataFrame:
    """date, temp_min, temp_max, temp_avg: extremes missing on the 7th-8th and 20th-22nd, means until LAST_MEAN_TEMP."""
    daily = (days or line_days(spark, folder)).where(F.col("l_returnflag") == "N")
    mean = F.try_divide(F.col("cents"), F.col("n_cents"))
    day = F.dayofmonth("date")
    kept = ~(day.between(7, 8) | day.between(20, 22))
    return daily.select(
        "date",
        F.when(kept, F.col("cents_min")).alias("temp_min"),
        F.when(kept, F.col("cents_max")).alias("temp_max"),
        F.when(kept & (F.col("date") <= F.lit(LAST_MEAN_TEMP).cast("date")), mean).alias("temp_avg"),
    )


def snow(spark: SparkSession, folder: str, days: DataFrame | None = None) -> DataFrame:
    """date, snow_dep: daily snow stake reading.

    Missing on the 10th-13th and at the end of the month, from the 17th on in the
    first half of the year and from the 16th on in the second.
    """
    day = F.dayofmonth("date")
    kept = ~(day.between(10, 13) | (day >= F.when(F.month("date") < 7, 17).otherwise(16)))
    return (days or order_days(spark, folder)).select("date", F.when(kept, F.col("n").cast("double")).alias("snow_dep"))


def logger(spark: SparkSession, folder: str) -> DataFrame:
    """datetime, date, airtemp_c, pyranometer_watt_m2: sub-daily readings, none strictly inside OUTAGE."""
    date = F.to_date("l_shipdate")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("datetime"),
        date.alias("date"),
        F.round(F.col("l_discount") * 100).alias("airtemp_c"),
        F.col("l_quantity").alias("pyranometer_watt_m2"),
    )
    return lines.where(_reporting())


def _reporting() -> Column:
    first, last = (F.lit(d).cast("date") for d in OUTAGE)
    return (F.col("date") <= first) | (F.col("date") >= last) | F.col("date").isNull()


def logger_days(days: DataFrame) -> DataFrame:
    """date, temp_avg_vwc, pyra_wattm2_dailyTot: the logger's daily mean and total from ``line_days``; a missing reading makes its day missing."""
    whole = lambda n, v: F.when(F.sum(n) == F.sum("n"), v)
    return days.where(_reporting()).groupBy("date").agg(
        F.round(whole("n_cents", F.sum("cents") / F.sum("n")), 1).alias("temp_avg_vwc"),
        whole("n_quantity", F.sum("quantity")).alias("pyra_wattm2_dailyTot"),
    )


def withdrawals(spark: SparkSession, folder: str, days: DataFrame | None = None) -> DataFrame:
    """wyear, month and three uses, missing out of season."""
    total = lambda c: F.sum(c).cast("double")
    monthly = (days or order_days(spark, folder)).groupBy(water_year(F.col("date")).alias("wyear"), F.month("date").alias("month")).agg(
        total("urgent").alias("a"), total("high").alias("b"), total("low").alias("c")
    )
    month = F.col("month")
    return monthly.select(
        "wyear",
        "month",
        F.when((month >= 10) | (month <= 3), F.col("a")).alias("use_snowmaking_mm"),
        F.when(month <= 6, F.col("b")).alias("use_diverted_mm"),
        F.when(month.between(5, 9), F.col("c")).alias("use_golf_mm"),
    )


def sensor(spark: SparkSession, folder: str) -> DataFrame:
    """ts, station, airtemp_c: raw sensor readings, missing in minute 30 of each hour."""
    kept = F.minute("ts") != 30
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("event_type").alias("station"), F.when(kept, F.col("value")).alias("airtemp_c")
    )


def sweep_scores(spark: SparkSession, folder: str) -> DataFrame:
    """run, rows, cols, clusters, npf, qe: one row per scored run."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("run"),
        (F.col("p_size") % 3 + 11).cast("int").alias("rows"),
        (F.col("p_size") % 4 + 15).cast("int").alias("cols"),
        (F.col("p_size") % 3 + 3).cast("int").alias("clusters"),
        F.col("p_retailprice").alias("npf"),
        ((key * 7919 % 1000) / 1000.0).alias("qe"),
    )
