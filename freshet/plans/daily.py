"""The compiled daily table: one row per site and day with runoff, weather, snow and water use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.calendar import calendar_year, day_of_water_year, position, water_year
from freshet.functions.nulls import row_total, strict_mean, strict_sum
from freshet.operators import fills
from freshet.operators.joins import full_chain, join_months
from freshet.operators.ordered import percent_of_total, rolling, running_sum
from freshet.operators.reshape import bind_rows
from freshet.sources import readings
from freshet.sources.stages import stage, stage_all, stage_once

INCH_M = 0.0254

# columns of the compiled table, in order
COLUMNS = [
    "site", "wyear", "date", "doy_wyear", "q_mm", "q_mm_cum",
    "precip_mm", "temp_avg", "temp_max", "temp_min", "precip_mm_cum",
    "q_mm_per", "precip_mm_per", "precip_mm_3d", "snow_dep_m",
    "temp_avg_vwc", "temp_avg_vwc_3d", "pyra_wattm2_dailyTot",
    "use_total_mm_cum", "use_snow_mm_daily", "use_total_mm_daily",
]


def station_runoff(raw: DataFrame) -> DataFrame:
    """site, wyear, date, doy_wyear, q_mm, q_mm_cum from site, date, q_mm."""
    dated = raw.withColumn("wyear", water_year(F.col("date")))
    by, order = ["site", "wyear"], ["date"]
    numbered = dated.withColumn("doy_wyear", day_of_water_year(F.col("date")))
    return running_sum(numbered, by, order, "q_mm", "q_mm_cum").select(
        "site", "wyear", "date", "doy_wyear", "q_mm", "q_mm_cum"
    )


def snow_depth(raw: DataFrame, max_gap: int = 15) -> DataFrame:
    """Snow depth in metres with short gaps interpolated in time.

    The station is one daily series, so its window holds one row per day.
    """
    metres = raw.select("date", (F.col("snow_dep") * INCH_M).alias("snow_dep_m")).where(F.col("date").isNotNull())
    one = metres.withColumn("station", F.lit("stake"))
    return fills.interpolate(one, ["station"], ["date"], "snow_dep_m", max_gap, position(one, "date")).drop("station")


def weather(airport: DataFrame, rain: DataFrame, spare: DataFrame) -> DataFrame:
    """Airport temperatures and precipitation per day with all gap rules applied."""
    met = full_chain([airport, rain], ["date"]).withColumn("station", F.lit("airport"))
    met = fills.carry_forward(met, ["station"], ["date"], ["temp_avg", "temp_max", "temp_min"], 2).drop("station")
    met = met.withColumn("temp_avg", F.coalesce("temp_avg", (F.col("temp_min") + F.col("temp_max")) / 2))
    met = fills.from_second_source(met, spare, "date", "precip_mm", "precip_mm_vwc", default=0.0)
    met = met.withColumn("wyear", water_year(F.col("date")))
    return running_sum(met, ["wyear"], ["date"], "precip_mm", "precip_mm_cum").select(
        "date", "wyear", "precip_mm", "temp_avg", "temp_max", "temp_min", "precip_mm_cum"
    )


def spring(date: Column) -> Column:
    return F.month(date).between(3, 5)


def logger_days(logger: DataFrame) -> DataFrame:
    """Daily mean temperature and total radiation in one pass over the readings; a missing reading makes its day missing."""
    return logger.groupBy("date").agg(
        F.round(strict_mean("airtemp_c"), 1).alias("temp_avg_vwc"),
        strict_sum("pyranometer_watt_m2").alias("pyra_wattm2_dailyTot"),
    )


def logger_temperature(days: DataFrame, met: DataFrame, outage: tuple[str, str]) -> DataFrame:
    """Daily logger temperature with the outage filled from the airport by a spring regression, and its 3-day mean."""
    both = full_chain([days.select("date", "temp_avg_vwc"), met.select("date", "temp_avg")], ["date"])
    inside = F.col("date").between(F.lit(outage[0]).cast("date"), F.lit(outage[1]).cast("date"))
    filled = fills.by_regression(both, "temp_avg_vwc", "temp_avg", spring(F.col("date")), inside)
    one = filled.select("date", "temp_avg_vwc").withColumn("station", F.lit("logger"))
    return rolling(one, ["station"], ["date"], "temp_avg_vwc", 3, "temp_avg_vwc_3d", "mean").drop("station")


def logger_radiation(days: DataFrame, outage: tuple[str, str]) -> DataFrame:
    return fills.by_neighbour_mean(days, "date", "pyra_wattm2_dailyTot", *outage)


def monthly_use(raw: DataFrame) -> DataFrame:
    """Monthly withdrawals with missing uses as zero, their total and its sum along the water year."""
    uses = ["use_snowmaking_mm", "use_diverted_mm", "use_golf_mm"]
    full = raw.fillna(0.0, subset=uses)
    full = full.withColumn("year", calendar_year(F.col("wyear"), F.col("month")))
    full = full.withColumn("use_total_mm", row_total(*uses))
    # months of a water year start in October
    full = full.withColumn("_nth", (F.col("month") + 2) % 12)
    return running_sum(full, ["wyear"], ["_nth"], "use_total_mm", "use_total_mm_cum").drop("_nth")


def water_balance(runoff: DataFrame, calendar: DataFrame) -> DataFrame:
    """Runoff full-joined to the per-day table, with percentages of the annual totals and 3-day rain.

    Annual totals count only days with runoff; days without a site have none.
    """
    per_day = calendar.withColumnRenamed("wyear", "_wyear")
    water = runoff.join(per_day, "date", "full").withColumn("wyear", F.coalesce("wyear", "_wyear")).drop("_wyear")
    year = ["site", "wyear"]
    measured = F.col("q_mm").isNotNull()
    water = percent_of_total(water, year, "q_mm_cum", "q_mm", "q_mm_per", measured)
    water = percent_of_total(water, year, "precip_mm_cum", "precip_mm", "precip_mm_per", measured)
    has_site = F.col("site").isNotNull()
    water = water.withColumns({c: F.when(has_site, F.col(c)) for c in ("q_mm_per", "precip_mm_per")})
    return rolling(water, ["site"], ["date"], "precip_mm", 3, "precip_mm_3d", "sum")


def month_lengths(*dated: DataFrame) -> DataFrame:
    """year, month, days: the last day of the month that occurs in any of the tables."""
    days = [d.select(F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("days")) for d in dated]
    return bind_rows(*days).where(F.col("days").isNotNull()).groupBy("year", "month").agg(F.max("days").alias("days"))


def use_per_day(daily: DataFrame, use: DataFrame, lengths: DataFrame) -> DataFrame:
    """Spread monthly volumes over the days of the month."""
    monthly = use.join(lengths, ["year", "month"]).select(
        "wyear",
        "year",
        "month",
        "use_total_mm_cum",
        (F.col("use_snowmaking_mm") / F.col("days")).alias("use_snow_mm_daily"),
        (F.col("use_total_mm") / F.col("days")).alias("use_total_mm_daily"),
    )
    dated = daily.withColumns({"year": F.year("date"), "month": F.month("date")})
    return join_months(dated, monthly, ["wyear", "year", "month"]).drop("year", "month")


def compile_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The full table.

    Each fact table is read once and aggregated to a table of days with what all its series
    need. Daily tables that several later steps read are written to the shared folder first,
    so no raw scan is repeated and the plan of the join stays short. All per-day tables
    have one row per day and are put together by one union and aggregation; the
    site-day table meets them in one join.
    """
    r = readings
    lines, orders = stage_all({"lines": r.line_days(spark, folder), "orders": r.order_days(spark, folder)})
    runoff, days = r.runoff(spark, folder, lines), r.logger_days(lines)
    met = weather(r.airport(spark, folder, lines), r.precipitation(spark, folder, orders), r.precipitation_spare(spark, folder, lines))
    met, snow, use = stage_all({"met": met, "snow": snow_depth(r.snow(spark, folder, orders)), "use": monthly_use(r.withdrawals(spark, folder, orders))})
    per_day = stage(
        full_chain(
            [
                met,
                snow,
                logger_temperature(days, met, r.OUTAGE),
                logger_radiation(days, r.OUTAGE),
            ],
            ["date"],
        ),
        "weather",
    )
    water = water_balance(station_runoff(runoff), per_day)
    used = use_per_day(water, use, month_lengths(runoff, per_day))
    return used.where(F.col("date") <= F.lit(r.END_OF_RECORD).cast("date")).select(*COLUMNS)


def compiled(spark: SparkSession, folder: str) -> DataFrame:
    """The compiled table as written once per session, the input of every later analysis."""
    return stage_once(spark, folder, "daily", lambda: compile_daily(spark, folder))
