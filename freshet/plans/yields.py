"""Yield differences of the paired sites, transitions from cold to warm, and the regressions between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.nulls import strict_sum
from freshet.operators import pairs
from freshet.operators.aggregates import count_share, counts
from freshet.operators.joins import full_chain
from freshet.operators.matching import first_match, from_first_match, from_last_match, up_to_first_match
from freshet.operators.models import linear_fit
from freshet.operators.ordered import rolling_mode, running_sum
from freshet.operators.ranking import largest_rows, top_k
from freshet.operators.reshape import bind_rows, to_wide
from freshet.plans.daily import compiled
from freshet.plans.springs import SITE, four_clusters, in_window
from freshet.sources.readings import SITES
from freshet.sources.stages import stage

COLD, WARM = 1, (2, 4)  # clusters of cold days and of warm days
PLAIN_YEARS = (1998,)  # years whose transition is read from the raw clusters, not their running mode
LEVELS = (1, 2, 3, 4)


def yield_differences(daily: DataFrame) -> DataFrame:
    """wyear with the differences at the end of spring and of the water year."""
    spring = pairs.at_period_end(in_window(daily), SITES, "spr")
    end = pairs.at_period_end(daily, SITES, "end")
    return spring.join(end, "wyear", "full")


def one_site(days: DataFrame) -> DataFrame:
    return days.where(F.col("site") == SITE)


def with_mode(days: DataFrame) -> DataFrame:
    return rolling_mode(one_site(days), ["wyear"], ["date"], "cluster", "cluster_mode")


def warm_day(plain_years=PLAIN_YEARS) -> Column:
    """The rule for a warm day: by cluster in the listed years, by running mode otherwise."""
    by_cluster = F.col("wyear").isin(list(plain_years))
    return F.when(by_cluster, F.col("cluster").isin(list(WARM))).otherwise(F.col("cluster_mode").isin(list(WARM)))


def transitions(days: DataFrame) -> DataFrame:
    """wyear, date of the first warm day."""
    return first_match(with_mode(days), ["wyear"], "date", warm_day())


def warm_period(days: DataFrame) -> DataFrame:
    return from_first_match(with_mode(days), ["wyear"], "date", warm_day())


def cold_period(days: DataFrame) -> DataFrame:
    return up_to_first_match(with_mode(days), ["wyear"], "date", warm_day())


def period_ratio(days: DataFrame) -> DataFrame:
    """Days in the cold and the warm period and their ratio; the transition day is in both."""
    tagged = bind_rows(
        cold_period(days).withColumn("period", F.lit("cold")), warm_period(days).withColumn("period", F.lit("warm"))
    )
    wide = to_wide(counts(tagged, ["wyear", "period"]), ["wyear"], "period", ["cold", "warm"], ["n"], "{level}")
    return wide.withColumn("prop_warm2cold", F.try_divide("warm", "cold"))


def after_last_cold(days: DataFrame, group: list[str]) -> DataFrame:
    return from_last_match(days, group, "date", F.col("cluster") == COLD)


def rain_after_last_cold(days: DataFrame) -> DataFrame:
    rows = after_last_cold(one_site(days), ["wyear"])
    return rows.groupBy("wyear").agg(strict_sum("precip_mm").alias("precip_mm_lastcold"))


def difference_after_last_cold(days: DataFrame) -> DataFrame:
    return pairs.of_totals(after_last_cold(days, ["site", "wyear"]), SITES, "lastcold")


def cluster_shares(clustered: DataFrame) -> DataFrame:
    """Days per version, year and cluster with the share of the year's clustered days."""
    return count_share(
        one_site(clustered), ["SOMversion", "wyear", "cluster"], ["SOMversion", "wyear"],
        n="n_cl_all", total="total_obs", share="n_cl_all_prop",
    )


def shares_wide(shares: DataFrame, n: str, share: str) -> DataFrame:
    """One row per year with counts and shares of every cluster, absent clusters as zero."""
    wide = to_wide(shares, ["wyear"], "cluster", LEVELS, [n, share])
    return wide.fillna(0, subset=[c for c in wide.columns if c != "wyear"])


def all_counts_wide(clustered: DataFrame) -> DataFrame:
    shares = cluster_shares(clustered).where(F.col("SOMversion") == "4cl")
    wide = shares_wide(shares, "n_cl_all", "n_cl_all_prop")
    return wide.withColumns(
        {
            "n_cl_all_3and4": F.col("n_cl_all_3") + F.col("n_cl_all_4"),
            "n_cl_all_prop_3and4": F.col("n_cl_all_prop_3") + F.col("n_cl_all_prop_4"),
        }
    )


def warm_counts_wide(days: DataFrame) -> DataFrame:
    shares = count_share(
        warm_period(days), ["wyear", "cluster"], ["wyear"], n="n_cl_warm", total="total_obs", share="n_cl_warm_prop"
    )
    wide = shares_wide(shares, "n_cl_warm", "n_cl_warm_prop")
    ratio = F.try_divide("n_cl_warm_1", F.col("n_cl_warm_2") + F.col("n_cl_warm_4"))
    return wide.withColumn("prop_cold2warm", ratio)


def may_counts(days: DataFrame) -> DataFrame:
    """Days of each cluster in May."""
    may = one_site(days).where(F.month("date") == 5)
    n = counts(may, ["wyear", "cluster"])
    wide = to_wide(n, ["wyear"], "cluster", LEVELS, ["n"], "clust_{level}")
    return wide.fillna(0)


def may_heaviest_rain(days: DataFrame) -> DataFrame:
    may = one_site(days).where(F.month("date") == 5)
    order = [F.col("precip_mm_3d").desc_nulls_last(), F.col("date")]
    return top_k(may, ["wyear"], order, 1).select("wyear", "precip_mm_3d")


def deepest_snow(daily: DataFrame) -> DataFrame:
    """The earliest day of the deepest snow of each water year."""
    snowy = daily.where(F.col("snow_dep_m") > 0)
    # both sites share the stake; rows without a site come last
    site = F.coalesce("site", F.lit("~"))
    return largest_rows(snowy, ["wyear"], "snow_dep_m", "date", ["doy_wyear", "snow_dep_m"], [site])


def snow_and_yield(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Per year: deepest snow at one site, yield differences by several dates, and what may explain them."""
    depth = one_site(daily).groupBy("wyear").agg(F.max("snow_dep_m").alias("snow_depth_max"))
    may = running_sum(in_window(daily, 213, 243), ["site", "wyear"], ["date"], "q_mm", "q_mm_cum_may")
    parts = [
        depth,
        pairs.at_period_end(in_window(daily, 170, 213), SITES, "may1"),
        pairs.at_period_end(in_window(daily, 170, 227), SITES, "may15"),
        pairs.at_period_end(in_window(daily, 170, 243), SITES, "may31"),
        pairs.at_period_end(may, SITES, "may", "q_mm_cum_may"),
        yield_differences(daily),
        rain_after_last_cold(days),
        may_counts(days),
        may_heaviest_rain(days),
    ]
    # every part has one row per water year
    return full_chain(parts, ["wyear"])


def regressions(spark: SparkSession, folder: str) -> DataFrame:
    """The explanatory regressions of yield difference, one row per model."""
    daily, days = compiled(spark, folder), four_clusters(spark, folder)
    y = stage(yield_differences(daily), "yields")
    join = lambda t: t.join(y, "wyear", "full")
    a, b = "WBminusRB_abs_spr", "WBminusRB_abs_end"
    late = join(rain_after_last_cold(days)).join(difference_after_last_cold(days), "wyear", "full")
    others = lambda c: F.when(F.col("wyear") != 1998, F.col(c))  # one extreme year left out of a fit
    total = lambda t, name: t.groupBy("wyear").agg(strict_sum("precip_mm").alias(name))
    # per table the models fitted on it: name, response, predictor
    tables = [
        (
            join(all_counts_wide(days)),
            [
                ("spr_by_wet_days", a, "n_cl_all_4"),
                ("spr_share_by_wet_days", "WBminusRB_per_spr", "n_cl_all_4"),
                ("spr_by_wet_or_mild_days", a, "n_cl_all_3and4"),
            ],
        ),
        (join(total(one_site(days), "precip_mm_sub")), [("spr_by_spring_rain", a, "precip_mm_sub")]),
        (join(period_ratio(days)), [("spr_by_warm_ratio", a, "prop_warm2cold"), ("end_by_warm_ratio", b, "prop_warm2cold")]),
        (
            # years without a warm period take part with zero days
            join(warm_counts_wide(days)).fillna(0),
            [("spr_by_warm_wet_days", a, "n_cl_warm_4"), ("end_by_warm_wet_days", b, "n_cl_warm_4")],
        ),
        (
            join(total(warm_period(days), "precip_mm_warm")),
            [("spr_by_warm_rain", a, "precip_mm_warm"), ("end_by_warm_rain", b, "precip_mm_warm")],
        ),
        (
            late,
            [
                ("spr_by_late_rain", a, "precip_mm_lastcold"),
                ("spr_by_late_rain_without_1998", others(a), "precip_mm_lastcold"),
                ("end_by_late_rain", b, "precip_mm_lastcold"),
                ("melt_by_late_rain_without_1998", others("WBminusRB_abs_lastcold"), "precip_mm_lastcold"),
            ],
        ),
    ]
    double = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    pairs_ = [
        t.select(F.inline(F.array(*[F.struct(F.lit(m).alias("model"), double(yc).alias("y"), double(xc).alias("x")) for m, yc, xc in fits])))
        for t, fits in tables
    ]
    return linear_fit(bind_rows(*pairs_), "y", "x", ["model"])
