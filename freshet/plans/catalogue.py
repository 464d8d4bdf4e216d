"""Every query by name: a callable of (session, folder of input tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType

from freshet.functions import calendar, nulls, text
from freshet.functions.calendar import position, water_year
from freshet.operators import aggregates, columns, fills, joins, models, moments, ordered, pairs, permanova, quantiles, ranking, reshape, scaling, sizing, som
from freshet.plans import daily as daily_plan, springs, yields
from freshet.plans.daily import compiled
from freshet.plans.springs import FEATURES
from freshet.plans.sweep import GRID_SCHEMA, best_runs
from freshet.session import shared_dir
from freshet.sources import files, readings as r
from freshet.streaming import closing, rollups

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIGITS = 6  # doubles are rounded, since sums depend on the order of partial results


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = fn(spark, folder)
        doubles = [f.name for f in out.schema.fields if isinstance(f.dataType, DoubleType)]
        return out.withColumns({c: F.round(c, DIGITS) for c in doubles}) if doubles else out

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    # a trailing underscore keeps a query apart from the function it shows
    QUERIES[fn.__name__.rstrip("_")] = run
    return fn


def wy(df: DataFrame) -> DataFrame:
    return df.withColumn("wyear", water_year(F.col("date")))


# --- sources and sinks -------------------------------------------------------


@query
def scan(spark, folder):
    path = shared_dir(spark, "scan")
    orders = r.table(spark, folder, "orders")
    files.write_csv(orders.select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority"), path)
    return files.read_csv(spark, path, "o_orderkey long, o_totalprice double, o_orderdate date, o_orderpriority string")


@query
def scan_typed(spark, folder):
    """A column that starts with missing values is a number because the schema says so."""
    path = shared_dir(spark, "typed")
    readings = r.sensor(spark, folder)
    files.write_csv(readings.select("event_id", F.date_format("ts", "M/d/yyyy H:mm").alias("recordtime"), "airtemp_c"), path)
    raw = files.read_csv(spark, path, "event_id long, recordtime string, airtemp_c double")
    return raw.withColumn("recordtime", calendar.parse_timestamp(F.col("recordtime")).cast("timestamp_ntz"))


SENSOR_FILES = "event_id long, airtemp_c double, precip double"


def _two_generations(spark, folder):
    """Sensor files of two generations: the old ones have a precipitation column, the new ones another column order."""
    base = shared_dir(spark, "multi")
    readings = r.sensor(spark, folder)
    old = F.col("station") < "m"
    files.write_csv(readings.where(old).select("event_id", "airtemp_c", F.lit(0.5).alias("precip")), f"{base}/old")
    files.write_csv(readings.where(~old).select("airtemp_c", "event_id"), f"{base}/new")
    return base


@query
def scan_multi(spark, folder):
    return files.read_csv_folder(spark, _two_generations(spark, folder), SENSOR_FILES)


@query
def source_tag(spark, folder):
    found = files.read_csv_folder(spark, _two_generations(spark, folder), SENSOR_FILES, "path")
    return found.select("event_id", F.regexp_extract("path", "/(old|new)/", 1).alias("source"))


@query
def scan_inferred(spark, folder):
    """Files of two column orders read without a schema."""
    base = shared_dir(spark, "inferred")
    orders = r.table(spark, folder, "orders")
    early = F.col("o_orderkey") % 2 == 0
    cols = ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"]
    for name, part, names in (("a", early, cols), ("b", ~early, cols[::-1])):
        files.write_csv(orders.where(part).withColumn("o_orderdate", F.to_date("o_orderdate")).select(*names), f"{base}/{name}")
    return files.read_csv(spark, base)


@query
def sink_roundtrip(spark, folder):
    path = shared_dir(spark, "sink")
    files.write_table(wy(r.runoff(spark, folder)), path, ["wyear"])
    return spark.read.schema("site string, date date, q_mm double, wyear int").parquet(path)


@query
def retype(spark, folder):
    texts = r.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    return columns.cast_to(texts, {"key": "long", "price": "double", "priority": "int"})


def _as_texts(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query
def retype_inferred(spark, folder):
    """Orders as texts, with their types found again."""
    return columns.retype(_as_texts(r.table(spark, folder, "orders")))


@query
def retype_inferred_pages(spark, folder):
    """Pages as texts: numbers, addresses and markup."""
    return columns.retype(_as_texts(r.table(spark, folder, "pages")))


@query
def types_inferred(spark, folder):
    """The type found for every column of five tables as texts, days as such, prices with missing marks."""
    out = []
    for name in ("orders", "lineitem", "events", "customer", "pages"):
        rows = r.table(spark, folder, name)
        if name == "lineitem":
            day = F.date_format("l_shipdate", "yyyy/M/d")
            mixed = F.when(F.col("l_linenumber") == 1, "NA").when(F.col("l_linenumber") == 2, " 7 ").otherwise(F.col("l_tax").cast("string"))
            code = F.lpad(F.col("l_suppkey").cast("string"), 9, "0")
            rows = rows.withColumns({"l_shipdate": day, "l_tax": mixed, "l_suppkey": code, "l_linestatus": F.when(F.col("l_linestatus") == "O", "T").otherwise("FALSE")})
        types = columns.infer_types(_as_texts(rows), rows.columns)
        out += [(name, c, t) for c, t in types.items()]
    return spark.createDataFrame(out, "source string, name string, type string")


@query
def append_literals(spark, folder):
    missing = spark.createDataFrame([("2003-04-10",), ("2003-05-30",)], "d string").select(F.to_date("d").alias("date"))
    return reshape.bind_rows(r.snow(spark, folder), missing)


@query
def date_spine(spark, folder):
    """Days from the first to the last order, with the number of orders, zero included."""
    daily = r.table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    days = daily.agg(F.sequence(F.min("date"), F.max("date")).alias("days")).select(F.explode("days").alias("date"))
    return days.join(daily, "date", "left").fillna(0, subset=["n"])


# --- columns -----------------------------------------------------------------


@query
def project_rename(spark, folder):
    lines = r.table(spark, folder, "lineitem")
    return lines.select(F.col("l_orderkey").alias("order_id"), "l_linenumber", F.col("l_quantity").alias("q_mm"))


@query
def drop_cols(spark, folder):
    return columns.drop_listed(r.table(spark, folder, "orders"), ["o_orderdate", "no_such_column"], ["o_orderpriority"])


@query
def select_pattern(spark, folder):
    w = r.withdrawals(spark, folder)
    return w.select("wyear", "month", *columns.matching(w, prefix="use"))


@query
def select_range(spark, folder):
    o = r.table(spark, folder, "orders")
    return o.select(*columns.name_range(o, "o_custkey", "o_totalprice"))


@query
def reorder_cols(spark, folder):
    return columns.leading(r.table(spark, folder, "orders"), ["o_orderdate", "o_orderpriority"])


@query
def lower_names(spark, folder):
    upper = r.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("S_SUPPKEY"), F.col("s_name").alias("S_Name"), F.col("s_acctbal").alias("S_ACCTBAL"))
    return columns.lower_names(upper)


@query
def mutate(spark, folder):
    """Unit conversions: inches to metres to centimetres."""
    return r.snow(spark, folder).withColumn("snow_dep_m", F.col("snow_dep") * 0.0254).withColumn("snow_dep_cm", F.col("snow_dep_m") * 100)


@query
def mutate_at(spark, folder):
    w = r.withdrawals(spark, folder)
    return columns.on_each(w, columns.matching(w, prefix="use"), lambda c: F.coalesce(c, F.lit(0.0)))


@query
def rowwise_sum(spark, folder):
    return r.withdrawals(spark, folder).withColumn("use_total_mm", nulls.row_total("use_snowmaking_mm", "use_diverted_mm", "use_golf_mm"))


@query
def scalar_subquery(spark, folder):
    """Each score relative to the largest error, which enters as a scalar."""
    runs = r.sweep_scores(spark, folder)
    largest = runs.agg(F.max("qe")).scalar()
    return runs.select("run", (F.col("qe") / largest).alias("relative_qe"))


# --- filters -----------------------------------------------------------------


@query
def window_of_year(spark, folder):
    return springs.in_window(compiled(spark, folder)).select("site", "date", "doy_wyear", "q_mm")


@query
def filter_eq(spark, folder):
    return r.runoff(spark, folder).where(F.col("site") == "WB")


@query
def filter_in(spark, folder):
    return wy(r.runoff(spark, folder)).where(F.col("wyear").isin(1996, 1998, 2001))


@query
def filter_not_in(spark, folder):
    days = compiled(spark, folder).select("site", "date", F.when(F.month("date") != 7, F.col("wyear")).alias("wyear"))
    return days.where(nulls.not_in("wyear", [1995, 1996]))


@query
def filter_ne(spark, folder):
    days = compiled(spark, folder).select("site", "date", F.when(F.month("date") != 7, F.col("wyear")).alias("wyear"))
    return days.where(F.col("wyear") != 1998)


@query
def filter_notnull(spark, folder):
    return r.snow(spark, folder).where(F.col("snow_dep").isNotNull())


@query
def filter_daterange(spark, folder):
    first, last = (F.lit(d).cast("date") for d in r.OUTAGE)
    d = F.col("date")
    near = d.between(F.date_sub(first, 5), F.date_add(last, 5)) & (d != first) & (d != last)
    return daily_plan.logger_days(r.logger(spark, folder)).where(near)


@query
def filter_datepart(spark, folder):
    return r.runoff(spark, folder).where((F.month("date") == 3) & (F.dayofmonth("date") > 15))


@query
def complete_cases(spark, folder):
    return springs.features(spark, folder)


@query
def complete_cases_late_window(spark, folder):
    """The drivers of the narrower window that starts ten days later."""
    return springs.features(spark, folder, (180, 245))


@query
def missing_audit(spark, folder):
    """Spring rows in which any driver or response is missing."""
    days = springs.in_window(compiled(spark, folder))
    kept = columns.drop_listed(days, ["wyear", "doy_wyear", "q_mm", "q_mm_cum", "q_mm_per", "precip_mm_per"], ["temp_max", "temp_min", "temp_avg"])
    return kept.where(nulls.any_null(kept.columns))


# --- joins -------------------------------------------------------------------


@query
def join_left(spark, folder):
    return r.precipitation(spark, folder).join(r.precipitation_spare(spark, folder), "date", "left")


@query
def totals_back(spark, folder):
    """Annual totals of days with runoff next to every day, without a join; days lost to a gap have none."""
    days = wy(r.runoff_with_gaps(spark, folder)).join(r.precipitation(spark, folder).fillna(0.0), "date", "left")
    w = Window.partitionBy("site", "wyear")
    measured = F.col("q_mm").isNotNull()
    rain = F.when(measured, F.col("precip_mm"))
    full = F.count(rain).over(w) == F.count(F.when(measured, 1)).over(w)
    return days.select("site", "wyear", "date", "q_mm", F.sum("q_mm").over(w).alias("q_mm_tot"), F.when(full, F.sum(rain).over(w)).alias("precip_mm_tot"))


@query
def join_full(spark, folder):
    return r.precipitation(spark, folder).join(r.snow(spark, folder), "date", "full")


@query
def join_full_nullsafe(spark, folder):
    """Two monthly tables whose key is missing for some months; missing keys match."""
    key = lambda df: df.select("*", F.when(F.month("date") != 7, F.month("date")).alias("month"))
    a = key(wy(r.runoff(spark, folder))).groupBy("wyear", "month").agg(F.sum("q_mm").alias("q_mm"))
    b = key(wy(r.snow(spark, folder))).groupBy("wyear", "month").agg(F.sum("snow_dep").alias("snow_dep"))
    return joins.join_matching_nulls(a, b, ["wyear", "month"])


@query
def join_full_chain(spark, folder):
    tables = [r.precipitation(spark, folder), r.precipitation_spare(spark, folder), r.snow(spark, folder), r.airport(spark, folder)]
    return joins.full_chain(tables, ["date"])


@query
def join_coarse(spark, folder):
    days = wy(r.runoff(spark, folder)).withColumn("month", F.month("date"))
    return joins.join_months(days, r.withdrawals(spark, folder), ["wyear", "month"])


@query
def reattach(spark, folder):
    """Labels of one site's days put on the rows of both sites."""
    days = springs.in_window(compiled(spark, folder)).select("site", "wyear", "date", "q_mm")
    return springs.day_clusters(spark, folder).join(days, "date", "left")


@query
def reattach_full_year(spark, folder):
    """Labels full-joined to the whole table, for strips over the full year."""
    keys = ["site", "date"]
    days = columns.drop_listed(compiled(spark, folder), springs.UNUSED).select("site", "wyear", "date", "doy_wyear", "q_mm_cum")
    labelled = yields.four_clusters(spark, folder).select("site", "date", "cluster")
    full = joins.join_matching_nulls(days, labelled, keys)
    return full.where(nulls.not_in("wyear", [1995]) & F.col("site").isNotNull())


@query
def zip_by_obs(spark, folder):
    """Two tables bound by position, here an explicit observation number."""
    drivers = springs.numbered_features(spark, folder).select("obs", "date", "precip_mm")
    labels = springs.day_clusters(spark, folder).withColumn("_year", F.year("date"))
    numbered = ordered.row_numbers(labels, [], ["date"], "obs", chunk="_year").select("obs", "cluster")
    return drivers.join(numbered, "obs")


# --- aggregates --------------------------------------------------------------


@query
def sum_strict(spark, folder):
    return aggregates.sum_strict(wy(r.runoff_with_gaps(spark, folder)).withColumn("month", F.month("date")), ["site", "wyear", "month"], q_mm_tot="q_mm")


@query
def mean_strict(spark, folder):
    return aggregates.mean_strict(r.logger(spark, folder), ["date"], digits=1, temp_avg_vwc="airtemp_c")


@query
def hourly_mean(spark, folder):
    hourly = r.sensor(spark, folder).groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("time_hourly"), "station")
    return hourly.agg(F.avg("airtemp_c").alias("airtemp_c"))


@query
def mean_sd(spark, folder):
    depth = r.snow(spark, folder).where(F.col("snow_dep") > 0).select((F.col("snow_dep") * 2.54).alias("cm"))
    return depth.agg(F.avg("cm").alias("mean"), F.stddev_samp("cm").alias("sd"))


@query
def group_max(spark, folder):
    return wy(r.snow(spark, folder)).groupBy("wyear").agg(F.max("snow_dep").alias("snow_depth_max"))


@query
def quartiles(spark, folder):
    return quantiles.exact_quantiles(r.sensor(spark, folder), ["station"], "airtemp_c", {"q2": 0.25, "median": 0.5, "q3": 0.75})


@query
def box_stats(spark, folder):
    long = reshape.to_long(r.table(spark, folder, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])
    return quantiles.box_summary(long, ["l_returnflag", "var"], "value")


@query
def box_stats_clusters(spark, folder):
    long = reshape.to_long(yields.four_clusters(spark, folder), ["cluster"], FEATURES)
    return quantiles.box_summary(long, ["cluster", "var"], "value")


@query
def box_outliers(spark, folder):
    """The days that a box figure of the clusters shows as single points."""
    long = reshape.to_long(yields.four_clusters(spark, folder), ["site", "date", "cluster"], FEATURES)
    return quantiles.box_outliers(long, ["cluster", "var"], "value")


@query
def count_groups(spark, folder):
    return aggregates.counts(r.sensor(spark, folder).withColumn("date", F.to_date("ts")), ["station", "date"])


@query
def count_share(spark, folder):
    return yields.cluster_shares(springs.clustered(spark, folder))


@query
def distinct_count(spark, folder):
    e = r.table(spark, folder, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.count("value").alias("n_value"))


# --- ordered series ----------------------------------------------------------


@query
def row_number(spark, folder):
    return ordered.row_numbers(wy(r.runoff(spark, folder)), ["site", "wyear"], ["date"], "doy_wyear")


@query
def cumsum_strict(spark, folder):
    return ordered.running_sum(wy(r.runoff_with_gaps(spark, folder)), ["site", "wyear"], ["date"], "q_mm", "q_mm_cum")


@query
def cum_percent(spark, folder):
    days = ordered.running_sum(wy(r.runoff(spark, folder)), ["site", "wyear"], ["date"], "q_mm", "q_mm_cum")
    return ordered.percent_of_total(days, ["site", "wyear"], "q_mm_cum", "q_mm", "q_mm_per")


@query
def rolling_sum(spark, folder):
    return ordered.rolling(r.runoff_with_gaps(spark, folder), ["site"], ["date"], "q_mm", 3, "q_mm_3d")


@query
def rolling_mean(spark, folder):
    return ordered.rolling(r.runoff_with_gaps(spark, folder), ["site"], ["date"], "q_mm", 3, "q_mm_3d_mean", "mean")


@query
def rolling_mode(spark, folder):
    return yields.with_mode(yields.four_clusters(spark, folder)).select("wyear", "date", "cluster", "cluster_mode")


@query
def fill_locf(spark, folder):
    met = r.airport(spark, folder).withColumn("station", F.lit("airport"))
    return fills.carry_forward(met, ["station"], ["date"], ["temp_min", "temp_max"], 2).select("date", "temp_min", "temp_max")


@query
def fill_linear(spark, folder):
    return daily_plan.snow_depth(r.snow(spark, folder))


def _long_sensor(spark, folder):
    """Raw readings of every station, cut into chunks: a station may hold any share of all rows."""
    return ordered.with_chunks(r.sensor(spark, folder), ["ts", "event_id"], rows=PIECE)


PIECE = 400  # rows per chunk and block of the queries on long series, so that the given tables make many
LONG = (["station"], ["ts", "event_id"])


@query
def row_number_long(spark, folder):
    return ordered.row_numbers(_long_sensor(spark, folder), *LONG, "n", chunk="_chunk").select("event_id", "station", "n")


@query
def cumsum_strict_long(spark, folder):
    """Running sum of whole hundredths, which is exact whatever the order of partial sums."""
    cents = r.table(spark, folder, "events").select(
        "event_id", "ts", F.col("event_type").alias("station"), F.round(F.col("value") * 100).cast("long").alias("v")
    )
    out = ordered.running_sum(ordered.with_chunks(cents, LONG[1], rows=PIECE), *LONG, "v", "v_cum", chunk="_chunk")
    return out.select("event_id", "station", "v_cum")


@query
def rolling_mean_long(spark, folder):
    out = ordered.rolling(_long_sensor(spark, folder), *LONG, "airtemp_c", 3, "mean3", "mean", chunk="_chunk", block_rows=PIECE)
    return out.select("event_id", "station", "mean3")


@query
def fill_locf_long(spark, folder):
    out = fills.carry_forward(_long_sensor(spark, folder), *LONG, ["airtemp_c"], 2, chunk="_chunk", block_rows=PIECE)
    return out.select("event_id", "station", "airtemp_c")


@query
def fill_linear_long(spark, folder):
    """Interpolation in time between readings."""
    readings = _long_sensor(spark, folder)
    out = fills.interpolate(readings, *LONG, "airtemp_c", 10, position(readings, "ts"), chunk="_chunk", block_rows=PIECE)
    return out.select("event_id", "station", "airtemp_c")


@query
def last_per_group(spark, folder):
    days = wy(r.runoff(spark, folder))
    return ranking.last_rows(days, ["site", "wyear"], "date", ["date", "q_mm"])


@query
def argmax_row(spark, folder):
    """The earliest day of the deepest snow per water year."""
    return ranking.largest_rows(wy(r.snow(spark, folder)), ["wyear"], "snow_dep", "date", ["date", "snow_dep"])


@query
def from_first_match(spark, folder):
    return yields.warm_period(yields.four_clusters(spark, folder)).select("wyear", "date", "cluster")


@query
def to_first_match(spark, folder):
    return yields.cold_period(yields.four_clusters(spark, folder)).select("wyear", "date", "cluster")


@query
def from_last_match(spark, folder):
    rows = yields.after_last_cold(yields.four_clusters(spark, folder), ["site", "wyear"])
    return rows.select("site", "wyear", "date", "cluster")


@query
def first_transition(spark, folder):
    return yields.transitions(yields.four_clusters(spark, folder))


# --- ranking -----------------------------------------------------------------


@query
def sort_multi(spark, folder):
    return ranking.sort_rows(r.sensor(spark, folder).select("station", "airtemp_c", "event_id"), "station", "-airtemp_c", "event_id")


@query
def top_half(spark, folder):
    return ranking.upper_half(r.sweep_scores(spark, folder), "npf", "run").select("run", "npf")


@query
def best_run_auto(spark, folder):
    """Among the upper half by pseudo-F, the run of least error for each number of clusters."""
    return best_runs(r.sweep_scores(spark, folder))


@query
def topk_group(spark, folder):
    """The three wettest days of each water year."""
    rain = wy(r.precipitation(spark, folder))
    order = [F.col("precip_mm").desc_nulls_last(), F.col("date")]
    return ranking.top_k(rain, ["wyear"], order, 3, "precip_rank")


# --- reshaping ---------------------------------------------------------------


@query
def union_fill(spark, folder):
    return reshape.bind_rows(r.snow(spark, folder), r.precipitation(spark, folder))


@query
def replace_range(spark, folder):
    days = daily_plan.logger_days(r.logger(spark, folder)).select("date", "pyra_wattm2_dailyTot")
    return fills.replace_range(days, "date", *r.OUTAGE, pyra_wattm2_dailyTot=F.lit(-1.0))


@query
def unpivot(spark, folder):
    return reshape.to_long(r.airport(spark, folder), ["date"], ["temp_min", "temp_max", "temp_avg"])


@query
def pivot_one(spark, folder):
    return reshape.to_wide(r.runoff(spark, folder), ["date"], "site", r.SITES, ["q_mm"], "{level}")


@query
def pivot_multi(spark, folder):
    n = aggregates.count_share(r.sensor(spark, folder).withColumn("date", F.to_date("ts")), ["date", "station"], ["date"])
    return reshape.to_wide(n, ["date"], "station", reshape.levels_of(n, "station"), ["n", "share"])


# --- scalar functions --------------------------------------------------------


@query
def str_funcs(spark, folder):
    part = r.table(spark, folder, "part")
    brand = F.col("p_brand")
    return part.select(
        "p_partkey",
        text.first_chars(brand, 2).alias("head"),
        text.last_chars(brand, 3).alias("tail"),
        text.first_number(brand).cast("int").alias("number"),
        F.concat_ws("_", "p_name", "p_type").alias("pasted"),
        F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("pasted0"),
        F.lower("p_type").alias("lowered"),
    )


@query
def date_parse(spark, folder):
    """Texts to dates and times and back; days that do not exist become missing."""
    d = F.to_date("o_orderdate")
    texts = r.table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format(d, "yyyy-M-d").alias("iso"),
        F.concat_ws("-", F.year(d), F.lit(2), F.dayofmonth(d)).alias("february"),
        F.concat(F.date_format(d, "M/d/yyyy"), F.lit(" 9:05")).alias("stamp"),
    )
    return texts.select(
        "o_orderkey",
        calendar.parse_date(F.col("iso"), "yyyy-M-d").alias("iso"),
        calendar.parse_date(F.col("february"), "yyyy-M-d").alias("february"),
        calendar.parse_timestamp(F.col("stamp")).cast("timestamp_ntz").alias("stamp"),
        F.date_format(calendar.parse_date(F.col("iso"), "yyyy-M-d"), "yyyy-MM-dd").alias("as_text"),
    )


@query
def date_parts(spark, folder):
    ts = F.col("ts")
    return r.table(spark, folder, "events").select("event_id", F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("mday"), F.to_date(ts).alias("date"))


@query
def water_year_(spark, folder):
    d = F.to_date("o_orderdate")
    dated = r.table(spark, folder, "orders").select("o_orderkey", water_year(d).alias("wyear"), F.month(d).alias("month"))
    return dated.withColumn("year", calendar.calendar_year(F.col("wyear"), F.col("month")))


@query
def cond_null(spark, folder):
    """A choice whose condition is missing gives a missing result."""
    depth = F.col("snow_dep")
    return r.snow(spark, folder).select("date", nulls.choose(depth > 5, F.lit("deep"), F.lit("shallow")).alias("class"))


@query
def fill_const(spark, folder):
    return r.precipitation(spark, folder).fillna(0.0, subset=["precip_mm"])


@query
def coalesce_src(spark, folder):
    both = r.precipitation(spark, folder).join(r.precipitation_spare(spark, folder), "date", "left")
    return both.select("date", nulls.first_present("precip_mm", "precip_mm_vwc").alias("precip_mm"))


@query
def math_funcs(spark, folder):
    price = F.col("o_totalprice")
    return r.table(spark, folder, "orders").select(
        "o_orderkey",
        F.round(price / 7.0, 3).alias("rounded"),
        F.bround(F.col("o_orderkey") / 2.0, 0).alias("half_even"),
        F.sqrt(price).alias("root"),
        (-price).alias("negated"),
    )


@query
def category_order(spark, folder):
    levels = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT", "4-NOT SPECIFIED"]
    orders = r.table(spark, folder, "orders")
    return orders.select("o_orderkey", nulls.category_rank("o_orderpriority", levels, exclude=["4-NOT SPECIFIED"]).cast("int").alias("level"))


# --- domain compositions -----------------------------------------------------


def _wide_runoff(spark, folder):
    """Runoff as it is delivered: one row per calendar day, one column per site and water year."""
    days = wy(r.runoff(spark, folder))
    label = F.concat_ws("-", F.dayofmonth("date"), F.date_format("date", "MMM"))
    named = days.select(label.alias("date"), F.concat_ws(" ", "site", F.concat(F.lit("WY"), F.col("wyear").cast("string"))).alias("id"), "q_mm")
    series = [f"{s} WY{y}" for s in r.SITES for y in reshape.levels_of(days, "wyear")]
    return reshape.to_wide(named, ["date"], "id", series, ["q_mm"], "{level}"), series


@query
def tidy_wide_year(spark, folder):
    wide, series = _wide_runoff(spark, folder)
    return reshape.tidy_water_years(wide, "date", series, "q_mm", century=0)


@query
def precip_fallback(spark, folder):
    return fills.from_second_source(r.precipitation(spark, folder), r.precipitation_spare(spark, folder), "date", "precip_mm", "precip_mm_vwc", default=0.0)


@query
def temp_mid(spark, folder):
    return r.airport(spark, folder).select("date", F.coalesce("temp_avg", (F.col("temp_min") + F.col("temp_max")) / 2).alias("temp_avg"))


@query
def fill_regression(spark, folder):
    met = r.airport(spark, folder)
    return daily_plan.logger_temperature(daily_plan.logger_days(r.logger(spark, folder)), met, r.OUTAGE)


@query
def fill_neighbour_mean(spark, folder):
    return daily_plan.logger_radiation(daily_plan.logger_days(r.logger(spark, folder)), r.OUTAGE)


@query
def monthly_to_daily(spark, folder):
    days = r.runoff(spark, folder)
    use = daily_plan.monthly_use(r.withdrawals(spark, folder))
    return daily_plan.use_per_day(wy(days), use, daily_plan.month_lengths(days))


@query
def compile_daily(spark, folder):
    return daily_plan.compile_daily(spark, folder)


@query
def paired_yield_diff(spark, folder):
    """Spring and year-end differences straight from raw runoff."""
    return yields.yield_differences(daily_plan.station_runoff(r.runoff(spark, folder)))


@query
def paired_diff_after_event(spark, folder):
    return yields.difference_after_last_cold(yields.four_clusters(spark, folder))


@query
def sum_after_event(spark, folder):
    totals = yields.rain_after_last_cold(yields.four_clusters(spark, folder))
    return totals.join(yields.yield_differences(compiled(spark, folder)), "wyear", "full")


@query
def period_ratio(spark, folder):
    return yields.period_ratio(yields.four_clusters(spark, folder))


@query
def share_contrib(spark, folder):
    shares = yields.cluster_shares(springs.clustered(spark, folder)).where(F.col("SOMversion") == "4cl")
    both = shares.join(yields.yield_differences(compiled(spark, folder)), "wyear")
    p = F.col("n_cl_all_prop")
    return both.select("wyear", "cluster", (p * F.col("WBminusRB_abs_spr")).alias("clContr_abs"), (p * F.col("WBminusRB_per_spr")).alias("clContr_per"))


@query
def cluster_counts_wide(spark, folder):
    return yields.all_counts_wide(springs.clustered(spark, folder))


@query
def cluster_counts_warm(spark, folder):
    return yields.warm_counts_wide(yields.four_clusters(spark, folder))


@query
def peak_day_stats(spark, folder):
    peaks = yields.deepest_snow(compiled(spark, folder))
    return peaks.agg(F.avg("doy_wyear").alias("mean_day"), F.stddev_samp("doy_wyear").alias("sd_day"), F.avg("snow_dep_m").alias("mean_depth"), F.stddev_samp("snow_dep_m").alias("sd_depth"))


# --- statistics and learning -------------------------------------------------

# a sweep grid in the usual columns; rows, cols and clusters vary
GRID = [
    {"run": 1, "rows": 4, "cols": 5, "topology": "hexagonal", "k": 3},
    {"run": 2, "rows": 4, "cols": 5, "topology": "hexagonal", "k": 4},
    {"run": 3, "rows": 5, "cols": 6, "topology": "hexagonal", "k": 4},
    {"run": 4, "rows": 5, "cols": 6, "topology": "rectangular", "k": 5},
]


@query
def som_sweep(spark, folder):
    """Error, pseudo-F and p of every run of the grid file, with all its fields."""
    return springs.swept(spark, folder)[0]


@query
def sweep_grid(spark, folder):
    """The parameter file of the sweep as it is read: lattices from the data, in every number of clusters, twice."""
    return files.read_csv(spark, springs.grid_file(spark, folder), GRID_SCHEMA)


@query
def sweep_assignments(spark, folder):
    """Node, distance and cluster of every spring day in every run."""
    return springs.swept(spark, folder)[1]


@query
def sweep_best(spark, folder):
    """The chosen run of every number of clusters."""
    return best_runs(springs.swept(spark, folder)[0])


@query
def sweep_clustered(spark, folder):
    """Spring days of both sites with the clusters of the chosen runs, a version per number of clusters."""
    return springs.swept_clusters(spark, folder)


@query
def sweep_count_share(spark, folder):
    """Days per cluster and year, and their share of the year, in every version."""
    return yields.cluster_shares(springs.swept_clusters(spark, folder))


@query
def sweep_yield_by_warm_days(spark, folder):
    """Spring yield difference on the year's number of days in each cluster, in every version."""
    counts = yields.cluster_shares(springs.swept_clusters(spark, folder)).select("SOMversion", "wyear", "cluster", "n_cl_all")
    both = counts.join(yields.yield_differences(compiled(spark, folder)), "wyear")
    return models.linear_fit(both, "WBminusRB_abs_spr", "n_cl_all", ["SOMversion", "cluster"])


def _vectors(spark, folder):
    """The embeddings as one column per dimension; the width is the vector length of the table."""
    e = r.table(spark, folder, "embeddings")
    least, most = e.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError(f"vectors have {least} to {most} dimensions")
    names = [f"x{i}" for i in range(most or 0)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def _vector_map(spark, folder):
    """A map of the embedding vectors, started from the rows that an integer hash puts first; all epochs are run."""
    data, names = _vectors(spark, folder)
    first = [F.col("vec_id") * 7919 % 10007, F.col("vec_id")]
    return *som.fit(data, "vec_id", names, [GRID[0]], tolerance=0.0, start=first), names


@query
def som_fit(spark, folder):
    codes, _, names = _vector_map(spark, folder)
    return som.component_planes(codes, names)


@query
def som_progress(spark, folder):
    return _vector_map(spark, folder)[1]


@query
def node_clusters(spark, folder):
    scaled = springs.scaled_features(spark, folder)
    codes, _ = som.fit(scaled, "date", FEATURES, GRID)
    return som.node_clusters(codes, spark.createDataFrame([(g["run"], g["k"]) for g in GRID], "run int, k int"))


@query
def som_qe(spark, folder):
    return som.quantization_error(springs.assigned(spark, folder))


def _label_codes(spark, folder):
    """One node per label, at the mean of its vectors."""
    data, names = _vectors(spark, folder)
    means = data.groupBy("label").agg(*[F.avg(n).alias(n) for n in names])
    return data, names, means.select(F.lit(1).alias("run"), (F.col("label") + 1).cast("int").alias("node"), F.array(*names).alias("w"))


@query
def som_epoch(spark, folder):
    """One training step of a 2 x 5 hexagonal map that starts from the label means."""
    data, names, codes = _label_codes(spark, folder)
    gx, gy = som.lattice_columns(F.col("node"), 5)
    placed = codes.select("run", "node", gx.cast("double").alias("gx"), gy.cast("double").alias("gy"), "w")
    return som.component_planes(som.train_epoch(data, names, placed, 1.0), names)


@query
def som_qe_vectors(spark, folder):
    data, names, codes = _label_codes(spark, folder)
    return som.quantization_error(som.assign(data, names, codes))


@query
def assign_vectors(spark, folder):
    """Nearest label mean of every embedding."""
    data, names, codes = _label_codes(spark, folder)
    return som.assign(data, names, codes).select("vec_id", "node", "dist")


@query
def assign_cluster(spark, folder):
    found = springs.assigned(spark, folder).select("run", "date", "node", "dist")
    return found.join(springs.codebook(spark, folder).select("run", "node", "cluster"), ["run", "node"])


@query
def permanova_f(spark, folder):
    data = springs.scaled_features(spark, folder).join(springs.day_clusters(spark, folder), "date")
    four = permanova.pseudo_f(data, "cluster", FEATURES, power=4).withColumn("power", F.lit(4))
    return reshape.bind_rows(four, permanova.pseudo_f(data, "cluster", FEATURES, power=2).withColumn("power", F.lit(2)))


@query
def permanova_p(spark, folder):
    data = springs.scaled_features(spark, folder).join(springs.day_clusters(spark, folder), "date")
    return permanova.permanova(data, "date", "cluster", FEATURES)


@query
def permanova_permuted(spark, folder):
    """Pseudo-F of every permutation of the days' clusters."""
    data = springs.scaled_features(spark, folder).join(springs.day_clusters(spark, folder), "date")
    return permanova.permuted_f(data, "date", "cluster", FEATURES)


@query
def minmax_scale(spark, folder):
    return scaling.min_max(r.table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.lit(1.0).alias("constant")), ["size", "price", "constant"])


@query
def zscore(spark, folder):
    return scaling.z_scores(r.table(spark, folder, "events").select("event_id", "value"), ["value"])


@query
def cluster_zscore_quartiles(spark, folder):
    """Quartiles of the drivers' z-scores per cluster, scaled over all rows of both sites."""
    scaled = scaling.z_scores(yields.four_clusters(spark, folder), FEATURES)
    named = scaled.withColumn("cluster", F.concat_ws(" ", F.lit("Cluster"), "cluster"))
    long = reshape.to_long(named, ["cluster"], FEATURES)
    return quantiles.exact_quantiles(long, ["cluster", "var"], "value", {"q2": 0.25, "median": 0.5, "q3": 0.75})


@query
def weight_features(spark, folder):
    return scaling.weight(springs.scaled_features(spark, folder), {"precip_mm": 0.5, "snow_dep_m": 2.0})


@query
def kmeans_elbow(spark, folder):
    """From starts that an integer hash of the day picks."""
    day = F.date_diff("date", F.lit("1970-01-01").cast("date")).cast("long")
    return sizing.kmeans_elbow(springs.scaled_features(spark, folder), FEATURES, start=[day * 7919 % 10007, F.col("date")])


@query
def kmeans_single(spark, folder):
    """The first point of the elbow: the total sum of squares."""
    data = springs.scaled_features(spark, folder)
    return data.agg(sum((F.var_samp(c) * (F.count(c) - 1) for c in FEATURES), F.lit(0.0)).alias("wss"))


@query
def lattice_size(spark, folder):
    return sizing.lattice_size(springs.features(spark, folder), FEATURES)


@query
def grid_from_data(spark, folder):
    """The five lattices that suit the spring days best."""
    return sizing.grid_from_data(springs.features(spark, folder), FEATURES)


@query
def weights_pca(spark, folder):
    """Loadings of the spring drivers on their first principal component."""
    found = moments.first_loadings(springs.features(spark, folder), FEATURES)
    return spark.createDataFrame(list(found.items()), "feature string, weight double")


@query
def som_rates(spark, folder):
    """The same map with the published rates, with slow ones in few passes, and without any."""
    runs = [GRID[2] | {"run": i, **more} for i, more in enumerate(({"iterations": 1500, "alpha_coarse": 0.05, "alpha_fine": 0.01}, {"iterations": 3, "alpha_coarse": 0.02, "alpha_fine": 0.001}, {}), 1)]
    data = springs.scaled_features(spark, folder)
    codes, _ = som.fit(data, "date", FEATURES, runs)
    return som.quantization_error(som.assign(data.select("date", *FEATURES), FEATURES, codes))


@query
def node_count(spark, folder):
    return sizing.node_count(springs.features(spark, folder))


@query
def lm_simple(spark, folder):
    """Price on quantity for every return flag."""
    return models.linear_fit(r.table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query
def lm_pvalue(spark, folder):
    """Price on discount, per part with few rows each and per return flag with many."""
    lines = r.table(spark, folder, "lineitem").select("l_extendedprice", "l_discount", F.col("l_partkey").cast("string").alias("part"), "l_returnflag")
    by_part = models.linear_fit(lines, "l_extendedprice", "l_discount", ["part"]).select(F.col("part").alias("id"), "n", "p_value")
    by_flag = models.linear_fit(lines, "l_extendedprice", "l_discount", ["l_returnflag"])
    return by_part.unionByName(by_flag.select(F.col("l_returnflag").alias("id"), "n", "p_value"))


@query
def lm_subset(spark, folder):
    """Deepest snow on year, for all years and for the later ones."""
    peaks = yields.deepest_snow(compiled(spark, folder))
    later = peaks.where(F.col("wyear") >= 1998)
    both = reshape.bind_rows(peaks.withColumn("years", F.lit("all")), later.withColumn("years", F.lit("later")))
    return models.linear_fit(both, "snow_dep_m", "wyear", ["years"]).drop("p_value")


@query
def lm_fitted(spark, folder):
    spring = compiled(spark, folder).where(daily_plan.spring(F.col("date"))).select("site", "date", "temp_avg", "temp_avg_vwc")
    return models.fitted_line(spring, "temp_avg_vwc", "temp_avg", ["site"])


@query
def lm_band(spark, folder):
    """Fitted temperature of every spring day with the bounds of its line's 95 % band, per site and year."""
    spring = compiled(spark, folder).where(daily_plan.spring(F.col("date"))).select("site", "wyear", "date", "temp_avg", "temp_avg_vwc")
    return models.fitted_band(spring, "temp_avg_vwc", "temp_avg", ["site", "wyear"])


@query
def lm_band_grid(spark, folder):
    """Price in thousands on quantity at 80 places per return flag and status, with a 99 % band."""
    price = (F.col("l_extendedprice") / 1000).alias("price")
    lines = r.table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", price)
    return models.band_grid(lines, "price", "l_quantity", ["l_returnflag", "l_linestatus"], 0.99)


@query
def lm_table(spark, folder):
    return yields.regressions(spark, folder).drop("p_value")


@query
def lm_table_pvalue(spark, folder):
    return yields.regressions(spark, folder).select("model", "n", "p_value")


@query
def corr_test(spark, folder):
    y = yields.yield_differences(compiled(spark, folder))
    absolute = models.correlation(y, "WBminusRB_abs_spr", "WBminusRB_abs_end").withColumn("kind", F.lit("abs"))
    relative = models.correlation(y, "WBminusRB_per_spr", "WBminusRB_per_end").withColumn("kind", F.lit("per"))
    return reshape.bind_rows(absolute, relative)


@query
def corr_cross(spark, folder):
    return models.correlation_ranking(springs.features(spark, folder), FEATURES, max_p=1.0)


@query
def corr_wide(spark, folder):
    """The 200 strongest of all correlations between the dimensions of the embeddings, one in nine values unknown."""
    data, names = _vectors(spark, folder)
    holes = {n: F.when((F.col("vec_id") + i) % 9 != 0, F.col(n)) for i, n in enumerate(names)}
    return models.correlation_ranking(data.select("vec_id", *[c.alias(n) for n, c in holes.items()]), names, max_p=1.0, top=200)


@query
def corr_cross_significant(spark, folder):
    return models.correlation_ranking(springs.features(spark, folder), FEATURES)


@query
def cluster_profile(spark, folder):
    data = springs.scaled_features(spark, folder).join(springs.day_clusters(spark, folder), "date")
    return som.cluster_profile(data, "cluster", FEATURES)


@query
def run_ranking(spark, folder):
    """The upper half by pseudo-F with lattice labels and the error on the pseudo-F axis."""
    runs = r.sweep_scores(spark, folder)
    median = quantiles.exact_quantiles(runs, [], "npf", {"m": 0.5}).scalar()
    factor = median / runs.agg(F.max("qe")).scalar()
    label = F.concat(F.concat_ws("x", "rows", "cols"), F.lit("_"), F.col("clusters"), F.lit("cl_"), F.col("run"))
    half = ranking.upper_half(runs, "npf", "run").withColumn("coeff", factor)
    return half.select(label.alias("latID"), "npf", "coeff", (F.col("qe") * F.col("coeff")).alias("qe_scaled"))


@query
def run_pick(spark, folder):
    """Runs picked by hand, largest pseudo-F first."""
    picked = r.sweep_scores(spark, folder).where(F.col("run").isin(9, 17, 22))
    return ranking.sort_rows(columns.on_each(picked, ["npf", "qe"], lambda c: F.round(c, 3)), "-npf")


@query
def node_quality(spark, folder):
    return som.node_quality(springs.assigned(spark, folder))


@query
def u_matrix(spark, folder):
    return som.u_matrix(springs.codebook(spark, folder))


@query
def component_planes(spark, folder):
    return som.component_planes(springs.codebook(spark, folder), FEATURES)


# --- tables behind figures ---------------------------------------------------


@query
def figure_cumulative_curves(spark, folder):
    """Percent of annual runoff per site and of rain, in long form by year and day."""
    days = compiled(spark, folder).where(F.col("site").isNotNull())
    ids = ["wyear", "date", "doy_wyear"]
    wide = reshape.to_wide(days, ids, "site", r.SITES, ["q_mm_per", "precip_mm_per"])
    return reshape.to_long(wide, ids, ["q_mm_per_RB", "q_mm_per_WB", "precip_mm_per_WB"])


@query
def figure_cluster_strips(spark, folder):
    """Cumulative runoff of clustered days with the year's transition date."""
    days = yields.four_clusters(spark, folder)
    marks = yields.transitions(days).withColumnRenamed("date", "transition")
    return days.select("wyear", "date", "site", "cluster", "q_mm_cum").join(marks, "wyear", "left")


@query
def figure_snow_vs_yield(spark, folder):
    return yields.snow_and_yield(compiled(spark, folder), yields.four_clusters(spark, folder))


@query
def figure_snow_curves(spark, folder):
    days = compiled(spark, folder).where(F.col("wyear").isin(1996, 1999))
    return days.select("wyear", "site", "doy_wyear", "date", "snow_dep_m")


# --- streaming ---------------------------------------------------------------


def _event_stream(spark, folder):
    schema = r.table(spark, folder, "events").schema
    stream = rollups.read_stream(spark, folder, schema, "events.parquet", "ts")
    minute = F.floor(F.unix_micros("ts") / 60_000_000) % 60
    value = F.when(minute != 30, F.col("value"))
    return stream.select("ts", F.col("event_type").alias("station"), value.alias("airtemp_c"))


@query
def stream_hourly_mean(spark, folder):
    return rollups.hourly_mean(_event_stream(spark, folder), "ts", "station", ["airtemp_c"])


@query
def stream_daily_total(spark, folder):
    return rollups.daily_total(_event_stream(spark, folder), "ts", "station", "airtemp_c", "airtemp_total")


def _arrivals(spark, folder, width, lateness, values):
    """Events arriving in three loads, some readings two days after their own; the queries stop and go on after each."""
    base = shared_dir(spark, "closing")
    events = r.table(spark, folder, "events").select("event_id", "ts", F.col("event_type").alias("station"), "value")
    tardy = F.when(F.col("event_id") % 37 == 0, 2).otherwise(0)
    load = F.least(F.floor((F.dayofmonth("ts") + tardy) / 11), F.lit(2))
    events = events.withColumn("load", load)
    for i in range(3):
        events.where(F.col("load") == i).drop("load").write.parquet(f"{base}/in/load={i}")
        stream = rollups.read_stream(spark, f"{base}/in/load=*", events.drop("load").schema, "*.parquet", "ts")
        found = closing.roll_up(stream, "ts", ["station"], values, width, lateness, base)
    return base, *found


@query
def stream_hourly_closed(spark, folder):
    """Hourly means of the windows that are closed, from three loads, with their folders merged."""
    values = [F.count(F.lit(1)).alias("n"), F.avg("value").alias("airtemp_c")]
    base, found, _ = _arrivals(spark, folder, "1 hour", "12 hours", values)
    closing.compact(spark, base, found.schema)
    return closing.closed(spark, base, found.schema)


@query
def stream_daily_closed(spark, folder):
    """Daily totals of the days that are closed."""
    return _arrivals(spark, folder, "1 day", "6 hours", [F.count(F.lit(1)).alias("n"), nulls.strict_sum("value").alias("total")])[1]


@query
def stream_late_readings(spark, folder):
    """Readings that came after their hour was closed, with the watermark they met."""
    found = _arrivals(spark, folder, "1 hour", "12 hours", [F.count(F.lit(1)).alias("n")])[2]
    return found.select("event_id", rollups.wall_time(F.col("ts")).alias("ts"), "station", "value", rollups.wall_time(F.col("watermark")).alias("watermark"))
