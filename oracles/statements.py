"""One statement per query, under the query's name."""

from __future__ import annotations

from oracles.views import FEATURES, OUT1, OUT2, WY, statement

ORACLES: dict[str, str] = {}


def add(name: str, body: str, rounds: str = "") -> None:
    ORACLES[name] = statement(body, rounds)


F6 = " ".join(FEATURES)


# --- sources and sinks
add("scan", "SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders", "o_totalprice")
add("scan_typed", "SELECT event_id, date_trunc('minute', ts) AS recordtime, airtemp_c FROM v_sensor", "airtemp_c")
add("scan_multi", "SELECT event_id, airtemp_c, CASE WHEN station < 'm' THEN 0.5::DOUBLE END AS precip FROM v_sensor", "airtemp_c")
add("source_tag", "SELECT event_id, CASE WHEN station < 'm' THEN 'old' ELSE 'new' END AS source FROM v_sensor")
add("sink_roundtrip", f"SELECT site, date, q_mm, {WY} AS wyear FROM v_runoff")
add(
    "retype",
    "SELECT o_orderkey AS key, o_totalprice AS price, TRY_CAST(o_orderpriority AS INTEGER) AS priority, o_orderstatus AS status FROM orders",
    "price",
)
add("scan_inferred", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderpriority FROM orders", "o_totalprice")
add("retype_inferred", "SELECT * FROM orders", "o_totalprice")
add("retype_inferred_pages", "SELECT page_id, nullif(nullif(url, ''), 'NA') AS url, nullif(nullif(html, ''), 'NA') AS html FROM pages")


def inferred(source: str, names: str) -> str:
    """The first type that all texts of a column fit, column after column."""
    kinds = {
        "boolean": "t IN ('TRUE', 'FALSE', 'True', 'False', 'true', 'false', 'T', 'F')",
        "bigint": r"regexp_full_match(t, '[+-]?(0|[1-9][0-9]*)') AND try_cast(t AS BIGINT) IS NOT NULL",
        "double": r"regexp_full_match(t, '[+-]?(0|[1-9][0-9]*)?([.][0-9]*)?([eE][+-]?[0-9]+)?') AND try_cast(t AS DOUBLE) IS NOT NULL",
        "date": r"regexp_full_match(t, '[0-9]{4}(-[0-9]{1,2}-|/[0-9]{1,2}/)[0-9]{1,2}') AND try_cast(replace(t, '/', '-') AS DATE) IS NOT NULL",
        "timestamp_ntz": r"regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+') AND try_cast(t AS TIMESTAMP) IS NOT NULL",
    }
    first = "CASE " + " ".join(f"WHEN bool_and({test}) THEN '{kind}'" for kind, test in kinds.items()) + " ELSE 'string' END"
    label = source.split()[-1].strip("()")
    return " UNION ALL ".join(
        f"SELECT '{label}' AS source, '{c}' AS name, {first} AS type FROM (SELECT trim(CAST({c} AS VARCHAR)) AS t FROM ({source})) WHERE t NOT IN ('', 'NA')" for c in names.split()
    )


SHIPPED = """SELECT * REPLACE (strftime(l_shipdate, '%Y/%-m/%-d') AS l_shipdate, lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS l_suppkey,
    CASE l_linenumber WHEN 1 THEN 'NA' WHEN 2 THEN ' 7 ' ELSE CAST(l_tax AS VARCHAR) END AS l_tax, CASE l_linestatus WHEN 'O' THEN 'T' ELSE 'FALSE' END AS l_linestatus) FROM lineitem"""
add(
    "types_inferred",
    " UNION ALL ".join(
        inferred(s, n)
        for s, n in (
            ("SELECT * FROM orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
            (SHIPPED, "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"),
            ("SELECT * FROM events", "event_id ts user_id event_type value props"),
            ("SELECT * FROM customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
            ("SELECT * FROM pages", "page_id url html"),
        )
    ),
)
add("append_literals", "SELECT * FROM v_snow UNION ALL SELECT * FROM (VALUES (DATE '2003-04-10', NULL), (DATE '2003-05-30', NULL)) AS t(a, b)")
add(
    "date_spine",
    """SELECT CAST(d AS DATE) AS date, coalesce(n, 0) AS n
       FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders) s
       LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) o ON CAST(s.d AS DATE) = o.day""",
)

# --- columns
add("project_rename", "SELECT l_orderkey AS order_id, l_linenumber, l_quantity AS q_mm FROM lineitem")
add("drop_cols", "SELECT * EXCLUDE (o_orderdate, o_orderpriority) FROM orders", "o_totalprice")
add("select_pattern", "SELECT * FROM v_withdraw")
add("select_range", "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders", "o_totalprice")
add("reorder_cols", "SELECT * FROM orders", "o_totalprice")
add("lower_names", "SELECT s_suppkey, s_name, s_acctbal FROM supplier", "s_acctbal")
add("mutate", "SELECT *, snow_dep * 0.0254::DOUBLE AS snow_dep_m, snow_dep * 0.0254::DOUBLE * 100 AS snow_dep_cm FROM v_snow", "snow_dep_m snow_dep_cm")
add("mutate_at", "SELECT wyear, month, use_snowmaking_mm, use_diverted_mm, use_golf_mm FROM v_use")
add("rowwise_sum", "SELECT w.*, u.use_total_mm FROM v_withdraw w JOIN v_use u USING (wyear, month)")
add("scalar_subquery", "SELECT run, qe / (SELECT max(qe) FROM v_runs) AS relative_qe FROM v_runs", "relative_qe")

# --- filters
add("window_of_year", "SELECT site, date, doy_wyear, q_mm FROM v_daily WHERE doy_wyear BETWEEN 170 AND 245")
add("filter_eq", "SELECT * FROM v_runoff WHERE site = 'WB'")
add("filter_in", f"SELECT * FROM (SELECT *, {WY} AS wyear FROM v_runoff) WHERE wyear IN (1996, 1998, 2001)")
HOLE = "(SELECT site, date, CASE WHEN month(date) <> 7 THEN wyear END AS wyear FROM v_daily)"
add("filter_not_in", f"SELECT * FROM {HOLE} WHERE coalesce(wyear NOT IN (1995, 1996), true)")
add("filter_ne", f"SELECT * FROM {HOLE} WHERE wyear <> 1998")
add("filter_notnull", "SELECT * FROM v_snow WHERE snow_dep IS NOT NULL")
add(
    "filter_daterange",
    f"""SELECT date, temp_avg_vwc, pyra AS pyra_wattm2_dailyTot FROM v_logger_days
        WHERE date BETWEEN {OUT1} - 5 AND {OUT2} + 5 AND date <> {OUT1} AND date <> {OUT2}""",
)
add("filter_datepart", "SELECT * FROM v_runoff WHERE month(date) = 3 AND day(date) > 15")
add("complete_cases", "SELECT * FROM v_features", F6)
add(
    "complete_cases_late_window",
    f"""SELECT date, {', '.join(FEATURES)} FROM v_daily
        WHERE doy_wyear BETWEEN 180 AND 245 AND site = 'WB' AND {' AND '.join(f + ' IS NOT NULL' for f in FEATURES)}""",
    F6,
)
AUDIT = "site date precip_mm precip_mm_cum precip_mm_3d snow_dep_m temp_avg_vwc temp_avg_vwc_3d pyra_wattm2_dailyTot use_total_mm_cum use_snow_mm_daily use_total_mm_daily".split()
add(
    "missing_audit",
    f"SELECT {', '.join(AUDIT)} FROM v_spring WHERE {' OR '.join(c + ' IS NULL' for c in AUDIT)}",
    " ".join(AUDIT[2:]),
)

# --- joins
add("join_left", "SELECT date, precip_mm, precip_mm_vwc FROM v_precip LEFT JOIN v_spare USING (date)", "precip_mm precip_mm_vwc")
add(
    "totals_back",
    f"""SELECT site, wyear, date, q_mm, sum(q_mm) OVER p AS q_mm_tot,
               CASE WHEN count(rain) OVER p = count(q_mm) OVER p THEN sum(rain) OVER p END AS precip_mm_tot
        FROM (SELECT site, {WY} AS wyear, date, q_mm,
                     CASE WHEN q_mm IS NOT NULL AND p.d IS NOT NULL THEN coalesce(p.precip_mm, 0) END AS rain
              FROM v_runoff_gaps LEFT JOIN (SELECT date AS d, precip_mm FROM v_precip) p ON date = p.d)
        WINDOW p AS (PARTITION BY site, wyear)""",
    "precip_mm_tot",
)
add("join_full", "SELECT date, precip_mm, snow_dep FROM v_precip FULL JOIN v_snow USING (date)", "precip_mm")
KEYED = f"{WY} AS wyear, CAST(CASE WHEN month(date) <> 7 THEN month(date) END AS INTEGER) AS month"
add(
    "join_full_nullsafe",
    f"""SELECT coalesce(a.wyear, b.wyear) AS wyear, coalesce(a.month, b.month) AS month, q_mm, snow_dep
        FROM (SELECT {KEYED}, sum(q_mm) AS q_mm FROM v_runoff GROUP BY 1, 2) a
        FULL JOIN (SELECT {KEYED}, sum(snow_dep) AS snow_dep FROM v_snow GROUP BY 1, 2) b
          ON a.wyear = b.wyear AND a.month IS NOT DISTINCT FROM b.month""",
)
add(
    "join_full_chain",
    "SELECT * FROM v_precip FULL JOIN v_spare USING (date) FULL JOIN v_snow USING (date) FULL JOIN v_airport USING (date)",
    "precip_mm precip_mm_vwc temp_min temp_max temp_avg",
)
add(
    "join_coarse",
    f"""SELECT d.*, w.* EXCLUDE (wyear, month)
        FROM (SELECT *, {WY} AS wyear, CAST(month(date) AS INTEGER) AS month FROM v_runoff) d
        LEFT JOIN v_withdraw w ON d.wyear = w.wyear AND d.month = w.month""",
)
add("reattach", "SELECT date, cluster, site, wyear, q_mm FROM v_assigned LEFT JOIN v_spring USING (date)")
add(
    "reattach_full_year",
    """SELECT d.site, d.date, wyear, doy_wyear, q_mm_cum, cluster
       FROM (SELECT site, date, wyear, doy_wyear, q_mm_cum FROM v_daily) d
       FULL JOIN (SELECT site, date, cluster FROM v_4cl) c ON d.site IS NOT DISTINCT FROM c.site AND d.date = c.date
       WHERE coalesce(wyear <> 1995, true) AND d.site IS NOT NULL""",
    "q_mm_cum",
)
add(
    "zip_by_obs",
    """SELECT a.obs, a.date, a.precip_mm, b.cluster FROM (SELECT row_number() OVER (ORDER BY date) AS obs, * FROM v_features) a
       JOIN (SELECT row_number() OVER (ORDER BY date) AS obs, cluster FROM v_assigned) b USING (obs)""",
    "precip_mm",
)

# --- aggregates
add(
    "sum_strict",
    f"""SELECT site, {WY} AS wyear, CAST(month(date) AS INTEGER) AS month, CASE WHEN count(q_mm) = count(*) THEN sum(q_mm) END AS q_mm_tot
        FROM v_runoff_gaps GROUP BY 1, 2, 3""",
)
add("mean_strict", "SELECT date, temp_avg_vwc FROM v_logger_days")
add("hourly_mean", "SELECT date_trunc('hour', ts) AS time_hourly, station, avg(airtemp_c) AS airtemp_c FROM v_sensor GROUP BY 1, 2", "airtemp_c")
add("mean_sd", "SELECT avg(snow_dep * 2.54) AS mean, stddev_samp(snow_dep * 2.54) AS sd FROM v_snow WHERE snow_dep > 0", "mean sd")
add("group_max", f"SELECT {WY} AS wyear, max(snow_dep) AS snow_depth_max FROM v_snow GROUP BY 1")
add(
    "quartiles",
    """SELECT station, quantile_cont(airtemp_c, 0.25) AS q2, quantile_cont(airtemp_c, 0.5) AS median, quantile_cont(airtemp_c, 0.75) AS q3
       FROM v_sensor GROUP BY 1""",
    "q2 median q3",
)


def box(source: str, group: str) -> str:
    q = f"""SELECT {group}, var, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
            FROM ({source}) GROUP BY 1, 2"""
    inside = "value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""SELECT {group}, var, q1, median, q3, min(value) AS low, max(value) AS high,
                      min(value) FILTER ({inside}) AS whisker_low, max(value) FILTER ({inside}) AS whisker_high
               FROM ({source}) JOIN ({q}) USING ({group}, var) GROUP BY ALL"""


BOX = "q1 median q3 low high whisker_low whisker_high"
LINES = " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS var, {c} AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))
DAYS = " UNION ALL ".join(f"SELECT cluster, '{f}' AS var, {f} AS value FROM v_4cl" for f in FEATURES)
add("box_stats", box(LINES, "l_returnflag"), BOX)
add("box_stats_clusters", box(DAYS, "cluster"), BOX)
POINTS = " UNION ALL ".join(f"SELECT site, date, cluster, '{f}' AS var, {f} AS value FROM v_4cl" for f in FEATURES)
add(
    "box_outliers",
    f"""SELECT site, date, cluster, var, value FROM ({POINTS})
        JOIN (SELECT cluster, var, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ({POINTS}) GROUP BY 1, 2) USING (cluster, var)
        WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "value",
)
add("count_groups", "SELECT station, CAST(ts AS DATE) AS date, count(*) AS n FROM v_sensor GROUP BY 1, 2")
add("count_share", "SELECT * FROM v_shares", "n_cl_all_prop")
add("distinct_count", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(value) AS n_value FROM events GROUP BY 1")

# --- ordered series
add("row_number", f"SELECT *, {WY} AS wyear, row_number() OVER (PARTITION BY site, {WY} ORDER BY date) AS doy_wyear FROM v_runoff")
add(
    "cumsum_strict",
    f"""SELECT *, CASE WHEN count(*) OVER w = count(q_mm) OVER w THEN sum(q_mm) OVER w END AS q_mm_cum
        FROM (SELECT *, {WY} AS wyear FROM v_runoff_gaps) WINDOW w AS (PARTITION BY site, wyear ORDER BY date ROWS UNBOUNDED PRECEDING)""",
)
add(
    "cum_percent",
    """SELECT site, date, q_mm, wyear, q_mm_cum, q_mm_cum / sum(q_mm) OVER (PARTITION BY site, wyear) * 100 AS q_mm_per FROM v_station""",
    "q_mm_per",
)
GAUGE = "WINDOW w AS (PARTITION BY site ORDER BY date ROWS 2 PRECEDING)"
add("rolling_sum", f"SELECT *, CASE WHEN count(q_mm) OVER w = 3 THEN sum(q_mm) OVER w END AS q_mm_3d FROM v_runoff_gaps {GAUGE}")
add("rolling_mean", f"SELECT *, CASE WHEN count(q_mm) OVER w = 3 THEN avg(q_mm) OVER w END AS q_mm_3d_mean FROM v_runoff_gaps {GAUGE}", "q_mm_3d_mean")
add("rolling_mode", "SELECT wyear, date, cluster, cluster_mode FROM v_mode")


def locf(source: str, keep: str, cols: list[str], part: str, order: str, gap: int) -> str:
    inner = ", ".join(f"count({c}) OVER w AS i_{c}, last_value({c} IGNORE NULLS) OVER w AS l_{c}" for c in cols)
    group = lambda c: ", ".join(filter(None, [part, f"i_{c}"]))
    outer = ", ".join(
        f"CASE WHEN {c} IS NULL AND count(*) FILTER ({c} IS NULL) OVER (PARTITION BY {group(c)}) <= {gap} THEN l_{c} ELSE {c} END AS {c}" for c in cols
    )
    by = f"PARTITION BY {part} " if part else ""
    return f"SELECT {keep}, {outer} FROM (SELECT *, {inner} FROM {source} WINDOW w AS ({by}ORDER BY {order} ROWS UNBOUNDED PRECEDING))"


add("fill_locf", locf("v_airport", "date", ["temp_min", "temp_max"], "", "date", 2))
add("fill_linear", "SELECT * FROM v_snow_filled", "snow_dep_m")
add("row_number_long", "SELECT event_id, station, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) AS n FROM v_sensor")
add(
    "cumsum_strict_long",
    """SELECT event_id, event_type AS station,
              CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v_cum
       FROM events""",
)
add(
    "rolling_mean_long",
    """SELECT event_id, station, CASE WHEN count(airtemp_c) OVER w = 3 THEN avg(airtemp_c) OVER w END AS mean3
       FROM v_sensor WINDOW w AS (PARTITION BY station ORDER BY ts, event_id ROWS 2 PRECEDING)""",
    "mean3",
)
add("fill_locf_long", locf("v_sensor", "event_id, station", ["airtemp_c"], "station", "ts, event_id", 2), "airtemp_c")
add(
    "fill_linear_long",
    """SELECT event_id, station,
              CASE WHEN v IS NOT NULL THEN v
                   WHEN count(*) FILTER (v IS NULL) OVER (PARTITION BY station, island) <= 10 THEN py + (qy - py) * ((x - px) / (qx - px)) END AS airtemp_c
       FROM (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER a AS px, last_value(v IGNORE NULLS) OVER a AS py,
                    first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER z AS qx, first_value(v IGNORE NULLS) OVER z AS qy,
                    count(v) OVER a AS island
             FROM (SELECT event_id, station, airtemp_c AS v, ts, CAST(epoch_us(ts) AS DOUBLE) AS x FROM v_sensor)
             WINDOW a AS (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING),
                    z AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "airtemp_c",
)
add(
    "last_per_group",
    f"SELECT site, wyear, max(date) AS date, arg_max(q_mm, date) AS q_mm FROM (SELECT *, {WY} AS wyear FROM v_runoff) GROUP BY 1, 2",
)
add(
    "argmax_row",
    f"""SELECT wyear, date, snow_dep FROM (SELECT *, {WY} AS wyear FROM v_snow WHERE snow_dep IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY wyear ORDER BY snow_dep DESC, date) = 1""",
)
add("from_first_match", "SELECT wyear, date, cluster FROM v_warm")
add("to_first_match", "SELECT wyear, date, cluster FROM v_cold")
add("from_last_match", "SELECT site, wyear, date, cluster FROM v_lastcold")
add("first_transition", "SELECT * FROM v_transition")

# --- ranking
add("sort_multi", "SELECT station, airtemp_c, event_id FROM v_sensor ORDER BY 1, 2 DESC NULLS LAST, 3", "airtemp_c")
HALF = "SELECT * FROM v_runs QUALIFY row_number() OVER (ORDER BY npf DESC, run) <= count(*) OVER () // 2"
add("top_half", f"SELECT run, npf FROM ({HALF})", "npf")
add(
    "best_run_auto",
    f"SELECT clusters, run, npf, qe FROM ({HALF}) QUALIFY row_number() OVER (PARTITION BY clusters ORDER BY qe, npf DESC, run) = 1",
    "npf qe",
)
add(
    "topk_group",
    f"""SELECT date, precip_mm, wyear, precip_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY wyear ORDER BY precip_mm DESC NULLS LAST, date) AS precip_rank
              FROM (SELECT *, {WY} AS wyear FROM v_precip)) WHERE precip_rank <= 3""",
    "precip_mm",
)

# --- reshaping
add("union_fill", "SELECT date, snow_dep, CAST(NULL AS DOUBLE) AS precip_mm FROM v_snow UNION ALL SELECT date, NULL, precip_mm FROM v_precip", "precip_mm")
add(
    "replace_range",
    f"""SELECT date, pyra AS pyra_wattm2_dailyTot FROM v_logger_days WHERE NOT date BETWEEN {OUT1} AND {OUT2}
        UNION ALL SELECT CAST(d AS DATE), -1.0::DOUBLE FROM generate_series({OUT1}, {OUT2}, INTERVAL 1 DAY) AS g(d)""",
)
add("unpivot", " UNION ALL ".join(f"SELECT date, '{c}' AS var, {c} AS value FROM v_airport" for c in ("temp_min", "temp_max", "temp_avg")), "value")
add("pivot_one", "SELECT date, max(q_mm) FILTER (site = 'RB') AS RB, max(q_mm) FILTER (site = 'WB') AS WB FROM v_runoff GROUP BY 1")
KINDS = ("click", "error", "purchase", "signup", "view")
add(
    "pivot_multi",
    "SELECT date, "
    + ", ".join(f"max(n) FILTER (station = '{k}') AS n_{k}, max(share) FILTER (station = '{k}') AS share_{k}" for k in KINDS)
    + """ FROM (SELECT date, station, n, n / sum(n) OVER (PARTITION BY date) AS share
                FROM (SELECT CAST(ts AS DATE) AS date, station, count(*) AS n FROM v_sensor GROUP BY 1, 2)) GROUP BY 1""",
    " ".join(f"share_{k}" for k in KINDS),
)

# --- scalar functions
add(
    "str_funcs",
    """SELECT p_partkey, left(p_brand, 2) AS head, right(p_brand, 3) AS tail, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS number,
              concat_ws('_', p_name, p_type) AS pasted, 'id' || p_partkey AS pasted0, lower(p_type) AS lowered FROM part""",
)
add(
    "date_parse",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso,
              TRY_CAST(year(o_orderdate) || '-02-' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') AS DATE) AS february,
              date_trunc('day', o_orderdate) + INTERVAL 545 MINUTE AS stamp, strftime(o_orderdate, '%Y-%m-%d') AS as_text FROM orders""",
)
add(
    "date_parts",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS mday, CAST(ts AS DATE) AS date
       FROM events""",
)
add(
    "water_year",
    f"""SELECT o_orderkey, {WY} AS wyear, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)""",
)
add("cond_null", "SELECT date, CASE WHEN snow_dep IS NULL THEN NULL WHEN snow_dep > 5 THEN 'deep' ELSE 'shallow' END AS class FROM v_snow")
add("fill_const", "SELECT date, coalesce(precip_mm, 0) AS precip_mm FROM v_precip", "precip_mm")
add("coalesce_src", "SELECT date, coalesce(precip_mm, precip_mm_vwc) AS precip_mm FROM v_precip LEFT JOIN v_spare USING (date)", "precip_mm")
add(
    "math_funcs",
    """SELECT o_orderkey, round(o_totalprice / 7.0::DOUBLE, 3) AS rounded, round_even(o_orderkey / 2.0::DOUBLE, 0) AS half_even,
              sqrt(o_totalprice) AS root, -o_totalprice AS negated FROM orders""",
    "half_even root negated",
)
add(
    "category_order",
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS INTEGER) AS level
       FROM orders""",
)

# --- domain compositions
add(
    "tidy_wide_year",
    """SELECT site, wyear, date, doy_wyear, q_mm
       FROM (SELECT c.site, c.wyear, c.date, row_number() OVER (PARTITION BY c.site, c.wyear ORDER BY c.date) AS doy_wyear, r.q_mm
             FROM (SELECT site, CAST(wyear AS INTEGER) AS wyear,
                          TRY_CAST((wyear - CASE WHEN m >= 10 THEN 1 ELSE 0 END) || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS date
                   FROM (SELECT DISTINCT month(date) AS m, day(date) AS d FROM v_runoff), (VALUES ('RB'), ('WB')) s(site), (SELECT DISTINCT wyear FROM (SELECT """ + WY + """ AS wyear FROM v_runoff)) y) c
             LEFT JOIN v_runoff r ON c.site = r.site AND c.date = r.date WHERE c.date IS NOT NULL)""",
)
add("precip_fallback", "SELECT date, coalesce(precip_mm, precip_mm_vwc, 0) AS precip_mm FROM v_precip LEFT JOIN v_spare USING (date)", "precip_mm")
add("temp_mid", "SELECT date, coalesce(temp_avg, (temp_min + temp_max) / 2) AS temp_avg FROM v_airport", "temp_avg")
add(
    "fill_regression",
    f"""SELECT date, t AS temp_avg_vwc, CASE WHEN count(t) OVER w = 3 THEN avg(t) OVER w END AS temp_avg_vwc_3d
        FROM (SELECT date, CASE WHEN date BETWEEN {OUT1} AND {OUT2} THEN slope * temp_avg + intercept ELSE temp_avg_vwc END AS t
              FROM v_logger_days FULL JOIN v_airport USING (date),
                   (SELECT regr_slope(temp_avg_vwc, temp_avg) AS slope, regr_intercept(temp_avg_vwc, temp_avg) AS intercept
                    FROM v_logger_days JOIN v_airport USING (date) WHERE month(date) BETWEEN 3 AND 5))
        WINDOW w AS (ORDER BY date ROWS 2 PRECEDING)""",
    "temp_avg_vwc temp_avg_vwc_3d",
)
add("fill_neighbour_mean", "SELECT * FROM v_pyr", "pyra_wattm2_dailyTot")
add(
    "monthly_to_daily",
    f"""SELECT d.site, d.date, d.q_mm, d.wyear, use_total_mm_cum, use_snowmaking_mm / days AS use_snow_mm_daily, use_total_mm / days AS use_total_mm_daily
        FROM (SELECT *, {WY} AS wyear, max(day(date)) OVER (PARTITION BY year(date), month(date)) AS days FROM v_runoff) d
        LEFT JOIN v_use u ON u.wyear = d.wyear AND u.year = year(d.date) AND u.month = month(d.date)""",
    "use_snow_mm_daily use_total_mm_daily",
)
add(
    "compile_daily",
    "SELECT * FROM v_daily",
    "q_mm q_mm_cum precip_mm temp_avg temp_max temp_min precip_mm_cum q_mm_per precip_mm_per precip_mm_3d snow_dep_m temp_avg_vwc temp_avg_vwc_3d "
    "pyra_wattm2_dailyTot use_total_mm_cum use_snow_mm_daily use_total_mm_daily",
)
YIELDS = "WBminusRB_abs_spr WBminusRB_per_spr WBminusRB_abs_end WBminusRB_per_end"
add(
    "paired_yield_diff",
    """SELECT * FROM (SELECT wyear, wb - rb AS WBminusRB_abs_spr, (wb - rb) / rb AS WBminusRB_per_spr
                      FROM (SELECT wyear, arg_max(q_mm_cum, date) FILTER (site = 'WB') AS wb, arg_max(q_mm_cum, date) FILTER (site = 'RB') AS rb
                            FROM v_station WHERE doy_wyear BETWEEN 170 AND 245 GROUP BY 1))
       FULL JOIN (SELECT wyear, wb - rb AS WBminusRB_abs_end, (wb - rb) / rb AS WBminusRB_per_end
                  FROM (SELECT wyear, arg_max(q_mm_cum, date) FILTER (site = 'WB') AS wb, arg_max(q_mm_cum, date) FILTER (site = 'RB') AS rb
                        FROM v_station GROUP BY 1)) USING (wyear)""",
    YIELDS,
)
add("paired_diff_after_event", "SELECT * FROM v_q_lastcold", "WBminusRB_abs_lastcold")
add("sum_after_event", "SELECT * FROM v_rain_lastcold FULL JOIN v_yields USING (wyear)", "precip_mm_lastcold " + YIELDS)
add("period_ratio", "SELECT wyear, cold, warm, prop_warm2cold FROM v_ratio", "prop_warm2cold")
add(
    "share_contrib",
    """SELECT wyear, cluster, n_cl_all_prop * WBminusRB_abs_spr AS clContr_abs, n_cl_all_prop * WBminusRB_per_spr AS clContr_per
       FROM v_shares JOIN v_yields USING (wyear) WHERE SOMversion = '4cl'""",
    "clContr_abs clContr_per",
)
PROPS = " ".join(f"n_cl_all_prop_{k}" for k in (1, 2, 3, 4))
add("cluster_counts_wide", "SELECT * FROM v_counts_wide", PROPS + " n_cl_all_prop_3and4")
add("cluster_counts_warm", "SELECT * FROM v_warm_wide", PROPS.replace("all", "warm") + " prop_cold2warm")
add(
    "peak_day_stats",
    """SELECT avg(doy_wyear) AS mean_day, stddev_samp(doy_wyear) AS sd_day, avg(snow_dep_m) AS mean_depth, stddev_samp(snow_dep_m) AS sd_depth FROM v_peaks""",
    "mean_day sd_day mean_depth sd_depth",
)

# --- statistics and learning
add("som_qe", "SELECT 1 AS run, avg(dist) AS qe FROM v_assigned", "qe")
add("assign_cluster", "SELECT 1 AS run, node, date, dist, cluster FROM v_assigned", "dist")
LABEL_DIST = """
    SELECT vec_id, CAST(c.label + 1 AS INTEGER) AS node, list_sum(list_transform(list_zip(e.x, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) e,
         (SELECT label, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1) c
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, node) = 1"""
add("assign_vectors", LABEL_DIST, "dist")
add("som_qe_vectors", f"SELECT 1 AS run, avg(dist) AS qe FROM ({LABEL_DIST})", "qe")

add(
    "som_epoch",
    f"""WITH won AS ({LABEL_DIST}),
             per_node AS (SELECT node, i, sum(CAST(embedding[i] AS DOUBLE)) AS s, count(*) AS n
                          FROM won JOIN embeddings USING (vec_id), range(1, 65) r(i) GROUP BY 1, 2),
             grid AS (SELECT CAST(node AS INTEGER) AS node, (node - 1) % 5 + 1 + (((node - 1) // 5 + 1) % 2) * 0.5::DOUBLE AS gx,
                             ((node - 1) // 5 + 1) * sqrt(3.0::DOUBLE) / 2 AS gy FROM range(1, 11) g(node))
        SELECT 1 AS run, a.node, 'x' || (i - 1) AS var, sum(s) / sum(n) AS value
        FROM grid a JOIN grid b ON (a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy) <= 1.000001
        JOIN per_node p ON p.node = b.node GROUP BY 1, 2, 3""",
    "value",
)


def pair_f(power: int) -> str:
    d2 = "(" + " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATURES) + ")"
    d = d2 if power == 2 else f"{d2} * {d2}"
    return f"""SELECT n, k, ((sst - ssw) / (k - 1)) / (ssw / nullif(n - k, 0)) AS f, {power} AS power
        FROM (SELECT (SELECT count(*) FROM v_labelled) AS n, (SELECT count(DISTINCT cluster) FROM v_labelled) AS k,
                     (SELECT sum({d}) FROM v_labelled a, v_labelled b) / (2 * (SELECT count(*) FROM v_labelled)) AS sst,
                     (SELECT sum(s / (2 * c)) FROM (SELECT a.cluster, sum({d}) AS s, (SELECT count(*) FROM v_labelled x WHERE x.cluster = a.cluster) AS c
                                                    FROM v_labelled a JOIN v_labelled b ON a.cluster = b.cluster GROUP BY a.cluster)) AS ssw)"""


add("permanova_f", pair_f(4) + " UNION ALL " + pair_f(2), "f")
add(
    "minmax_scale",
    """SELECT p_partkey, (size - min(size) OVER ()) / nullif(max(size) OVER () - min(size) OVER (), 0) AS size,
              (price - min(price) OVER ()) / nullif(max(price) OVER () - min(price) OVER (), 0) AS price, CAST(NULL AS DOUBLE) AS constant
       FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part)""",
    "size price",
)
add("zscore", "SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS value FROM events", "value")
Z = " UNION ALL ".join(
    f"SELECT 'Cluster ' || cluster AS cluster, '{f}' AS var, ({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS value FROM v_4cl" for f in FEATURES
)
add(
    "cluster_zscore_quartiles",
    f"SELECT cluster, var, quantile_cont(value, 0.25) AS q2, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM ({Z}) GROUP BY 1, 2",
    "q2 median q3",
)
add("weight_features", "SELECT * REPLACE (precip_mm * 0.5::DOUBLE AS precip_mm, snow_dep_m * 2.0::DOUBLE AS snow_dep_m) FROM v_scaled", F6)
add("kmeans_single", "SELECT " + " + ".join(f"var_samp({f}) * (count({f}) - 1)" for f in FEATURES) + " AS wss FROM v_scaled", "wss")
add("node_count", "SELECT count(*) AS n, CAST(round(5 * sqrt(count(*))) AS BIGINT) AS nodes FROM v_features")


def fit(y: str, x: str) -> str:
    known = lambda f: f"CASE WHEN NOT isnan({f}({y}, {x})) THEN {f}({y}, {x}) END"
    r2 = known("regr_r2")
    n = f"regr_count({y}, {x})"
    return f"""CAST({n} AS BIGINT) AS n, {known("regr_slope")} AS slope, {known("regr_intercept")} AS intercept, {r2} AS r2,
               CASE WHEN {n} > 2 THEN 1 - (1 - {r2}) * ({n} - 1) / (CAST({n} AS BIGINT) - 2) END AS adj_r2"""


FIT = "slope intercept r2 adj_r2"
def tail(r2: str, n: str) -> str:
    """Two-sided p of a correlation, by Simpson's rule over the t density written in the angle of the statistic."""
    dof = f"({n} - 2)"
    angle = f"atan(sqrt({r2} / (1 - {r2})))"
    height = f"pow(cos({angle} * i / 2000.0::DOUBLE), {dof} - 1)"
    area = f"""list_sum(list_transform(range(0, 2001), lambda i: {height} * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) * {angle} / 6000.0::DOUBLE"""
    scale = f"2 / sqrt(pi()) * exp(lgamma(({dof} + 1) / 2.0::DOUBLE) - lgamma({dof} / 2.0::DOUBLE))"
    return f"CASE WHEN {dof} >= 1 THEN CASE WHEN {r2} >= 1 THEN 0 ELSE greatest(1 - {scale} * {area}, 0) END END"


def tails(source: str, keys: str) -> str:
    return f"""SELECT {keys}, n, {tail('r2', 'n')} AS p_value
               FROM (SELECT {keys}, CAST(regr_count(y, x) AS BIGINT) AS n, corr(y, x) * corr(y, x) AS r2 FROM ({source}) GROUP BY ALL)"""


add(
    "lm_pvalue",
    tails(
        """SELECT CAST(l_partkey AS VARCHAR) AS id, l_extendedprice AS y, l_discount AS x FROM lineitem
           UNION ALL SELECT l_returnflag, l_extendedprice, l_discount FROM lineitem""",
        "id",
    ),
    "p_value",
)
add("lm_simple", f"SELECT *, {tail('r2', 'n')} AS p_value FROM (SELECT l_returnflag, {fit('l_extendedprice', 'l_quantity')} FROM lineitem GROUP BY 1)", FIT + " p_value")
add(
    "lm_subset",
    f"""SELECT years, {fit('snow_dep_m', 'wyear')}
        FROM (SELECT 'all' AS years, * FROM v_peaks UNION ALL SELECT 'later', * FROM v_peaks WHERE wyear >= 1998) GROUP BY 1""",
    FIT,
)
add(
    "lm_fitted",
    """SELECT site, date, d.temp_avg, d.temp_avg_vwc, intercept + slope * d.temp_avg AS fitted
       FROM (SELECT * FROM v_daily WHERE month(date) BETWEEN 3 AND 5) d
       LEFT JOIN (SELECT site AS s, regr_slope(temp_avg_vwc, temp_avg) AS slope, regr_intercept(temp_avg_vwc, temp_avg) AS intercept
                  FROM v_daily WHERE month(date) BETWEEN 3 AND 5 GROUP BY 1) m ON d.site IS NOT DISTINCT FROM m.s""",
    "temp_avg temp_avg_vwc fitted",
)


def band(source: str, keys: str, x: str, at: str, level: float, extra: str = "") -> str:
    """Lines of (y, x) per group with the bounds at the places of ``at``: quantiles by halving an interval, no closed form."""
    area = tail("(t * t / (dof + t * t))", "(dof + 2)")
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM f.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE f AS MATERIALIZED (
            SELECT {keys}, regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_avgx(y, x) AS mid,
                   regr_sxx(y, x) AS sxx, greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) AS sse,
                   min(x) FILTER (y IS NOT NULL) AS low, max(x) FILTER (y IS NOT NULL) AS high
            FROM ({source}) GROUP BY ALL),
        half AS (
            SELECT DISTINCT CAST(n AS BIGINT) - 2 AS dof, 0::DOUBLE AS a, 20::DOUBLE AS b, 0 AS k FROM f WHERE n > 2
            UNION ALL
            SELECT dof, CASE WHEN p > {1 - level}::DOUBLE THEN t ELSE a END, CASE WHEN p > {1 - level}::DOUBLE THEN b ELSE t END, k + 1
            FROM (SELECT *, {area} AS p FROM (SELECT *, (a + b) / 2 AS t FROM half)) WHERE k < 50),
        q AS (SELECT dof, (a + b) / 2 AS t FROM half WHERE k = 50),
        g AS (SELECT a.*, slope, intercept, mid, sxx, sse, n, t FROM ({at}) a LEFT JOIN f ON {same} LEFT JOIN q ON q.dof = f.n - 2)
        SELECT * EXCLUDE (slope, intercept, mid, sxx, sse, n, t{extra}), intercept + slope * {x} AS fitted,
               intercept + slope * {x} - t * sqrt(sse / (n - 2) * (1.0::DOUBLE / n + ({x} - mid) * ({x} - mid) / sxx)) AS lower,
               intercept + slope * {x} + t * sqrt(sse / (n - 2) * (1.0::DOUBLE / n + ({x} - mid) * ({x} - mid) / sxx)) AS upper
        FROM g"""


SPRING_DAYS = "SELECT site, wyear, date, temp_avg, temp_avg_vwc FROM v_daily WHERE month(date) BETWEEN 3 AND 5"
add("lm_band", band(f"SELECT site, wyear, temp_avg_vwc AS y, temp_avg AS x FROM ({SPRING_DAYS})", "site, wyear", "temp_avg", SPRING_DAYS, 0.95), "temp_avg temp_avg_vwc fitted lower upper")
LINES = "SELECT l_returnflag, l_linestatus, l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem"
add(
    "lm_band_grid",
    band(
        LINES,
        "l_returnflag, l_linestatus",
        "l_quantity",
        f"""SELECT l_returnflag, l_linestatus, CAST(i AS INTEGER) AS point, low + (high - low) * i / 79.0::DOUBLE AS l_quantity
            FROM (SELECT l_returnflag, l_linestatus, min(x) AS low, max(x) AS high FROM ({LINES}) GROUP BY ALL), range(0, 80) r(i)""",
        0.99,
    ),
    "l_quantity fitted lower upper",
)
A, B, P = "WBminusRB_abs_spr", "WBminusRB_abs_end", "WBminusRB_per_spr"
WARM_ALL = f"""(SELECT wyear, coalesce(n_cl_warm_4, 0) AS n_cl_warm_4, coalesce({A}, 0) AS {A}, coalesce({B}, 0) AS {B} FROM v_warm_wide FULL JOIN v_yields USING (wyear))"""
SPRING_RAIN = """(SELECT wyear, CASE WHEN count(precip_mm) = count(*) THEN sum(precip_mm) END AS x FROM v_4cl WHERE site = 'WB' GROUP BY 1)"""
WARM_RAIN = """(SELECT wyear, CASE WHEN count(precip_mm) = count(*) THEN sum(precip_mm) END AS x FROM v_warm GROUP BY 1)"""
MODELS = [
    ("spr_by_wet_days", A, "n_cl_all_4", "v_counts_wide FULL JOIN v_yields USING (wyear)"),
    ("spr_share_by_wet_days", P, "n_cl_all_4", "v_counts_wide FULL JOIN v_yields USING (wyear)"),
    ("spr_by_wet_or_mild_days", A, "n_cl_all_3and4", "v_counts_wide FULL JOIN v_yields USING (wyear)"),
    ("spr_by_spring_rain", A, "x", f"{SPRING_RAIN} FULL JOIN v_yields USING (wyear)"),
    ("spr_by_warm_ratio", A, "prop_warm2cold", "v_ratio FULL JOIN v_yields USING (wyear)"),
    ("end_by_warm_ratio", B, "prop_warm2cold", "v_ratio FULL JOIN v_yields USING (wyear)"),
    ("spr_by_warm_wet_days", A, "n_cl_warm_4", WARM_ALL),
    ("end_by_warm_wet_days", B, "n_cl_warm_4", WARM_ALL),
    ("spr_by_warm_rain", A, "x", f"{WARM_RAIN} FULL JOIN v_yields USING (wyear)"),
    ("end_by_warm_rain", B, "x", f"{WARM_RAIN} FULL JOIN v_yields USING (wyear)"),
    ("spr_by_late_rain", A, "precip_mm_lastcold", "v_rain_lastcold FULL JOIN v_yields USING (wyear)"),
    ("spr_by_late_rain_without_1998", A, "precip_mm_lastcold", "v_rain_lastcold FULL JOIN v_yields USING (wyear) WHERE wyear <> 1998"),
    ("end_by_late_rain", B, "precip_mm_lastcold", "v_rain_lastcold FULL JOIN v_yields USING (wyear)"),
    ("melt_by_late_rain_without_1998", "WBminusRB_abs_lastcold", "precip_mm_lastcold", "v_rain_lastcold FULL JOIN v_yields USING (wyear) FULL JOIN v_q_lastcold USING (wyear) WHERE wyear <> 1998"),
]
STACK = " UNION ALL ".join(f"SELECT '{m}' AS model, CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x FROM {t}" for m, y, x, t in MODELS)
add("lm_table", f"SELECT model, {fit('y', 'x')} FROM ({STACK}) GROUP BY 1", FIT)
add("lm_table_pvalue", tails(STACK, "model"), "p_value")
add(
    "corr_test",
    f"""SELECT *, {tail('(r * r)', 'n')} AS p_value FROM (SELECT corr({A}, {B}) AS r, count(*) FILTER ({A} IS NOT NULL AND {B} IS NOT NULL) AS n, 'abs' AS kind FROM v_yields
        UNION ALL SELECT corr({P}, WBminusRB_per_end), count(*) FILTER ({P} IS NOT NULL AND WBminusRB_per_end IS NOT NULL), 'per' FROM v_yields)""",
    "r p_value",
)
CROSS = " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r, count(*) AS n FROM v_features" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]
)
add("corr_cross", f"SELECT *, {tail('(r * r)', 'n')} AS p_value FROM ({CROSS}) ORDER BY abs(r) DESC, var_a, var_b LIMIT 20", "r p_value")
add(
    "corr_cross_significant",
    f"""SELECT * FROM (SELECT *, {tail('(r * r)', 'n')} AS p_value FROM ({CROSS})) WHERE p_value <= 0.05 ORDER BY abs(r) DESC, var_a, var_b LIMIT 20""",
    "r p_value",
)
add(
    "cluster_profile",
    "SELECT cluster, count(*) AS n, " + ", ".join(f"avg({f}) - (SELECT avg({f}) FROM v_labelled) AS {f}" for f in FEATURES) + " FROM v_labelled GROUP BY 1",
    F6,
)
add(
    "run_ranking",
    f"""SELECT rows || 'x' || cols || '_' || clusters || 'cl_' || run AS latID, npf, coeff, qe * coeff AS qe_scaled
        FROM ({HALF}), (SELECT median(npf) / max(qe) AS coeff FROM v_runs)""",
    "npf coeff qe_scaled",
)
add("run_pick", "SELECT run, rows, cols, clusters, round(npf, 3) AS npf, round(qe, 3) AS qe FROM v_runs WHERE run IN (9, 17, 22) ORDER BY npf DESC")
add("node_quality", "SELECT 1 AS run, node, count(*) AS hits, avg(dist) AS mean_dist FROM v_assigned GROUP BY node", "mean_dist")
add(
    "u_matrix",
    "SELECT 1 AS run, a.node, avg(sqrt("
    + " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATURES)
    + """)) AS mean_neighbour_dist, count(*) AS neighbours
       FROM v_codes a JOIN v_codes b ON a.node <> b.node AND (a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy) <= 1.000001 GROUP BY a.node""",
    "mean_neighbour_dist",
)
add("component_planes", " UNION ALL ".join(f"SELECT 1 AS run, node, '{f}' AS var, {f} AS value FROM v_codes" for f in FEATURES), "value")

# --- tables behind figures
CURVES = "SELECT wyear, date, doy_wyear, " + ", ".join(
    f"max({v}) FILTER (site = '{s}') AS {v}_{s}" for v, s in (("q_mm_per", "RB"), ("q_mm_per", "WB"), ("precip_mm_per", "WB"))
) + " FROM v_daily WHERE site IS NOT NULL GROUP BY 1, 2, 3"
add(
    "figure_cumulative_curves",
    " UNION ALL ".join(f"SELECT wyear, date, doy_wyear, '{c}' AS var, {c} AS value FROM ({CURVES})" for c in ("q_mm_per_RB", "q_mm_per_WB", "precip_mm_per_WB")),
    "value",
)
add(
    "figure_cluster_strips",
    "SELECT d.wyear, d.date, site, cluster, q_mm_cum, t.date AS transition FROM v_4cl d LEFT JOIN v_transition t ON d.wyear = t.wyear",
)
SUFFIXES = ("may1", "may15", "may31", "may", "spr", "end")
MAY = "(SELECT * FROM v_4cl WHERE site = 'WB' AND month(date) = 5)"
add(
    "figure_snow_vs_yield",
    """SELECT * FROM (SELECT wyear, max(snow_dep_m) AS snow_depth_max FROM v_daily WHERE site = 'WB' GROUP BY 1)
       FULL JOIN v_yield_may1 USING (wyear) FULL JOIN v_yield_may15 USING (wyear) FULL JOIN v_yield_may31 USING (wyear)
       FULL JOIN v_yield_may USING (wyear) FULL JOIN v_yields USING (wyear) FULL JOIN v_rain_lastcold USING (wyear)
       FULL JOIN (SELECT wyear, """
    + ", ".join(f"count(*) FILTER (cluster = {k}) AS clust_{k}" for k in (1, 2, 3, 4))
    + f""" FROM {MAY} GROUP BY 1) USING (wyear)
       FULL JOIN (SELECT wyear, max(precip_mm_3d) AS precip_mm_3d FROM {MAY} GROUP BY 1) USING (wyear)""",
    "snow_depth_max precip_mm_lastcold precip_mm_3d " + " ".join(f"WBminusRB_{k}_{s}" for s in SUFFIXES for k in ("abs", "per")),
)
add("figure_snow_curves", "SELECT wyear, site, doy_wyear, date, snow_dep_m FROM v_daily WHERE wyear IN (1996, 1999)", "snow_dep_m")

# --- streaming, against the batch result
ORACLES["stream_hourly_mean"] = ORACLES["hourly_mean"]
add(
    "stream_daily_total",
    """SELECT CAST(ts AS DATE) AS date, station, CASE WHEN count(airtemp_c) = count(*) THEN sum(airtemp_c) END AS airtemp_total FROM v_sensor GROUP BY 1, 2""",
    "airtemp_total",
)


def arrivals(width: str, lateness: str) -> str:
    """Loads of events, each with the watermark of the loads before it, and whether a row is late."""
    return f"""(SELECT *, date_trunc('{width}', ts) AS w, coalesce(date_trunc('{width}', ts) + INTERVAL 1 {width} <= mark, false) AS late
        FROM (SELECT event_id, ts, event_type AS station, value, CAST(least(floor((day(ts) + CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END) / 11), 2) AS INTEGER) AS load FROM events)
        JOIN (SELECT i AS load, (SELECT max(ts) FROM events WHERE least(floor((day(ts) + CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END) / 11), 2) < i) - INTERVAL {lateness} AS mark
              FROM range(0, 3) r(i)) USING (load))"""


def closed_windows(width: str, lateness: str, values: str) -> str:
    return f"""SELECT w AS "from", w + INTERVAL 1 {width} AS upto, station, count(*) AS n, {values} FROM {arrivals(width, lateness)}
               WHERE NOT late AND w + INTERVAL 1 {width} <= (SELECT max(ts) FROM events) - INTERVAL {lateness} GROUP BY ALL"""


add("stream_hourly_closed", closed_windows("hour", "12 hours", "avg(value) AS airtemp_c"), "airtemp_c")
add("stream_daily_closed", closed_windows("day", "6 hours", "CASE WHEN count(value) = count(*) THEN sum(value) END AS total"), "total")
add("stream_late_readings", f"SELECT event_id, ts, station, value, mark AS watermark FROM {arrivals('hour', '12 hours')} WHERE late", "value")


def power(source: str) -> str:
    """CTEs e1 and e2 (i, v, value): first and second eigenvector by squaring the correlation matrix again and again."""
    long = " UNION ALL ".join(f"SELECT date, {i} AS i, {f} AS x FROM {source}" for i, f in enumerate(FEATURES))
    parts = [f"l AS MATERIALIZED ({long})", "c1 AS MATERIALIZED (SELECT a.i, b.i AS j, corr(a.x, b.x) AS v FROM l a JOIN l b USING (date) GROUP BY ALL)"]
    for k in (1, 2):
        last = f"c{k}"
        for step in range(12):
            new = f"p{k}_{step}"
            parts.append(f"{new}_ AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY ALL)")
            parts.append(f"{new} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {new}_) AS v FROM {new}_)")
            last = new
        # a power of the matrix has the eigenvector in every column; take the longest
        parts.append(f"u{k} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {last} WHERE j = (SELECT j FROM {last} GROUP BY j ORDER BY sum(v * v) DESC, j LIMIT 1))")
        parts.append(f"e{k} AS MATERIALIZED (SELECT i, v, (SELECT sum(a.v * c.v * b.v) FROM c{k} c JOIN u{k} a ON a.i = c.i JOIN u{k} b ON b.i = c.j) AS value FROM u{k})")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - a.value * a.v * b.v AS v FROM c{k} c JOIN e{k} a ON a.i = c.i JOIN e{k} b ON b.i = c.j)")
    return "WITH " + ", ".join(parts)


NAMES = "CASE i " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FEATURES)) + " END"
add("weights_pca", f"{power('v_features')} SELECT {NAMES} AS feature, v * sign((SELECT arg_max(v, abs(v)) FROM e1)) AS weight FROM e1", "weight")
SIZE = f"""{power('v_features')}, z AS (SELECT (SELECT count(*) FROM v_features) AS n, CAST(round(5 * sqrt((SELECT count(*) FROM v_features))) AS BIGINT) AS nodes,
           round((SELECT max(value) FROM e1) / (SELECT max(value) FROM e2), 1) AS ratio)"""
add("lattice_size", f"SELECT * FROM ({SIZE} SELECT n, nodes, ratio AS col_row_ratio FROM z)")
BEST = f"""SELECT * FROM ({SIZE}, g AS (SELECT r.i AS r, c.i AS c, round(abs(ln(r.i * c.i / nodes)) + abs(ln(c.i / r.i / ratio)), 9) AS far
                      FROM z, range(1, 400) r(i), range(1, 400) c(i) WHERE r.i * c.i <= n)
        SELECT CAST(row_number() OVER (ORDER BY far, r, c) AS INTEGER) AS place, CAST(r AS INTEGER) AS rows, CAST(c AS INTEGER) AS cols,
               CAST(r * c AS INTEGER) AS nodes, round(c / r, 1) AS col_row_ratio FROM g ORDER BY far, r, c LIMIT 5)"""
add("grid_from_data", BEST)
add(
    "sweep_grid",
    f"""SELECT CAST(row_number() OVER (ORDER BY k, t, place) AS INTEGER) AS "myRun", 'bothSites' AS "myDataSet", nodes, 'hexagonal' AS "myTopo", rows, cols, 'L2norm' AS "normMeth",
               'noPCA' AS "wghtMeth", CAST(1500 AS INTEGER) AS niter, 0.05::DOUBLE AS "crsAlpha", 0.01::DOUBLE AS "finAlpha", CAST(k AS INTEGER) AS "nClusters", col_row_ratio AS "colRowRatio"
        FROM ({BEST}), range(3, 6) a(k), range(1, 3) b(t)""",
)


def map_steps(epochs: int, rows: int, cols: int) -> str:
    """CTEs m0.. (codes) and a0.. (rows on them): the batch rule on a hexagonal lattice, step after step."""
    nodes = rows * cols
    parts = [
        "v AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)",
        f"""spot AS (SELECT i + 1 AS node, i % {cols} + 1 + CASE WHEN (i // {cols} + 1) % 2 = 1 THEN 0.5::DOUBLE ELSE 0 END AS gx, (i // {cols} + 1) * (sqrt(3.0::DOUBLE) / 2) AS gy FROM range(0, {nodes}) r(i))""",
        "near AS MATERIALIZED (SELECT a.node AS i, b.node AS j, sqrt((a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2) AS far FROM spot a, spot b)",
        "reach AS MATERIALIZED (SELECT quantile_cont(far, 2.0::DOUBLE / 3) AS r FROM near WHERE i < j)",
        f"first AS (SELECT id, row_number() OVER (ORDER BY id * 7919 % 10007, id) AS node FROM (SELECT vec_id AS id FROM embeddings) QUALIFY node <= {nodes})",
        "m0 AS MATERIALIZED (SELECT node, dim, x AS w FROM first JOIN v USING (id))",
    ]
    for t in range(epochs):
        parts += [
            f"a{t} AS MATERIALIZED (SELECT id, min({{'d': round(d, 12), 'node': node}}).node AS node, min(d) AS d FROM (SELECT id, node, sum((x - w) * (x - w)) AS d FROM v JOIN m{t} USING (dim) GROUP BY ALL) GROUP BY id)",
            f"s{t} AS MATERIALIZED (SELECT node, dim, count(*) AS n, sum(x) AS s FROM a{t} JOIN v USING (id) GROUP BY ALL)",
            f"""m{t + 1} AS MATERIALIZED (SELECT c.node, c.dim, coalesce(sum(s.s) / sum(s.n), any_value(c.w)) AS w
                FROM m{t} c LEFT JOIN near h ON h.j = c.node AND h.far <= (SELECT r FROM reach) * {1 - t / (epochs - 1)}::DOUBLE + 1e-9::DOUBLE
                LEFT JOIN s{t} s ON s.node = h.i AND s.dim = c.dim GROUP BY c.node, c.dim)""",
        ]
    return "WITH " + ", ".join(parts)


EPOCHS = 30
add("som_fit", f"{map_steps(EPOCHS, 4, 5)} SELECT CAST(1 AS INTEGER) AS run, CAST(node AS INTEGER) AS node, 'x' || dim AS var, w AS value FROM m{EPOCHS}", "value")
add(
    "som_progress",
    map_steps(EPOCHS, 4, 5)
    + " UNION ALL ".join(
        f" SELECT CAST(1 AS INTEGER) AS run, CAST({t + 1} AS INTEGER) AS epoch, (SELECT avg(d) FROM a{t}) AS mean_distance, (SELECT avg(abs(b.w - a.w)) FROM m{t} a JOIN m{t + 1} b USING (node, dim)) AS mean_change"
        for t in range(EPOCHS)
    ),
    "mean_distance mean_change",
)


def lloyd(steps: int) -> str:
    """Clusters of k = 1..8 from hashed starts, one step of all after the other."""
    gap = " + ".join(f"(s.{f} - c.{f}) * (s.{f} - c.{f})" for f in FEATURES)
    parts = [f"""m0 AS MATERIALIZED (SELECT k, j, {F6.replace(' ', ', ')} FROM (
        SELECT *, row_number() OVER (ORDER BY (date - DATE '1970-01-01') * 7919 % 10007, date) AS j FROM v_scaled), range(1, 9) r(k) WHERE j <= k)"""]
    for t in range(steps + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT date, k, arg_min(j, d) AS j, min(d) AS d FROM (SELECT date, k, j, {gap} AS d FROM v_scaled s, m{t} c) GROUP BY ALL)")
        means = ", ".join(f"coalesce(avg(s.{f}), any_value(c.{f})) AS {f}" for f in FEATURES)
        parts.append(f"m{t + 1} AS MATERIALIZED (SELECT c.k, c.j, {means} FROM m{t} c LEFT JOIN a{t} a ON a.k = c.k AND a.j = c.j LEFT JOIN v_scaled s ON s.date = a.date GROUP BY ALL)")
    return "WITH " + ", ".join(parts) + f" SELECT CAST(k AS INTEGER) AS k, sum(d) AS wss FROM a{steps} GROUP BY k"


add("kmeans_elbow", lloyd(30), "wss")
WIDE = """SELECT vec_id, i, CASE WHEN (vec_id + i) % 9 <> 0 THEN CAST(x AS DOUBLE) END AS x
          FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""
add(
    "corr_wide",
    f"""WITH w AS MATERIALIZED ({WIDE})
        SELECT *, {tail('(r * r)', 'n')} AS p_value
        FROM (SELECT 'x' || a.i AS var_a, 'x' || b.i AS var_b, corr(a.x, b.x) AS r, count(*) AS n FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.i < b.i
              WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL ORDER BY abs(r) DESC, var_a, var_b LIMIT 200)""",
    "r p_value",
)


def permuted(permutations: int, seed: int) -> str:
    """Labels cut off the order of hashed days in every permutation, and pseudo-F from all pairs' polynomial."""
    fixed = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # fixed values: the splitmix64 generator
    whole = "18446744073709551616::HUGEINT"
    mix = lambda z, shift, factor: f"(xor({z}, {z} // {1 << shift}) * {factor}::UHUGEINT) % {1 << 64}::UHUGEINT"
    sums = lambda keys: (
        f"SELECT {keys}, count(*) AS n, sum(s) AS ss, sum(s * s) AS ss2, "
        + ", ".join(f"sum({f}) AS s_{f}, sum(s * {f}) AS sx_{f}" for f in FEATURES) + ", "
        + ", ".join(f"sum({a} * {b}) AS m_{a}_{b}" for a in FEATURES for b in FEATURES)
    )
    square = " + ".join(f"m_{a}_{b} * m_{a}_{b}" for a in FEATURES for b in FEATURES)
    cross = " + ".join(f"sx_{f} * s_{f}" for f in FEATURES)
    pairs = f"(2 * n * ss2 + 2 * ss * ss + 4 * ({square}) - 8 * ({cross})) / (2 * n)"
    return f"""WITH x AS MATERIALIZED (SELECT * EXCLUDE (s), {' + '.join(f'{f} * {f}' for f in FEATURES)} AS s
            FROM (SELECT date, cluster, 0 AS s, {', '.join(f'{f} - avg({f}) OVER () AS {f}' for f in FEATURES)} FROM v_labelled)),
        z0 AS (SELECT date, p, CAST(((date - DATE '1970-01-01') + p * {fixed[0]}::HUGEINT + {seed * fixed[1]}::HUGEINT) % {whole} AS UHUGEINT) AS z FROM x, range(1, {permutations + 1}) r(p)),
        z1 AS (SELECT date, p, {mix('z', 30, fixed[1])} AS z FROM z0),
        z2 AS (SELECT date, p, {mix('z', 27, fixed[2])} AS z FROM z1),
        z3 AS MATERIALIZED (SELECT date, p, row_number() OVER (PARTITION BY p ORDER BY xor(z, z // {1 << 31})) AS place FROM z2),
        c AS MATERIALIZED (SELECT cluster, sum(count(*)) OVER (ORDER BY cluster) AS upto FROM x GROUP BY cluster),
        drawn AS (SELECT p, min(c.cluster) AS label, any_value(x) AS x FROM z3 JOIN x USING (date) JOIN c ON c.upto >= place GROUP BY p, date),
        every AS MATERIALIZED (SELECT p, label, unnest(x) FROM drawn UNION ALL SELECT 0, cluster, * FROM x),
        within AS (SELECT p, sum({pairs}) AS w, count(*) AS k FROM ({sums('p, label')} FROM every GROUP BY ALL) GROUP BY p),
        f AS MATERIALIZED (SELECT p, n, k, ((t - w) / (k - 1)) / (w / (n - k)) AS f FROM (SELECT p, n, {pairs} AS t FROM ({sums('p')} FROM every GROUP BY ALL)) JOIN within USING (p))
        """


add("permanova_p", permuted(99, 1) + "SELECT a.n, a.k, a.f, (count(*) FILTER (b.f >= a.f) + 1) / 100 AS p_value FROM f a, f b WHERE a.p = 0 AND b.p > 0 GROUP BY ALL", "f")
add("permanova_permuted", permuted(99, 1) + "SELECT CAST(p AS INTEGER) AS perm, f FROM f WHERE p > 0", "f")
