"""The logical inputs and intermediate tables as common table expressions."""

from __future__ import annotations

import re

FEATURES = ["precip_mm", "precip_mm_3d", "snow_dep_m", "temp_avg_vwc", "temp_avg_vwc_3d", "pyra_wattm2_dailyTot"]
WY = "CAST(year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS INTEGER)"
OUT1, OUT2 = "DATE '1998-03-11'", "DATE '1998-03-25'"

VIEWS: dict[str, str] = {
    "v_runoff": """
        SELECT CASE WHEN l_returnflag = 'A' THEN 'WB' ELSE 'RB' END AS site, CAST(l_shipdate AS DATE) AS date,
               sum(l_quantity) AS q_mm
        FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""",
    "v_runoff_gaps": """
        SELECT site, date, CASE WHEN month(date) = 4 AND day(date) = 25 THEN NULL ELSE q_mm END AS q_mm FROM v_runoff""",
    "v_precip": """
        SELECT date, CASE WHEN day(date) BETWEEN 10 AND 14 THEN NULL ELSE t / 10000.0::DOUBLE END AS precip_mm
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS t
              FROM orders GROUP BY 1)""",
    "v_spare": """
        SELECT date, t / 10.0::DOUBLE AS precip_mm_vwc
        FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS t
              FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY 1)""",
    "v_airport": """
        SELECT date,
               CASE WHEN kept THEN lo END AS temp_min, CASE WHEN kept THEN hi END AS temp_max,
               CASE WHEN kept AND date <= DATE '1998-12-31' THEN mid END AS temp_avg
        FROM (SELECT CAST(l_shipdate AS DATE) AS date, min(round(l_discount * 100)) AS lo, max(round(l_discount * 100)) AS hi,
                     avg(round(l_discount * 100)) AS mid,
                     NOT (day(CAST(l_shipdate AS DATE)) BETWEEN 7 AND 8 OR day(CAST(l_shipdate AS DATE)) BETWEEN 20 AND 22) AS kept
              FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 5)""",
    "v_snow": """
        SELECT date, CASE WHEN day(date) BETWEEN 10 AND 13 OR day(date) >= (CASE WHEN month(date) < 7 THEN 17 ELSE 16 END)
                          THEN NULL ELSE n END AS snow_dep
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)""",
    "v_logger": f"""
        SELECT CAST(l_shipdate AS DATE) AS date, round(l_discount * 100) AS airtemp_c, l_quantity AS pyranometer_watt_m2
        FROM lineitem WHERE CAST(l_shipdate AS DATE) <= {OUT1} OR CAST(l_shipdate AS DATE) >= {OUT2}""",
    "v_logger_days": """
        SELECT date,
               CASE WHEN count(airtemp_c) = count(*)
                    THEN CAST(round(CAST(avg(airtemp_c) AS DECIMAL(18,9)), 1) AS DOUBLE) END AS temp_avg_vwc,
               CASE WHEN count(pyranometer_watt_m2) = count(*) THEN sum(pyranometer_watt_m2) END AS pyra
        FROM v_logger GROUP BY date""",
    "v_withdraw": """
        SELECT wyear, month,
               CASE WHEN month >= 10 OR month <= 3 THEN a END AS use_snowmaking_mm,
               CASE WHEN month <= 6 THEN b END AS use_diverted_mm,
               CASE WHEN month BETWEEN 5 AND 9 THEN c END AS use_golf_mm
        FROM (SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS wyear,
                     CAST(month(o_orderdate) AS INTEGER) AS month,
                     CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS a,
                     CAST(count(*) FILTER (o_orderpriority = '2-HIGH') AS DOUBLE) AS b,
                     CAST(count(*) FILTER (o_orderpriority = '5-LOW') AS DOUBLE) AS c
              FROM orders GROUP BY 1, 2)""",
    "v_use": """
        SELECT *, sum(use_total_mm) OVER (PARTITION BY wyear ORDER BY (month + 2) % 12 ROWS UNBOUNDED PRECEDING) AS use_total_mm_cum
        FROM (SELECT wyear, month, a AS use_snowmaking_mm, b AS use_diverted_mm, c AS use_golf_mm, a + b + c AS use_total_mm,
                     CAST(wyear - CASE WHEN month >= 10 THEN 1 ELSE 0 END AS INTEGER) AS year
              FROM (SELECT wyear, month, coalesce(use_snowmaking_mm, 0) AS a, coalesce(use_diverted_mm, 0) AS b,
                           coalesce(use_golf_mm, 0) AS c FROM v_withdraw))""",
    "v_sensor": """
        SELECT event_id, ts, event_type AS station, CASE WHEN minute(ts) <> 30 THEN value END AS airtemp_c FROM events""",
    "v_runs": """
        SELECT p_partkey AS run, CAST(p_size % 3 + 11 AS INTEGER) AS rows, CAST(p_size % 4 + 15 AS INTEGER) AS cols,
               CAST(p_size % 3 + 3 AS INTEGER) AS clusters, p_retailprice AS npf, (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS qe
        FROM part""",
    # --- the compiled daily table
    "v_station": f"""
        SELECT site, {WY} AS wyear, date, q_mm,
               CAST(date_diff('day', make_date({WY} - 1, 10, 1), date) + 1 AS BIGINT) AS doy_wyear,
               CASE WHEN count(*) OVER w = count(q_mm) OVER w THEN sum(q_mm) OVER w END AS q_mm_cum
        FROM v_runoff WINDOW w AS (PARTITION BY site, {WY} ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "v_snow_filled": """
        SELECT date,
               CASE WHEN m IS NOT NULL THEN m
                    WHEN count(*) FILTER (m IS NULL) OVER (PARTITION BY island) <= 15
                    THEN py + (qy - py) * ((x - px) / (qx - px)) END AS snow_dep_m
        FROM (SELECT date, m, x, island,
                     last_value(CASE WHEN m IS NOT NULL THEN x END IGNORE NULLS) OVER a AS px,
                     last_value(m IGNORE NULLS) OVER a AS py,
                     first_value(CASE WHEN m IS NOT NULL THEN x END IGNORE NULLS) OVER z AS qx,
                     first_value(m IGNORE NULLS) OVER z AS qy
              FROM (SELECT date, m, CAST(date - DATE '1970-01-01' AS DOUBLE) AS x, count(m) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS island
                    FROM (SELECT date, snow_dep * 0.0254::DOUBLE AS m FROM v_snow))
              WINDOW a AS (ORDER BY date ROWS UNBOUNDED PRECEDING),
                     z AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "v_met_base": "SELECT date, temp_min, temp_max, temp_avg, precip_mm FROM v_airport FULL JOIN v_precip USING (date)",
    "v_met_locf": """
        SELECT date, precip_mm, """
    + ", ".join(
        f"""CASE WHEN {c} IS NULL AND count(*) FILTER ({c} IS NULL) OVER (PARTITION BY i_{c}) <= 2 THEN l_{c} ELSE {c} END AS {c}"""
        for c in ("temp_min", "temp_max", "temp_avg")
    )
    + """ FROM (SELECT *, """
    + ", ".join(
        f"count({c}) OVER w AS i_{c}, last_value({c} IGNORE NULLS) OVER w AS l_{c}" for c in ("temp_min", "temp_max", "temp_avg")
    )
    + """ FROM v_met_base WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))""",
    "v_met": f"""
        SELECT date, wyear, precip_mm, coalesce(temp_avg, (temp_min + temp_max) / 2) AS temp_avg, temp_max, temp_min,
               sum(precip_mm) OVER (PARTITION BY wyear ORDER BY date ROWS UNBOUNDED PRECEDING) AS precip_mm_cum
        FROM (SELECT date, {WY} AS wyear, coalesce(precip_mm, precip_mm_vwc, 0) AS precip_mm, temp_avg, temp_max, temp_min
              FROM v_met_locf LEFT JOIN v_spare USING (date))""",
    "v_temp_filled": f"""
        SELECT date, CASE WHEN date BETWEEN {OUT1} AND {OUT2} THEN slope * temp_avg + intercept ELSE temp_avg_vwc END AS temp_avg_vwc
        FROM v_both, (SELECT regr_slope(temp_avg_vwc, temp_avg) AS slope, regr_intercept(temp_avg_vwc, temp_avg) AS intercept
                      FROM v_both WHERE month(date) BETWEEN 3 AND 5)""",
    "v_both": "SELECT date, temp_avg_vwc, temp_avg FROM v_logger_days FULL JOIN v_met USING (date)",
    "v_temp": """
        SELECT date, temp_avg_vwc, CASE WHEN count(temp_avg_vwc) OVER w = 3 THEN avg(temp_avg_vwc) OVER w END AS temp_avg_vwc_3d
        FROM v_temp_filled WINDOW w AS (ORDER BY date ROWS 2 PRECEDING)""",
    "v_pyr": f"""
        SELECT date, pyra AS pyra_wattm2_dailyTot FROM v_logger_days WHERE NOT date BETWEEN {OUT1} AND {OUT2}
        UNION ALL
        SELECT CAST(d AS DATE), m FROM generate_series({OUT1}, {OUT2}, INTERVAL 1 DAY) AS g(d),
               (SELECT CASE WHEN count(*) = count(pyra) THEN avg(pyra) END AS m FROM v_logger_days
                WHERE date BETWEEN {OUT1} - 5 AND {OUT2} + 5 AND date <> {OUT1} AND date <> {OUT2})""",
    "v_weather": """
        SELECT * FROM v_met FULL JOIN v_snow_filled USING (date) FULL JOIN v_temp USING (date) FULL JOIN v_pyr USING (date)""",
    "v_water": """
        SELECT *,
               CASE WHEN site IS NOT NULL THEN q_mm_cum / (CASE WHEN count(q_mm) OVER p = count(*) FILTER (q_mm IS NOT NULL) OVER p
                                                      THEN sum(q_mm) OVER p END) * 100 END AS q_mm_per,
               CASE WHEN site IS NOT NULL THEN precip_mm_cum / (CASE WHEN count(precip_mm) FILTER (q_mm IS NOT NULL) OVER p = count(*) FILTER (q_mm IS NOT NULL) OVER p
                                                      THEN sum(precip_mm) FILTER (q_mm IS NOT NULL) OVER p END) * 100 END AS precip_mm_per,
               CASE WHEN count(precip_mm) OVER r = 3 THEN sum(precip_mm) OVER r END AS precip_mm_3d
        FROM (SELECT site, coalesce(s.wyear, m.wyear) AS wyear, date, doy_wyear, q_mm, q_mm_cum, precip_mm, temp_avg, temp_max, temp_min,
                     precip_mm_cum, snow_dep_m, temp_avg_vwc, temp_avg_vwc_3d, pyra_wattm2_dailyTot
              FROM v_station s FULL JOIN v_weather m USING (date))
        WINDOW p AS (PARTITION BY site, wyear), r AS (PARTITION BY site ORDER BY date ROWS 2 PRECEDING)""",
    "v_lengths": """
        SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, max(day(date)) AS days
        FROM (SELECT date FROM v_runoff UNION ALL SELECT date FROM v_weather) GROUP BY 1, 2""",
    "v_daily": """
        SELECT site, w.wyear, date, doy_wyear, q_mm, q_mm_cum, precip_mm, temp_avg, temp_max, temp_min, precip_mm_cum, q_mm_per,
               precip_mm_per, precip_mm_3d, snow_dep_m, temp_avg_vwc, temp_avg_vwc_3d, pyra_wattm2_dailyTot,
               u.use_total_mm_cum, u.use_snowmaking_mm / l.days AS use_snow_mm_daily, u.use_total_mm / l.days AS use_total_mm_daily
        FROM v_water w
        LEFT JOIN (v_use u JOIN v_lengths l ON u.year = l.year AND u.month = l.month)
          ON u.wyear = w.wyear AND u.year = year(w.date) AND u.month = month(w.date)
        WHERE date <= DATE '2001-09-30'""",
    # --- the spring window and its clusters
    "v_spring": "SELECT * FROM v_daily WHERE doy_wyear BETWEEN 170 AND 245",
    "v_features": f"""
        SELECT date, {', '.join(FEATURES)} FROM v_spring WHERE site = 'WB' AND {' AND '.join(f + ' IS NOT NULL' for f in FEATURES)}""",
    "v_scaled": "SELECT date, "
    + ", ".join(f"({f} - min({f}) OVER ()) / nullif(max({f}) OVER () - min({f}) OVER (), 0) AS {f}" for f in FEATURES)
    + " FROM v_features",
    "v_codes": f"""
        SELECT CAST(row_number() OVER (ORDER BY y, m) AS INTEGER) AS node, CAST(m - 2 AS INTEGER) AS cluster,
               (m - 2) + ((y - 1994) % 2) * 0.5::DOUBLE AS gx, (y - 1994) * (sqrt(3.0::DOUBLE) / 2) AS gy, {', '.join(FEATURES)}
        FROM (SELECT year(date) AS y, month(date) AS m, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM v_scaled GROUP BY 1, 2)""",
    "v_assigned": """
        SELECT date, node, cluster, dist
        FROM (SELECT s.date, c.node, c.cluster, """
    + " + ".join(f"(s.{f} - c.{f}) * (s.{f} - c.{f})" for f in FEATURES)
    + """ AS dist FROM v_scaled s, v_codes c)
        QUALIFY row_number() OVER (PARTITION BY date ORDER BY dist, node) = 1""",
    "v_labelled": "SELECT s.*, a.cluster FROM v_scaled s JOIN v_assigned a USING (date)",
    "v_4cl": """
        SELECT '4cl' AS SOMversion, a.cluster, d.* FROM v_assigned a LEFT JOIN v_spring d ON a.date = d.date""",
    "v_clustered": """
        SELECT * FROM v_4cl UNION ALL SELECT '3cl', least(cluster, 3), * EXCLUDE (SOMversion, cluster) FROM v_4cl""",
    "v_mode": """
        SELECT wyear, date, cluster, precip_mm, q_mm,
               CASE WHEN lag(cluster) OVER w IS NOT NULL AND lead(cluster) OVER w IS NOT NULL
                    THEN CASE WHEN cluster = lead(cluster) OVER w THEN cluster ELSE lag(cluster) OVER w END END AS cluster_mode
        FROM v_4cl WHERE site = 'WB' WINDOW w AS (PARTITION BY wyear ORDER BY date)""",
    "v_transition": """
        SELECT wyear, min(date) AS date FROM v_mode
        WHERE CASE WHEN wyear = 1998 THEN cluster IN (2, 4) ELSE cluster_mode IN (2, 4) END GROUP BY wyear""",
    "v_warm": "SELECT m.* FROM v_mode m JOIN v_transition t ON m.wyear = t.wyear AND m.date >= t.date",
    "v_cold": "SELECT m.* FROM v_mode m JOIN v_transition t ON m.wyear = t.wyear AND m.date <= t.date",
    "v_lastcold": """
        SELECT d.* FROM v_4cl d JOIN (SELECT site, wyear, max(date) AS at FROM v_4cl WHERE cluster = 1 GROUP BY 1, 2) l
          ON d.site = l.site AND d.wyear = l.wyear AND d.date >= l.at""",
    "v_rain_lastcold": """
        SELECT wyear, CASE WHEN count(precip_mm) = count(*) THEN sum(precip_mm) END AS precip_mm_lastcold
        FROM v_lastcold WHERE site = 'WB' GROUP BY wyear""",
    "v_q_lastcold": """
        SELECT wyear, max(q) FILTER (site = 'WB') - max(q) FILTER (site = 'RB') AS WBminusRB_abs_lastcold
        FROM (SELECT site, wyear, CASE WHEN count(q_mm) = count(*) THEN sum(q_mm) END AS q FROM v_lastcold GROUP BY 1, 2) GROUP BY wyear""",
    "v_yields": """
        SELECT * FROM v_yield_spr FULL JOIN v_yield_end USING (wyear)""",
    "v_ratio": """
        SELECT *, warm / nullif(cold, 0) AS prop_warm2cold
        FROM (SELECT wyear, (SELECT count(*) FROM v_cold c WHERE c.wyear = t.wyear) AS cold,
                     (SELECT count(*) FROM v_warm w WHERE w.wyear = t.wyear) AS warm FROM v_transition t)""",
    "v_shares": """
        SELECT *, n_cl_all / total_obs AS n_cl_all_prop
        FROM (SELECT SOMversion, wyear, cluster, count(*) AS n_cl_all, CAST(sum(count(*)) OVER (PARTITION BY SOMversion, wyear) AS BIGINT) AS total_obs
              FROM v_clustered WHERE site = 'WB' GROUP BY 1, 2, 3)""",
    "v_counts_wide": "SELECT *, n_cl_all_3 + n_cl_all_4 AS n_cl_all_3and4, n_cl_all_prop_3 + n_cl_all_prop_4 AS n_cl_all_prop_3and4 FROM (SELECT wyear, "
    + ", ".join(
        f"coalesce(max(n_cl_all) FILTER (cluster = {k}), 0) AS n_cl_all_{k}, coalesce(max(n_cl_all_prop) FILTER (cluster = {k}), 0) AS n_cl_all_prop_{k}"
        for k in (1, 2, 3, 4)
    )
    + " FROM v_shares WHERE SOMversion = '4cl' GROUP BY wyear)",
    "v_warm_wide": "SELECT *, n_cl_warm_1 / nullif(n_cl_warm_2 + n_cl_warm_4, 0) AS prop_cold2warm FROM (SELECT wyear, "
    + ", ".join(
        f"count(*) FILTER (cluster = {k}) AS n_cl_warm_{k}, count(*) FILTER (cluster = {k}) / count(*) AS n_cl_warm_prop_{k}" for k in (1, 2, 3, 4)
    )
    + " FROM v_warm GROUP BY wyear)",
    "v_peaks": """
        SELECT wyear, doy_wyear, snow_dep_m FROM v_daily WHERE snow_dep_m > 0
        QUALIFY row_number() OVER (PARTITION BY wyear ORDER BY snow_dep_m DESC, date, coalesce(site, '~')) = 1""",
}


def _yield(source: str, suffix: str, value: str = "q_mm_cum", where: str = "true") -> str:
    return f"""
        SELECT wyear, wb - rb AS WBminusRB_abs_{suffix}, (wb - rb) / nullif(rb, 0) AS WBminusRB_per_{suffix}
        FROM (SELECT wyear, arg_max(v, date) FILTER (site = 'WB') AS wb, arg_max(v, date) FILTER (site = 'RB') AS rb
              FROM (SELECT site, wyear, date, {value} AS v FROM {source} WHERE site IS NOT NULL AND {where}) GROUP BY wyear)"""


VIEWS["v_yield_spr"] = _yield("v_daily", "spr", where="doy_wyear BETWEEN 170 AND 245")
VIEWS["v_yield_end"] = _yield("v_daily", "end")
VIEWS["v_yield_may1"] = _yield("v_daily", "may1", where="doy_wyear BETWEEN 170 AND 213")
VIEWS["v_yield_may15"] = _yield("v_daily", "may15", where="doy_wyear BETWEEN 170 AND 227")
VIEWS["v_yield_may31"] = _yield("v_daily", "may31", where="doy_wyear BETWEEN 170 AND 243")
VIEWS["v_may_sum"] = """
    SELECT site, wyear, date, sum(q_mm) OVER (PARTITION BY site, wyear ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum
    FROM v_daily WHERE doy_wyear BETWEEN 213 AND 243"""
VIEWS["v_yield_may"] = _yield("v_may_sum", "may", "cum")


def statement(body: str, rounds: str = "") -> str:
    """A self-contained statement: the body with the views it needs, the named doubles rounded to six digits."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\bv_\w+", sql):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order) + "\n" if order else ""
    if not rounds:
        return head + body
    # rounded half up from the shortest decimal form, like Spark; "+ 0.0" turns a negative zero into zero
    fixed = ", ".join(f"CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) + 0.0::DOUBLE AS {c}" for c in rounds.split())
    return f"{head}SELECT * REPLACE ({fixed}) FROM ({body})"
