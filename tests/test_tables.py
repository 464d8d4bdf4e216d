"""Missing-value rules, joins, reshaping, ranking and quantiles on small fixtures."""

import datetime as dt
import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import calendar, nulls, text
from freshet.operators import aggregates, columns, fills, joins, matching, pairs, quantiles, ranking, reshape, scaling
from freshet.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("all", 1.0), ("all", 2.0), ("one", None), ("one", 2.0), ("none", None)], "g string, v double")
    assert rows(aggregates.sum_strict(df, ["g"], s="v"), "g") == [("all", 3.0), ("none", None), ("one", None)]
    assert rows(aggregates.mean_strict(df, ["g"], s="v"), "g") == [("all", 1.5), ("none", None), ("one", None)]


def test_missing_keys_match_each_other(spark):
    a = spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "y int, m int, l string")
    b = spark.createDataFrame([(1, None, "c"), (3, 1, "d")], "y int, m int, r string")
    want = [(1, None, "a", "c"), (2, 1, "b", None), (3, 1, None, "d")]
    assert rows(joins.join_matching_nulls(a, b, ["y", "m"]), "y") == want
    assert rows(joins.full_chain([a, b], ["y", "m"]).select("y", "m", "l", "r"), "y") == want


def test_choice_and_membership_with_missing_values(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    got = df.select("v", nulls.choose(F.col("v") > 1, F.lit("y"), F.lit("n")).alias("c"))
    assert set(map(tuple, got.collect())) == {(1, "n"), (2, "y"), (None, None)}
    assert {r["v"] for r in df.where(nulls.not_in("v", [1])).collect()} == {2, None}


def test_leap_days(spark):
    df = spark.createDataFrame([("28-Feb", 2004), ("29-Feb", 2004), ("1-Mar", 2004), ("29-Feb", 2003), ("1-Oct", 2003)], "t string, y int")
    got = df.select("t", "y", calendar.day_month_date(F.col("t"), F.col("y")).alias("d"))
    assert {(r["t"], r["y"]): r["d"] for r in got.collect()} == {
        ("28-Feb", 2004): dt.date(2004, 2, 28),
        ("29-Feb", 2004): dt.date(2004, 2, 29),
        ("1-Mar", 2004): dt.date(2004, 3, 1),
        ("29-Feb", 2003): None,
        ("1-Oct", 2003): dt.date(2002, 10, 1),
    }


def test_tidy_matrix_numbers_days_before_dropping_leap_labels(spark):
    wide = spark.createDataFrame(
        [("1-Oct", 1.0, 2.0), ("28-Feb", 3.0, 4.0), ("29-Feb", None, 6.0), ("1-Mar", 7.0, 8.0)], "date string, `RB WY03` double, `RB WY04` double"
    )
    got = rows(reshape.tidy_water_years(wide, "date", ["RB WY03", "RB WY04"], "q"), "date")
    assert [(r[1], str(r[2]), r[3], r[4]) for r in got] == [
        (2003, "2002-10-01", 1, 1.0), (2003, "2003-02-28", 2, 3.0), (2003, "2003-03-01", 3, 7.0),
        (2004, "2003-10-01", 1, 2.0), (2004, "2004-02-28", 2, 4.0), (2004, "2004-02-29", 3, 6.0), (2004, "2004-03-01", 4, 8.0),
    ]


def test_first_numbers_in_texts(spark):
    df = spark.createDataFrame([("RB WY07",), ("x -2.5 y 3",), ("none",)], "t string")
    assert [r[0] for r in df.select(text.first_number(F.col("t"))).collect()] == [7.0, -2.5, None]


DAYS = [(y, dt.date(y, 4, d), c) for y, cs in ((2001, [3, 1, 2, 1, 2]), (2002, [3, 3, 3]), (2003, [1, 3, 3]), (2004, [3, 3, 1])) for d, c in enumerate(cs, 1)]


def test_parts_by_match(spark):
    df = spark.createDataFrame(DAYS, "y int, date date, c int")
    cold = F.col("c") == 1
    keys = lambda d: [(r["y"], r["date"].day) for r in d.orderBy("y", "date").collect()]
    assert keys(matching.from_first_match(df, ["y"], "date", cold)) == [(2001, 2), (2001, 3), (2001, 4), (2001, 5), (2003, 1), (2003, 2), (2003, 3), (2004, 3)]
    assert keys(matching.up_to_first_match(df, ["y"], "date", cold)) == [(2001, 1), (2001, 2), (2003, 1), (2004, 1), (2004, 2), (2004, 3)]
    assert keys(matching.from_last_match(df, ["y"], "date", cold)) == [(2001, 4), (2001, 5), (2003, 1), (2003, 2), (2003, 3), (2004, 3)]
    assert keys(matching.first_match(df, ["y"], "date", cold)) == [(2001, 2), (2003, 1), (2004, 3)]


def test_largest_row_ties_and_missing(spark):
    d = lambda n: dt.date(2001, 1, n)
    df = spark.createDataFrame([("a", d(3), 5.0), ("a", d(2), 5.0), ("a", d(1), None), ("b", d(1), None)], "g string, date date, v double")
    assert rows(ranking.largest_rows(df, ["g"], "v", "date", ["date", "v"]), "g") == [("a", d(2), 5.0)]
    assert rows(ranking.top_k(df, ["g"], [F.col("v").desc_nulls_last(), F.col("date")], 2).select("g", "date"), "g", "date") == [("a", d(2)), ("a", d(3)), ("b", d(1))]


@pytest.mark.parametrize("n", [1, 2, 7, 30_000, 50_001])
def test_upper_half_with_a_heavy_tie(spark, n):
    """A third of all rows share one value; the half is exact and goes to the smallest keys."""
    rnd = random.Random(n)
    data = [(i, 50.0 if i % 3 == 0 else float(rnd.randint(0, 100_000)) / 1000) for i in range(n)]
    df = spark.createDataFrame(data, "run long, npf double")
    want = {k for k, _ in sorted(data, key=lambda r: (-r[1], r[0]))[: n // 2]}
    assert {r["run"] for r in ranking.upper_half(df, "npf", "run").collect()} == want


def test_upper_half_counts_rows_without_a_value(spark):
    """Ten rows, n/2 = 5; those without a value come last, by key."""
    for missing, want in ((4, {0, 1, 2, 3, 4}), (8, {0, 1, 2, 3, 4}), (10, {0, 1, 2, 3, 4})):
        df = spark.createDataFrame([(i, None if i >= 10 - missing else 9.0 - i) for i in range(10)], "run long, npf double")
        assert {r["run"] for r in ranking.upper_half(df, "npf", "run").collect()} == want
    assert ranking.upper_half(df.limit(1), "npf", "run").count() == 0


def test_full_chain_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1, 5.0), (1, 7.0)], "k int, x double"), spark.createDataFrame([(1, 2.0)], "k int, y double")
    with pytest.raises(Exception, match="more than one row"):
        joins.full_chain([a, b], ["k"]).collect()
    assert rows(joins.full_chain([a.limit(1), b], ["k"]), "k") == [(1, 5.0, 2.0)]


def test_exact_quantiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(120_000) < 0.33, 1.5, rng.lognormal(size=120_000))
    groups = {"hot": hot, "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "few": rng.normal(size=501), "flat": np.full(30_000, 7.0)}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in quantiles.exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()}
    assert got.pop("empty") == (None, None, None)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(vs, [0.25, 0.5, 0.75]))), g
    whole = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert whole[0]["m"] == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_box_summary_leaves_outliers_outside_the_whiskers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    r = quantiles.box_summary(df, ["g"], "v").first()
    assert (r["low"], r["whisker_low"], r["whisker_high"], r["high"]) == (1.0, 1.0, 5.0, 100.0)


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert rows(scaling.min_max(df, ["a", "b"]), "a") == [(0.0, None), (1.0, None)]
    assert [r[1] for r in scaling.z_scores(df, ["a", "b"]).collect()] == [None, None]


def test_outage_is_replaced_by_its_neighbours(spark):
    day = lambda n: dt.date(2020, 3, n)
    data = [(day(n), float(n)) for n in range(1, 11)] + [(day(15), 99.0)] + [(day(n), 0.0) for n in range(16, 28)]
    df = spark.createDataFrame(data, "date date, v double")
    got = {r["date"].day: r["v"] for r in fills.by_neighbour_mean(df, "date", "v", "2020-03-10", "2020-03-15").collect()}
    assert [got[d] for d in (10, 12, 15)] == pytest.approx([(5 + 6 + 7 + 8 + 9) / 10] * 3)
    assert got[9] == 9.0 and len(got) == 27


def test_pairs_need_both_sites(spark):
    d = lambda n: dt.date(2001, 4, n)
    df = spark.createDataFrame(
        [("WB", 2001, d(1), 5.0), ("WB", 2001, d(2), 9.0), ("RB", 2001, d(1), 4.0), ("RB", 2001, d(2), 6.0), ("WB", 2002, d(1), 1.0), (None, 2001, d(3), 1.0)],
        "site string, wyear int, date date, q_mm_cum double",
    )
    assert rows(pairs.at_period_end(df, ("RB", "WB"), "spr"), "wyear") == [(2001, 3.0, 0.5), (2002, None, None)]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "2", 3.0)], "A int, useB string, useC double")
    assert columns.lower_names(df).columns == ["a", "useb", "usec"]
    assert columns.matching(df, prefix="use") == ["useB", "useC"] and columns.matching(df, suffix="C") == ["useC"]
    assert columns.name_range(df, "useB") == ["useB", "useC"]
    assert columns.leading(df, ["useC"]).columns == ["useC", "A", "useB"]
    assert columns.drop_listed(df, ["A", "nothing"]).columns == ["useB", "useC"]
    assert columns.cast_to(df, {"useB": "int"}).first()["useB"] == 2


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "new").mkdir()
    (tmp_path / "old" / "a.csv").write_text("date,airtemp_c,precip\n1/2/2003 4:05,NA,7\n")
    (tmp_path / "new" / "b.csv").write_text("date,airtemp_c\n1/2/2003 5:05,1.5\nbad,x\n")
    df = files.read_csv_folder(spark, str(tmp_path), {"old/*.csv": "date string, airtemp_c double, precip double", "new/*.csv": "date string, airtemp_c double"})
    got = rows(df.select(calendar.parse_timestamp(F.col("date")).alias("t"), "airtemp_c", "precip"), F.col("t").asc_nulls_last())
    assert got == [(dt.datetime(2003, 1, 2, 4, 5), None, 7.0), (dt.datetime(2003, 1, 2, 5, 5), 1.5, None), (None, None, None)]


def test_columns_are_found_by_each_files_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y\n1,10,100\n")
    (tmp_path / "b.csv").write_text('"y","id","x"\n200,2,20\n')
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.csv").write_text("\ufeffid,y\n3,300\n4,bad\n")
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("x,id,y\n50,5,NA\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "[odd]*.csv").write_text("y,x,id\n600,60,6\n")
    (tmp_path / "_hidden.csv").write_text("nothing\n1\n")
    (tmp_path / "notes.txt").write_text("nothing\n1\n")
    got = rows(files.read_csv(spark, str(tmp_path), "id long, x double, y double", "path").withColumn("path", F.element_at(F.split("path", "/"), -1)), "id")
    assert [r[:3] for r in got] == [(1, 10.0, 100.0), (2, 20.0, 200.0), (3, None, 300.0), (4, None, None), (5, 50.0, None), (6, 60.0, 600.0)]
    assert [r[3] for r in got][:5] == ["a.csv", "b.csv", "c.csv", "c.csv", "d.csv.gz"]
    inferred = files.read_csv(spark, str(tmp_path))
    assert dict(inferred.dtypes) == {"id": "bigint", "x": "bigint", "y": "string"}
    assert rows(inferred.select("id", "x"), "id")[2:4] == [(3, None), (4, None)]


def test_wrong_headers_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,xx\n1,10\n")
    (tmp_path / "b.csv").write_text("id,x,x\n1,10,11\n")
    with pytest.raises(ValueError, match="unknown columns xx"):
        files.read_csv(spark, f"{tmp_path}/a.csv", "id long, x double")
    with pytest.raises(ValueError, match="twice"):
        files.read_csv(spark, f"{tmp_path}/b.csv", "id long, x double")
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, f"{tmp_path}/none.csv", "id long")


# texts of a column and the type they have
COLUMNS = [
    (["1", "-2", None, "NA", " 3 "], "bigint"),
    (["9223372036854775808", "1"], "double"),
    (["1", "2.5", "1e3", ".5", "NaN", "-Inf"], "double"),
    (["007", "1"], "string"),
    (["0", "0.5"], "double"),
    (["TRUE", "F", "false"], "boolean"),
    (["TRUE", "1"], "string"),
    (["2001-02-03", "2001/2/3"], "date"),
    (["2001-02-03", "2001-02-03 04:05", "2001-02-03T04:05:06.5"], "timestamp_ntz"),
    (["2001-02-30"], "string"),
    (["2001-02/03"], "string"),
    (["", None, "NA"], "boolean"),
    (["1", "x"], "string"),
    (["1d", "2"], "string"),
]


def test_types_from_texts(spark):
    names = [f"c {i}" for i in range(len(COLUMNS))]
    longest = max(len(texts) for texts, _ in COLUMNS)
    rows_ = list(zip(*[[*texts, *[None] * (longest - len(texts))] for texts, _ in COLUMNS]))
    df = spark.createDataFrame(rows_, ", ".join(f"`{n}` string" for n in names)).repartition(4)
    assert columns.infer_types(df, names) == dict(zip(names, (t for _, t in COLUMNS)))
    typed = columns.retype(df.withColumn("kept", F.lit(1)))
    assert dict(typed.dtypes) == dict(zip(names, (t for _, t in COLUMNS))) | {"kept": "int"}
    got = {n: sorted((r[n] for r in typed.collect() if r[n] is not None), key=str) for n in names}
    assert got["c 0"] == [-2, 1, 3] and got["c 5"] == [False, False, True]
    assert got["c 7"] == [dt.date(2001, 2, 3)] * 2
    assert got["c 8"] == [dt.datetime(2001, 2, 3), dt.datetime(2001, 2, 3, 4, 5), dt.datetime(2001, 2, 3, 4, 5, 6, 500000)]
    assert columns.retype(df.limit(0)).dtypes[0] == ("c 0", "boolean")


# withdrawals of one published water year, October to September (fixed values)
USE_1999 = [(10, 0.0), (11, 9.3), (12, 21.1), (1, 16.4), (2, 5.5), (3, 1.2)] + [(m, None) for m in range(4, 10)]


def test_yearly_use_reaches_the_published_total(spark):
    from freshet.plans.daily import monthly_use

    df = spark.createDataFrame([(1999, m, v, None, None) for m, v in USE_1999], "wyear int, month int, use_snowmaking_mm double, use_diverted_mm double, use_golf_mm double")
    got = {r["month"]: r for r in monthly_use(df).collect()}
    assert got[9]["use_total_mm_cum"] == pytest.approx(53.5) and got[10]["use_total_mm_cum"] == 0.0
    assert got[12]["use_total_mm_cum"] == pytest.approx(30.4)
    assert got[10]["year"] == 1998 and got[9]["year"] == 1999


# published sweep: run, rows, cols, clusters, qe, npf (fixed values)
SWEEP = [
    (1, 12, 15, 3, 0.010887, 1511.374178), (2, 13, 15, 3, 0.010315, 1395.672584), (3, 11, 16, 3, 0.011086, 1571.126436),
    (4, 12, 16, 3, 0.010504, 1436.377163), (5, 13, 16, 3, 0.009926, 1460.620513), (6, 12, 15, 3, 0.010973, 1550.322215),
    (7, 13, 15, 3, 0.010167, 1000.570223), (8, 11, 16, 3, 0.010896, 1305.918059), (9, 12, 16, 3, 0.010182, 1767.881446),
    (10, 13, 16, 3, 0.009866, 767.179401), (11, 12, 15, 4, 0.010955, 1290.052572), (12, 13, 15, 4, 0.0101, 1467.22065),
    (13, 11, 16, 4, 0.010904, 1407.725082), (14, 12, 16, 4, 0.010383, 1252.971506), (15, 13, 16, 4, 0.009875, 1383.295159),
    (16, 12, 15, 4, 0.01085, 1367.32042), (17, 13, 15, 4, 0.010035, 1716.028164), (18, 11, 16, 4, 0.01092, 1647.201004),
    (19, 12, 16, 4, 0.010516, 1433.76666), (20, 13, 16, 4, 0.009864, 1342.373273), (21, 12, 15, 5, 0.010759, 1117.534807),
    (22, 13, 15, 5, 0.010025, 1592.268761), (23, 11, 16, 5, 0.010722, 1379.003274), (24, 12, 16, 5, 0.01024, 1084.92755),
    (25, 13, 16, 5, 0.009684, 1344.919864), (26, 12, 15, 5, 0.010912, 1213.879743), (27, 13, 15, 5, 0.010388, 1494.200962),
    (28, 11, 16, 5, 0.010765, 1004.432386), (29, 12, 16, 5, 0.010362, 1239.288311), (30, 13, 16, 5, 0.009968, 1499.573986),
]


def test_run_selection_on_the_published_sweep(spark):
    df = spark.createDataFrame(SWEEP, "run long, rows int, cols int, clusters int, qe double, npf double")
    half = ranking.upper_half(df, "npf", "run")
    assert [r["run"] for r in ranking.sort_rows(half, "-npf").collect()] == [9, 17, 18, 22, 3, 6, 1, 30, 27, 12, 5, 4, 19, 13, 2]
    best = half.groupBy("clusters").agg(F.min_by("run", F.struct("qe", "run")).alias("run"))
    assert rows(best, "clusters") == [(3, 5), (4, 17), (5, 30)]
    median = quantiles.exact_quantiles(df, [], "npf", {"m": 0.5}).first()["m"]
    assert median / df.agg(F.max("qe")).first()[0] == pytest.approx(125336.8096, abs=1e-3)


def test_levels_are_bounded(spark):
    df = spark.createDataFrame([(3,), (1,), (None,), (3,), (2,)], "k int")
    assert reshape.levels_of(df, "k") == reshape.levels_of(df, "k", most=3) == [1, 2, 3]
    assert reshape.levels_of(df.limit(0), "k") == []
    with pytest.raises(ValueError, match="more than 2"):
        reshape.levels_of(df, "k", most=2)
