"""Order-dependent operators against plain loops, in one window and in small pieces."""

import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import fills, ordered

WIDTHS = (1, 2, 3, 10, 11, 15, 16)


def gap_runs():
    """(series, t, v): leading and trailing nulls, null runs of the given lengths, irregular times."""
    rows, t, rnd = [], 0, random.Random(7)
    for series in ("a", "b"):
        values = [None, None]
        for width in WIDTHS:
            values += [float(rnd.randint(0, 9))] * rnd.randint(1, 4) + [None] * width
        values += [5.0, None, 2.0, None, None, None]
        for v in values:
            t += rnd.randint(1, 5)
            rows.append((series, t, v))
    # a series without any value, and a hot one holding most rows
    rows += [("empty", i, None) for i in range(30)]
    rows += [("hot", i, None if rnd.random() < 0.4 else float(rnd.randint(0, 3))) for i in range(600)]
    return rows


def by_series(rows):
    out = {}
    for s, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(s, []).append((t, v))
    return out


def runs_of_null(values):
    length = [0] * len(values)
    i = 0
    while i < len(values):
        j = i
        while j < len(values) and values[j] is None:
            j += 1
        for k in range(i, j):
            length[k] = j - i
        i = max(j, i + 1)
    return length


def loop_carry(points, gap):
    values = [v for _, v in points]
    lengths, out, last = runs_of_null(values), [], None
    for v, n in zip(values, lengths):
        if v is None and last is not None and n <= gap:
            out.append(last)
        else:
            out.append(v)
        last = v if v is not None else last
    return out


def loop_interpolate(points, gap):
    values = [v for _, v in points]
    lengths, out = runs_of_null(values), []
    for i, (t, v) in enumerate(points):
        p = next((k for k in range(i, -1, -1) if values[k] is not None), None)
        q = next((k for k in range(i, len(points)) if values[k] is not None), None)
        if v is None and p is not None and q is not None and lengths[i] <= gap:
            (x0, y0), (x1, y1) = points[p], points[q]
            v = y0 + (y1 - y0) * ((t - x0) / (x1 - x0))
        out.append(v)
    return out


def loop_rolling(points, width, mean=False):
    out = []
    for i in range(len(points)):
        part = [v for _, v in points[max(0, i - width + 1) : i + 1]]
        whole = len(part) == width and None not in part
        out.append(sum(part) / (width if mean else 1) if whole else None)
    return out


def loop_mode(points, width):
    half, out = width // 2, []
    for i in range(len(points)):
        if i < half or i + half >= len(points):
            out.append(None)
            continue
        part = [v for _, v in points[i - half : i + half + 1]]
        seen = list(dict.fromkeys(part))
        out.append(max(seen, key=lambda v: (part.count(v), -seen.index(v))))
    return out


def loop_cumsum(points):
    out, total = [], 0.0
    for _, v in points:
        total = None if v is None or total is None else total + v
        out.append(total)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame(gap_runs(), "s string, t int, v double")
    return df.withColumn("day", F.floor(F.col("t") / 20))


PIECES = [{}, {"chunk": "day", "block_rows": 17}, {"chunk": "day", "block_rows": 40}]


def check(result, expected_by_series):
    got = by_series([(r["s"], r["t"], r["out"]) for r in result.select("s", "t", "out").collect()])
    for s, points in by_series(gap_runs()).items():
        assert [v for _, v in got[s]] == pytest.approx(expected_by_series(points)), s


@pytest.mark.parametrize("pieces", PIECES)
@pytest.mark.parametrize("gap", [1, 2, 10, 15])
def test_carry_forward(frame, pieces, gap):
    out = fills.carry_forward(frame, ["s"], ["t"], ["v"], gap, **pieces).withColumnRenamed("v", "out")
    check(out, lambda p: loop_carry(p, gap))


@pytest.mark.parametrize("pieces", PIECES)
@pytest.mark.parametrize("gap", [2, 10, 15])
def test_interpolate(frame, pieces, gap):
    out = fills.interpolate(frame, ["s"], ["t"], "v", gap, F.col("t").cast("double"), "out", **pieces)
    check(out, lambda p: loop_interpolate(p, gap))


@pytest.mark.parametrize("pieces", PIECES)
@pytest.mark.parametrize("how", ["sum", "mean"])
def test_rolling(frame, pieces, how):
    out = ordered.rolling(frame, ["s"], ["t"], "v", 3, "out", how, **pieces)
    check(out, lambda p: loop_rolling(p, 3, how == "mean"))


@pytest.mark.parametrize("pieces", PIECES)
@pytest.mark.parametrize("width", [3, 5])
def test_rolling_mode(frame, pieces, width):
    out = ordered.rolling_mode(frame, ["s"], ["t"], "v", "out", width, **pieces)
    check(out, lambda p: loop_mode(p, width))


@pytest.mark.parametrize("chunk", [None, "day"])
def test_running_sum_and_row_numbers(frame, chunk):
    check(ordered.running_sum(frame, ["s"], ["t"], "v", "out", chunk), loop_cumsum)
    whole = frame.fillna(1.0)
    got = ordered.running_sum(whole, ["s"], ["t"], "v", "out", chunk).where("s = 'hot'").orderBy("t").collect()
    assert got[-1]["out"] == pytest.approx(sum(r["v"] for r in got))
    numbered = ordered.row_numbers(frame, ["s"], ["t"], "out", chunk)
    check(numbered, lambda p: list(range(1, len(p) + 1)))


def test_every_triple_of_three_labels(spark):
    triples = [(i, k, lab) for i, t in enumerate((a, b, c) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)) for k, lab in enumerate(t)]
    df = spark.createDataFrame(triples, "g int, k int, lab int")
    got = ordered.rolling_mode(df, ["g"], ["k"], "lab", "m").where("k = 1").collect()
    for r in got:
        part = [lab for g, k, lab in triples if g == r["g"]]
        assert r["m"] == loop_mode(list(enumerate(part)), 3)[1]


def test_windows_do_not_cross_sites(spark):
    df = spark.createDataFrame([(s, t, 1.0) for s in "ab" for t in range(4)], "s string, t int, v double")
    got = ordered.rolling(df, ["s"], ["t"], "v", 3, "out").orderBy("s", "t").collect()
    assert [r["out"] for r in got] == [None, None, 3.0, 3.0] * 2


def test_no_row_is_lost_with_a_missing_series_key(spark):
    df = spark.createDataFrame([(None, t, 1.0, t // 3) for t in range(9)], "s string, t int, v double, day int")
    got = ordered.rolling(df, ["s"], ["t"], "v", 3, "out", chunk="day", block_rows=4).orderBy("t").collect()
    assert [r["out"] for r in got] == [None, None] + [3.0] * 7


def test_irregular_dates(spark):
    import datetime as dt

    known = {0: 1.0, 1: 2.0, 4: 8.0, 10: 2.0}
    days = [(dt.date(2001, 1, 1) + dt.timedelta(d), known.get(d)) for d in (0, 1, 3, 4, 6, 9, 10)]
    df = spark.createDataFrame([("x", d, v) for d, v in days], "s string, date date, v double")
    got = fills.interpolate(df, ["s"], ["date"], "v", 10, F.unix_date("date").cast("double")).orderBy("date").collect()
    assert [r["v"] for r in got] == pytest.approx([1, 2, 6, 8, 6, 3, 2])


@pytest.mark.parametrize("rows", [1, 40, 10_000])
def test_chunks_follow_the_order_and_split_hot_instants(spark, rows):
    """A third of all rows at one instant and missing times, cut into chunks of any size."""
    rnd = random.Random(4)
    data = [(i, 500 if i % 3 == 0 else (None if i % 50 == 1 else rnd.randint(0, 1000)), 1) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, t long, v long").repartition(4)
    chunked = ordered.with_chunks(df, ["t", "id"], rows=rows)
    got = ordered.row_numbers(chunked, [], ["t", "id"], "n", "_chunk").orderBy("n").collect()
    assert [(r["t"], r["id"]) for r in got] == sorted(((t, i) for i, t, _ in data), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    assert [r["n"] for r in got] == list(range(1, 3001))
    sums = ordered.running_sum(chunked, [], ["t", "id"], "v", "s", "_chunk").orderBy("t", "id").collect()
    assert [r["s"] for r in sums] == list(range(1, 3001))
    if rows == 40:
        assert max(chunked.groupBy("_chunk").count().toPandas()["count"]) < 200


def test_long_queries_work_on_many_chunks_and_blocks(spark):
    from freshet.plans import catalogue

    readings = catalogue._long_sensor(spark, "/root/testdata/sf0.01")
    assert readings.select("_chunk").distinct().count() >= 20
    per_station = readings.groupBy("station").count().collect()
    assert sum(-(-r["count"] // catalogue.PIECE) for r in per_station) >= 20


def test_time_positions_do_not_depend_on_the_session_zone(spark):
    from freshet.functions.calendar import position

    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.000001' AS t UNION ALL SELECT timestamp_ntz'2024-03-10 03:10:00'")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in df.select(position(df, "t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(got) == [1710037800000001.0, 1710040200000000.0]
