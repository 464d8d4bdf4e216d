"""Streams over several files: final windows equal the batch result, late rows are dropped."""

import datetime as dt
import random

from pyspark.sql import functions as F

from freshet.streaming import closing, rollups

SCHEMA = "ts timestamp_ntz, station string, v double"


def write(spark, folder, name, rows):
    spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), s, v) for m, s, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    source = rollups.read_stream(spark, f"{folder}/*", schema, "*.parquet", "ts", per_trigger=1)
    return source


def test_windows_spanning_files(spark, tmp_path):
    parts = [[(0, "a", 1.0), (50, "a", 3.0), (55, "b", None)], [(59, "a", 5.0), (61, "a", 7.0)], [(62, "b", 2.0), (130, "a", None)]]
    for i, part in enumerate(parts):
        write(spark, tmp_path, f"p{i}", part)
    got = rollups.hourly_mean(stream(spark, tmp_path), "ts", "station", ["v"])
    assert {(r["time_hourly"].hour, r["station"]): r["v"] for r in got.collect()} == {(0, "a"): 3.0, (0, "b"): None, (1, "a"): 7.0, (1, "b"): 2.0, (2, "a"): None}
    daily = rollups.daily_total(stream(spark, tmp_path), "ts", "station", "v", "total").collect()
    assert {(r["station"], r["total"]) for r in daily} == {("a", None), ("b", None)}


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    import time

    write(spark, tmp_path, "p0", [(0, "a", 1.0), (600, "a", 1.0)])
    time.sleep(1.1)  # files are taken in order of modification
    write(spark, tmp_path, "p1", [(601, "a", 3.0)])
    time.sleep(1.1)
    write(spark, tmp_path, "p2", [(1, "a", 100.0), (602, "a", 5.0)])
    got = rollups.hourly_mean(stream(spark, tmp_path), "ts", "station", ["v"])
    assert {(r["time_hourly"].hour, r["v"]) for r in got.collect()} == {(0, 1.0), (10, 3.0)}


def undo_last_commit(state):
    """As if the stream had stopped after its last batch was written and before that was noted."""
    last = max(int(p.name) for p in (state / "commits").iterdir() if p.name.isdigit())
    for p in (state / "commits").iterdir():
        if p.name.lstrip(".").removesuffix(".crc") == str(last):
            p.unlink()


def test_closed_windows_late_rows_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    minutes = [rng.randrange(0, 60 * 30) for _ in range(400)]
    order = sorted(range(400), key=lambda i: minutes[i] + rng.choice([0, 0, 0, rng.randrange(600)]))
    loads = [order[i : i + 50] for i in range(0, 400, 50)]
    values = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")]
    base, high = tmp_path / "state", None
    want, late_rows = {}, []
    for n, load in enumerate(loads):
        write(spark, tmp_path / "in", f"p{n}", [(minutes[i], "a" if i % 3 else "b", float(i)) for i in load])
        for i in load:
            closes = minutes[i] // 60 * 60 + 60
            if high is not None and closes <= high - 120:
                late_rows.append(float(i))
            else:
                key = minutes[i] // 60, "a" if i % 3 else "b"
                count, total = want.get(key, (0, 0.0))
                want[key] = count + 1, total + i
        high = max([minutes[i] for i in load] + [high or 0])
        source = rollups.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], SCHEMA).schema, "*.parquet", "ts")
        done, late = closing.roll_up(source, "ts", ["station"], values, "1 hour", "2 hours", str(base))
        if n in (2, 5):  # both queries run their last batch again
            undo_last_commit(base / "state-rows")
            undo_last_commit(base / "state-closed")
            done, late = closing.roll_up(source, "ts", ["station"], values, "1 hour", "2 hours", str(base))
        if n in (3, 6):
            before = sorted(map(tuple, done.collect()))
            closing.compact(spark, str(base), done.schema)
            done = closing.closed(spark, str(base), done.schema)
            assert sorted(map(tuple, done.collect())) == before
            assert len(list((base / "closed").glob("batch=*"))) == 1
    got = {((r["from"] - dt.datetime(2024, 1, 1)).total_seconds() // 3600, r["station"]): (r["n"], r["total"]) for r in done.collect()}
    assert got == {k: v for k, v in want.items() if k[0] * 60 + 60 <= high - 120}
    assert sorted(r["v"] for r in late.collect()) == sorted(late_rows) and late_rows


def test_closing_an_empty_stream(spark, tmp_path):
    write(spark, tmp_path / "in", "p0", [])
    source = rollups.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], SCHEMA).schema, "*.parquet", "ts")
    done, late = closing.roll_up(source, "ts", ["station"], [F.sum("v").alias("total")], "1 hour", "2 hours", f"{tmp_path}/state")
    assert done.collect() == [] and late.collect() == []
    assert done.columns == ["from", "upto", "station", "total"]
