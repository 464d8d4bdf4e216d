"""Closed windows of a stream, with late readings kept apart.

Two queries share a folder. The first takes rows in: what comes after its window was closed goes to the late
table, the rest to the table of admitted rows, so nothing that arrives is lost without a trace. The second adds up the
admitted rows in append mode: a window is written once, when the watermark has passed its end.

Both tables have one folder per micro-batch. A batch that is run again after a stop has the same rows and
replaces, or finds, its own folder, so each row counts once. The watermark of a batch is the latest time of
all batches before it less the lateness, as in the second query; it is stored with every batch. Small folders
of closed windows are merged by ``compact``, which readers see at once and in whole.

An empty stream gives empty tables. Rows without a time belong to no window and are late. Times without zone
are read as UTC.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from freshet.streaming.rollups import wall_time

ROWS, MARKS, CLOSED = "rows", "marks", "closed"
MARK = "high timestamp, watermark timestamp"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _complete(spark: SparkSession, folder: str) -> bool:
    fs, path = _files(spark, f"{folder}/_SUCCESS")
    return fs.exists(path)


def _numbered(spark: SparkSession, folder: str, label: str) -> list[int]:
    """Numbers of the complete folders ``label=n``."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    found = [re.fullmatch(rf"{label}=(\d+)", s.getPath().getName()) for s in fs.listStatus(path)]
    return sorted(int(m[1]) for m in found if m and _complete(spark, f"{folder}/{m[0]}"))


def _mark(spark: SparkSession, base: str, batch: int):
    return spark.read.schema(MARK).parquet(f"{base}/{MARKS}/batch={batch}").first() if batch >= 0 else None


def take_in(stream: DataFrame, time: str, width: str, lateness: str, base: str) -> None:
    """Run a stream over everything available: its rows, marked late or not, in one folder per micro-batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = _mark(spark, base, number - 1)
        limit = F.lit(before["high"] if before else None).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        closes = F.window(time, width)["end"]
        late = F.col(time).isNull() | F.coalesce(closes <= limit, F.lit(False))
        folder = f"{base}/{ROWS}/batch={number}"
        if not _complete(spark, folder):  # run again after a stop: what the second query may have read stays
            batch.withColumns({"late": late, "watermark": limit}).write.mode("overwrite").partitionBy("late").parquet(folder)
        fields = StructType([*batch.schema.fields])
        seen = Observation()
        taken = spark.read.schema(fields).parquet(folder).observe(seen, F.max(time).alias("high"))
        taken.select(time).write.format("noop").mode("overwrite").save()
        high = [t for t in (seen.get["high"], before["high"] if before else None) if t is not None]
        mark = spark.createDataFrame([(max(high, default=None),)], "high timestamp").select("high", limit.alias("watermark"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{base}/{MARKS}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state-rows").trigger(availableNow=True).start().awaitTermination()


def close(spark: SparkSession, schema: StructType, time: str, width: str, keys: Sequence[str], values: Sequence[Column], lateness: str, base: str) -> None:
    """Add up the admitted rows and write every window that the watermark has passed, once."""
    if not _numbered(spark, f"{base}/{ROWS}", "batch"):
        return
    rows = spark.readStream.schema(schema).parquet(f"{base}/{ROWS}/batch=*/late=false")
    grouped = rows.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(*values)
    out = grouped.select(wall_time(F.col("window.start")).alias("from"), wall_time(F.col("window.end")).alias("upto"), *[c for c in grouped.columns if c != "window"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{CLOSED}/batch={number}")

    query = out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{base}/state-closed")
    query.trigger(availableNow=True).start().awaitTermination()


def _layout(spark: SparkSession, base: str) -> tuple[list[int], list[int]]:
    """(the newest merged folder, the batches after it)."""
    merged = _numbered(spark, f"{base}/{CLOSED}", "merged")[-1:]
    return merged, [b for b in _numbered(spark, f"{base}/{CLOSED}", "batch") if not merged or b > merged[0]]


def closed(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """All closed windows so far."""
    merged, batches = _layout(spark, base)
    folders = [f"{base}/{CLOSED}/merged={m}" for m in merged] + [f"{base}/{CLOSED}/batch={b}" for b in batches]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def late(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """All readings that came after their window was closed, with the watermark they met."""
    fields = StructType([*schema.fields]).add("watermark", "timestamp")
    folders = f"{base}/{ROWS}/batch=*/late=true"
    fs, path = _files(spark, folders)
    return spark.read.schema(fields).parquet(folders) if fs.globStatus(path) else spark.createDataFrame([], fields)


def compact(spark: SparkSession, base: str, schema: StructType, rows_per_file: int = 5_000_000) -> None:
    """Merge the closed windows of all batches but the last into one folder, then remove what it replaces.

    The last batch may be run again after a stop and stays. Readers take the newest complete merged folder and the
    batches after it, so they see each window once at any moment; a merge that stops half-way is not seen.
    """
    merged, batches = _layout(spark, base)
    if len(batches) < 2:
        return
    last = batches[-2]
    old = [f"merged={m}" for m in merged] + [f"batch={b}" for b in batches[:-1]]
    rows = spark.read.schema(schema).parquet(*[f"{base}/{CLOSED}/{o}" for o in old])
    # as many tasks as full files; none grows with the number of batches
    files = max(1, -(-rows.count() // rows_per_file))
    rows.repartitionByRange(files, "from").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{base}/{CLOSED}/merged={last}")
    for o in old:
        fs, path = _files(spark, f"{base}/{CLOSED}/{o}")
        fs.delete(path, True)


def roll_up(stream: DataFrame, time: str, keys: Sequence[str], values: Sequence[Column], width: str, lateness: str, base: str) -> tuple[DataFrame, DataFrame]:
    """(closed windows, late rows) after everything that is available; the next call goes on from there."""
    spark = stream.sparkSession
    take_in(stream, time, width, lateness, base)
    close(spark, stream.schema, time, width, keys, values, lateness, base)
    shape = spark.createDataFrame([], stream.schema).groupBy(*keys).agg(*values)
    schema = StructType().add("from", "timestamp_ntz").add("upto", "timestamp_ntz")
    for f in shape.schema.fields:
        schema = schema.add(f)
    return closed(spark, base, schema), late(spark, base, stream.schema)
