"""Sensor roll-ups on a stream.

Only windows that changed are emitted per micro-batch and written as one folder
per batch id, so a repeated batch replaces its own output. The current state of
a window is its row with the highest batch id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from freshet.functions.calendar import position
from freshet.functions.nulls import strict_sum
from freshet.session import shared_dir


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: str, time: str, per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream, with an event-time column a watermark accepts.

    A time without zone is read as UTC, so hours and days are those of the readings
    whatever the session's time zone.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    stream = reader.parquet(folder)
    return stream.withColumn(time, F.timestamp_micros(position(stream, time).cast("long")))


def wall_time(instant: Column) -> Column:
    """The time without zone that read_stream turned into this instant."""
    seconds = (F.unix_micros(instant) / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def drain(frame: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run a windowed stream over everything available and return the final windows."""
    spark = frame.sparkSession
    base = shared_dir(spark, label)

    batches = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (
        frame.writeStream.outputMode("update")
        .option("checkpointLocation", f"{base}/state")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not batches:  # an empty stream has no windows
        return spark.createDataFrame([], frame.schema).select(*keys, *[c for c in frame.columns if c not in keys])
    written = spark.read.schema(StructType([*frame.schema.fields]).add("batch", "long")).parquet(f"{base}/out")
    rest = [c for c in frame.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.col("batch")).alias("_row")
    return written.groupBy(*keys).agg(latest).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def hourly_mean(stream: DataFrame, time: str, station: str, values: Sequence[str], lateness: str = "1 hour") -> DataFrame:
    """Hourly mean of each value per station, missing readings skipped."""
    out = (
        stream.withWatermark(time, lateness)
        .groupBy(F.window(time, "1 hour"), station)
        .agg(*[F.avg(v).alias(v) for v in values])
        .select(wall_time(F.col("window.start")).alias("time_hourly"), station, *values)
    )
    return drain(out, ["time_hourly", station], "hourly")


def daily_total(stream: DataFrame, time: str, station: str, value: str, name: str, lateness: str = "1 day") -> DataFrame:
    """Daily total per station, missing as soon as one reading is missing."""
    out = (
        stream.withWatermark(time, lateness)
        .groupBy(F.window(time, "1 day"), station)
        .agg(strict_sum(value).alias(name))
        .select(F.to_date(wall_time(F.col("window.start"))).alias("date"), station, name)
    )
    return drain(out, ["date", station], "daily")
