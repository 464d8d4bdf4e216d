"""Tables written between stages.

A written table cuts the lineage, survives the loss of executors and has known
size statistics. They live below the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from freshet.session import shared_dir

_written: dict[tuple, str] = {}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it back."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(frames: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Write independent tables at the same time: their jobs share the executors."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(lambda item: stage(item[1], item[0]), frames.items()))


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files of a folder, and of the folders in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed(where: str, deep: bool) -> list[tuple]:
        out = []
        for f in fs.listStatus(path(where)):
            name = f.getPath().toString()
            out.append((name, f.getLen(), f.getModificationTime()))
            if deep and f.isDirectory():
                out += listed(name, False)
        return out

    return tuple(sorted(listed(folder, True)))


def stage_once(spark: SparkSession, folder: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that label for an input folder, built on first use in this application.

    Input files that have changed since give a new table.
    """
    key = (spark.sparkContext.applicationId, folder, label, _state(spark, folder))
    if key in _written:
        try:
            return spark.read.parquet(_written[key])
        except AnalysisException:  # removed in the meantime: build it again
            pass
    path = shared_dir(spark, label)
    build().write.parquet(path)
    _written[key] = path
    return spark.read.parquet(path)
