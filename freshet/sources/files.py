"""Reading and writing files. CSV columns are found by the names in each file's own header."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from freshet.operators.columns import retype

MISSING = "NA"  # how a missing value is written
HEADERS_AT_ONCE = 32


def csv_files(spark: SparkSession, path: str | Sequence[str], pattern: str = r"\.csv(\.\w+)?$") -> list[str]:
    """Files at the paths and below them whose names match; names that begin with _ or . are not data."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for root in [path] if isinstance(path, str) else path:
        where = jvm.org.apache.hadoop.fs.Path(root)
        fs = where.getFileSystem(conf)
        status = fs.globStatus(where)
        if not status:
            raise FileNotFoundError(root)
        for top in status:
            if top.isFile():
                found.append(top.getPath().toString())
                continue
            below = fs.listFiles(top.getPath(), True)
            base = top.getPath().toString()
            while below.hasNext():
                name = below.next().getPath().toString()
                parts = name[len(base) :].split("/")
                if re.search(pattern, parts[-1]) and not any(p[:1] in ("_", ".") for p in parts):
                    found.append(name)
    return sorted(found)


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in a file's first line; none if the file is empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        source = codec.createInputStream(stream) if codec else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line.removeprefix("﻿")]))) if line else ()


def headers(spark: SparkSession, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header: one line of each file is read, many at a time. Empty files are left out."""
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        names = list(pool.map(lambda f: _header(spark, f), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, own in zip(files, names):
        if own:
            out.setdefault(own, []).append(file)
    return out


def _schema(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _literal(path: str) -> str:
    """A file's name as a pattern that matches only it."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _bind(spark: SparkSession, groups: Mapping[tuple[str, ...], Sequence[str]], wanted: StructType, source: str | None) -> DataFrame:
    """One scan per distinct header, each in the order of its own header, bound by name."""
    fields = {f.name: f for f in wanted.fields}
    parts = []
    for names, files in groups.items():
        if len(set(names)) < len(names):
            raise ValueError(f"{files[0]}: a name twice in the header {', '.join(names)}")
        if unknown := [n for n in names if n not in fields]:
            raise ValueError(f"{files[0]}: unknown columns {', '.join(unknown)} in the header {', '.join(names)}")
        own = StructType([StructField(n, fields[n].dataType) for n in names])
        reader = spark.read.schema(own).option("header", True).option("nullValue", MISSING).option("mode", "PERMISSIVE").option("enforceSchema", True)
        part = reader.csv([_literal(f) for f in files])
        tag = [source_file().alias(source)] if source else []
        here = [F.col(f"`{n}`") if n in names else F.lit(None).cast(fields[n].dataType).alias(n) for n in fields]
        parts.append(part.select(*here, *tag))
    if not parts:
        return spark.createDataFrame([], StructType([*wanted.fields, *([StructField(source, StringType())] if source else [])]))
    return reduce(DataFrame.unionByName, parts)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | StructType | None = None, source: str | None = None) -> DataFrame:
    """CSV files with header rows, bound by column name.

    Every file's columns are found by its own header, so files may order them differently; a column that a
    file lacks is null there, and a name that the schema does not have is an error. Fields that do not fit
    their type become null. Without a schema the columns are the names of all headers in order of
    appearance, and their types are found by one pass over all rows. ``source`` names a column for the path of
    the file of each row.
    """
    groups = headers(spark, csv_files(spark, path))
    if schema is not None:
        return _bind(spark, groups, _schema(schema), source)
    names = list(dict.fromkeys(n for own in groups for n in own))
    texts = _bind(spark, groups, StructType([StructField(n, StringType()) for n in names]), source)
    return retype(texts, names)


def read_csv_folder(spark: SparkSession, folder: str, schemas: str | StructType | dict[str, str] | None = None, source: str | None = None) -> DataFrame:
    """Every CSV file below a folder, row-bound by column name, as ``read_csv`` reads one.

    ``schemas`` may also map a file or folder name pattern to the schema of its files.
    """
    if not isinstance(schemas, dict):
        return read_csv(spark, folder, schemas, source)
    parts = [read_csv(spark, f"{folder}/{pattern}", schema, source) for pattern, schema in schemas.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def source_file() -> Column:
    """The path of the file a row was read from."""
    return F.col("_metadata.file_path")


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("nullValue", MISSING)
    writer.partitionBy(*partition_by).csv(path) if partition_by else writer.csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, the format between stages, in files of bounded size."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000)
    writer.partitionBy(*partition_by).parquet(path) if partition_by else writer.parquet(path)
