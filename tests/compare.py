"""Comparison of a Spark result with another engine's result: names, types, rows and values."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


# Spark type name -> names the other engine may use for it
TYPES = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP"},
    "boolean": {"BOOLEAN"},
}


def _rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        col = frame[c]
        if pd.api.types.is_datetime64_any_dtype(col):
            frame[c] = col.astype("datetime64[us]").astype(str).where(col.notna(), None)
        elif pd.api.types.is_numeric_dtype(col):
            frame[c] = col.astype("float64")
        else:
            frame[c] = [None if v is None or v != v else (str(v)[:10] if hasattr(v, "isoformat") else v) for v in col]
            if all(v is None or isinstance(v, (int, float)) for v in frame[c]):
                frame[c] = frame[c].astype("float64")
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def differences(spark_result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; empty if the two results are the same."""
    relation = con.execute(sql)
    other_types = {d[0]: str(d[1]) for d in relation.description}
    other = relation.df()
    mine = spark_result.toPandas()
    names = sorted(mine.columns), sorted(other.columns)
    if names[0] != names[1]:
        return [f"columns {names[0]} / {names[1]}"]
    out = []
    for f in spark_result.schema.fields:
        allowed = TYPES.get(f.dataType.simpleString(), set())
        if other_types[f.name] not in allowed:
            out.append(f"type of {f.name}: {f.dataType.simpleString()} / {other_types[f.name]}")
    if len(mine) != len(other):
        return out + [f"rows {len(mine)} / {len(other)}"]
    a, b = _rows(mine), _rows(other)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            out.append(f"{c}: {int((~same).sum())} rows, first {a.loc[i].to_dict()} / {b.loc[i].to_dict()}")
    return out
