"""Projection helpers that work on column names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F


def matching(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    """Names that start with prefix and end with suffix."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def name_range(df: DataFrame, first: str, last: str | None = None) -> list[str]:
    """Names from first to last (or to the end) in column order, both included."""
    names = df.columns
    stop = names.index(last) + 1 if last else len(names)
    return names[names.index(first) : stop]


def leading(df: DataFrame, first: Iterable[str]) -> DataFrame:
    """Move the named columns to the front and keep the rest in order."""
    first = list(first)
    return df.select(*first, *[c for c in df.columns if c not in first])


def drop_listed(df: DataFrame, *lists: Iterable[str]) -> DataFrame:
    """Drop every listed name; names that do not exist are ignored."""
    return df.drop(*{name for names in lists for name in names})


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def on_each(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Replace each named column by fn(column)."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def complete_cases(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(cols) if cols is not None else None)


def cast_to(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Re-type string columns; values that do not parse become null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


# what a text must look like, besides being a value of the type; a number has no zero in front of a digit,
# so that identifiers stay texts
_WHOLE = r"^[+-]?(0|[1-9]\d{0,18})$"
_NUMBER = r"^[+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?Inf$|^NaN$"
_DAY = r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"
_TRUTH = ("TRUE", "FALSE", "True", "False", "true", "false", "T", "F")
#: From narrow to wide: a column has the first type that all its texts fit, else it stays text. A whole number is also
#: a number and a day is also a time, so mixed columns have the wider of the two.
TYPES = ("boolean", "bigint", "double", "date", "timestamp_ntz")


def _value(text: Column, kind: str) -> Column:
    """A trimmed text as a value of the type, null where it does not fit."""
    if kind == "boolean":
        return F.when(text.isin(*_TRUTH), F.left(F.upper(text), F.lit(1)) == "T")
    if kind == "bigint":
        return F.when(text.rlike(_WHOLE), text.try_cast("bigint"))
    if kind == "double":
        return F.when(text.rlike(_NUMBER), text.try_cast("double"))
    day = F.when(text.rlike(_DAY), F.replace(text, F.lit("/"), F.lit("-")).try_cast("date"))
    if kind == "date":
        return day
    return F.coalesce(day.cast("timestamp_ntz"), F.when(text.rlike(_TIME), text.try_cast("timestamp_ntz")))


def _known(name: str, missing: Iterable[str]) -> Column:
    text = F.trim(F.col(f"`{name}`"))
    return F.when(~text.isin(*missing), text)


def infer_types(df: DataFrame, names: Iterable[str], missing: Iterable[str] = ("", "NA")) -> dict[str, str]:
    """The smallest type that every text of a column fits, by one aggregation over all rows.

    For each column and type it is kept whether any text does not fit, so the result does not depend on the order
    or the partitions of the rows; nothing is sampled. A column without texts is boolean, as nothing speaks
    against the smallest type.
    """
    names, missing = list(names), tuple(missing)

    def fits(name: str) -> Column:
        text = _known(name, missing)
        return F.struct(*[F.coalesce(F.bool_and(F.when(text.isNotNull(), _value(text, k).isNotNull())), F.lit(True)).alias(k) for k in TYPES])

    row = df.agg(*[fits(n).alias(f"c{i}") for i, n in enumerate(names)]).first() if names else ()
    return {n: next((k for k in TYPES if found[k]), "string") for n, found in zip(names, row)}


def retype(df: DataFrame, names: Iterable[str] | None = None, missing: Iterable[str] = ("", "NA")) -> DataFrame:
    """Text columns with the types that their texts have; missing marks become null. By default all text columns.

    A column that stays text keeps its spaces.
    """
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"] if names is None else list(names)
    missing = tuple(missing)
    types = infer_types(df, names, missing)
    to = {n: F.when(_known(n, missing).isNotNull(), F.col(f"`{n}`")) if t == "string" else _value(_known(n, missing), t) for n, t in types.items()}
    return df.select(*[to[c].alias(c) if c in to else F.col(f"`{c}`") for c in df.columns])
