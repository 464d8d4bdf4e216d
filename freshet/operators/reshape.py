"""Wide/long conversion and row binding."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from freshet.functions.calendar import day_month_date
from freshet.operators.ordered import row_numbers


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing from one table is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str = "var", values_to: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), names_to, values_to)


def levels_of(df: DataFrame, key: str, most: int = 10_000) -> list:
    """The values of a key column that is to become columns, in order: one distinct pass.

    More than ``most`` values raise an error: they would neither fit the driver nor make a table.
    """
    found = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"column {key} has more than {most} values")
    return [r[0] for r in found]


def to_wide(df: DataFrame, ids: Sequence[str], key: str, levels: Sequence, values: Sequence[str], name: str = "{value}_{level}") -> DataFrame:
    """One column per level and value. The levels are given, so no extra pass looks for them.

    Each cell is one conditional aggregate: one hash aggregation, no sort. The
    level is looked up once per row, so the conditions compare whole numbers.
    """
    kind = df.schema[key].dataType
    slot = F.array_position(F.array(*[F.lit(v).cast(kind) for v in levels]), F.col(key)).cast("int")
    cells = [
        F.max(F.when(F.col("_slot") == i, F.col(v))).alias(name.format(value=v, level=level))
        for v in values
        for i, level in enumerate(levels, 1)
    ]
    return df.withColumn("_slot", slot).groupBy(*ids).agg(*cells)


def tidy_water_years(wide: DataFrame, label: str, series: Iterable[str], value: str, century: int = 2000) -> DataFrame:
    """A matrix with one row per calendar day and one column per site and water year, as a daily series.

    Column names start with the two-letter site code and contain the year; they
    are taken apart once, when the plan is made, not for every cell. Days are
    numbered within each site and water year in date order before labels that are
    no date in that year (29-Feb) are dropped; those sort last.
    """
    cells = []
    for name in series:
        year = int(re.search(r"\d+", name).group()) + century
        cells.append(F.struct(F.lit(name[:2]).alias("site"), F.lit(year).alias("wyear"), F.col(f"`{name}`").alias(value)))
    long = wide.select(label, F.inline(F.array(*cells)))
    named = long.select("site", "wyear", day_month_date(F.col(label), F.col("wyear")).alias("date"), value)
    named = named.withColumn("_no_date", F.col("date").isNull())
    numbered = row_numbers(named, ["site", "wyear"], ["_no_date", "date"], "doy_wyear")
    return numbered.where(F.col("date").isNotNull()).select("site", "wyear", "date", "doy_wyear", value)
