"""Missing-value semantics: a missing input makes the result missing unless told otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: str | Column) -> Column:
    """Aggregate sum that is null as soon as one input is null."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_mean(c: str | Column) -> Column:
    """Aggregate mean that is null as soon as one input is null."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def choose(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is null where the condition is null."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def row_total(*cols: str | Column) -> Column:
    """Sum across columns of one row, nulls counting as zero."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(_col(c), F.lit(0.0))
    return total


def not_in(c: str | Column, values: Iterable) -> Column:
    """Negated membership that keeps null values."""
    return F.coalesce(~_col(c).isin(list(values)), F.lit(True))


def first_present(*cols: str | Column) -> Column:
    return F.coalesce(*[_col(c) for c in cols])


def any_null(cols: Iterable[str]) -> Column:
    test = F.lit(False)
    for c in cols:
        test = test | F.col(c).isNull()
    return test


def category_rank(c: str | Column, levels: Iterable, exclude: Iterable = ()) -> Column:
    """Position of a value in an ordered list of levels; excluded or unknown values are null."""
    kept = [v for v in levels if v not in set(exclude)]
    rank = F.array_position(F.array(*[F.lit(v) for v in kept]), _col(c))
    return F.when(rank > 0, rank)


def weighted(cols: Mapping[str, float]) -> dict[str, Column]:
    return {c: F.col(c) * F.lit(float(w)) for c, w in cols.items()}
