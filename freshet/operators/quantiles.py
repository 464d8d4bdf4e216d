"""Exact quantiles and order statistics that never gather a whole group.

The built-in exact percentile keeps every distinct value of a group in one
aggregation buffer. Here a sketch first brackets each wanted rank; then one
aggregation counts what lies below the bracket and the values inside it, and
only the bracket, a thousandth of the group, is ranked. Equal values are
collapsed to one counted row before ranking, so a value that fills a third of
a group costs one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.joins import join_matching_nulls
from freshet.sources.stages import stage

ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY  # five times the sketch's rank error
WHOLE = 2 * ACCURACY  # groups of fewer values are bracketed by their whole range
GRID_STEPS = 1000


def _ranked_bracket(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Rows (group, which, n, v, upto, since), v covering ranks since+1 .. upto inside each bracket; and the groups."""
    low = [max(s - MARGIN, 0.0) for s in shares]
    high = [min(s + MARGIN, 1.0) for s in shares]
    rows = df.select(*group, F.col(value).alias("_v"))
    sketch = rows.groupBy(*group).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", [*low, *high], ACCURACY).alias("_marks"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    # a bracket touching the end of the range starts or stops exactly there
    few = F.col("_n") < WHOLE
    edges = F.array(
        *[
            F.struct(
                F.lit(i).alias("which"),
                F.when(few | F.lit(lo <= 0.0), F.col("_min")).otherwise(F.col("_marks")[i]).alias("low"),
                F.when(few | F.lit(hi >= 1.0), F.col("_max")).otherwise(F.col("_marks")[len(shares) + i]).alias("high"),
            )
            for i, (lo, hi) in enumerate(zip(low, high))
        ]
    )
    # written out, so its size is known: Spark then broadcasts it only if it is small
    sketch = stage(sketch.select(*group, "_n", edges.alias("_edges")), "sketch")
    present = rows.where(F.col("_v").isNotNull())
    if group:
        present = join_matching_nulls(present, sketch, group, "inner")
    else:
        one = sketch.select(F.struct("_n", "_edges").alias("s")).scalar()
        present = present.withColumns({c: one[c] for c in ("_n", "_edges")})
    return _count_brackets(present, group), sketch.select(*group)


def _count_brackets(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    e = F.col("_edge")
    inside = (
        rows.withColumn("_edge", F.explode("_edges"))
        .where(F.col("_v") <= e["high"])
        .select(*group, e["which"].alias("_which"), "_n", F.when(F.col("_v") >= e["low"], F.col("_v")).alias("_v"))
    )
    # everything below the bracket falls into the row whose value is null, which sorts first
    counted = inside.groupBy(*group, "_which", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group, "_which").orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("_upto", upto).withColumn("_since", F.col("_upto") - F.col("_c"))


def _at_rank(rank: Column) -> Column:
    hit = (F.col("_since") < rank) & (rank <= F.col("_upto"))
    return F.max(F.when(hit, F.col("_v")))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation between neighbouring ranks, missing values skipped.

    exact_quantiles(df, ["cluster"], "x", {"q2": 0.25, "median": 0.5}).
    """
    shares = list(named.values())
    ranked, groups = _ranked_bracket(df, group, value, shares)
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("_which") + 1)
    at = (F.col("_n") - 1) * share
    floor = F.floor(at)
    per = ranked.withColumn("_at", at).withColumn("_floor", floor)
    picked = per.groupBy(*group, "_which").agg(
        _at_rank(F.col("_floor") + 1).alias("_a"),
        _at_rank(F.least(F.col("_floor") + 2, F.col("_n"))).alias("_b"),
        F.max(F.col("_at") - F.col("_floor")).alias("_f"),
    )
    lost = F.col("_a").isNull() | F.col("_b").isNull()
    quantile = F.when(lost, F.raise_error(F.lit("quantile rank outside its bracket"))).otherwise(
        F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))
    )
    found = picked.select(*group, "_which", quantile.alias("_q"))
    wide = found.groupBy(*group).agg(
        *[F.max(F.when(F.col("_which") == i, F.col("_q"))).alias(n) for i, n in enumerate(named)]
    )
    # a group without any value keeps its row
    return join_matching_nulls(groups, wide, group, "left") if group else wide


def value_at_rank(df: DataFrame, value: str, rank: Callable[[int], int]) -> float | int | None:
    """The value of a numeric column at a rank from below; ``rank`` gets the number of values.

    Two passes: a sketch of the column, then counts inside the bracket around the
    rank. The bracket's ends are constants, so the second pass can skip files.
    """
    present = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    grid = ", ".join(f"{i / GRID_STEPS}D" for i in range(GRID_STEPS + 1))
    n, marks, least, most = present.agg(
        F.count(F.lit(1)), F.expr(f"percentile_approx(_v, array({grid}), {ACCURACY})"), F.min("_v"), F.max("_v")
    ).first()
    wanted = rank(n)
    if not 1 <= wanted <= n:
        return None
    step = int(wanted / n * GRID_STEPS)
    low = least if n < WHOLE or step <= 2 else marks[step - 2]
    high = most if n < WHOLE or step >= GRID_STEPS - 3 else marks[step + 3]
    edge = F.array(F.struct(F.lit(0).alias("which"), F.lit(low).alias("low"), F.lit(high).alias("high")))
    rows = present.where(F.col("_v") <= high).withColumn("_n", F.lit(n)).withColumn("_edges", edge)
    found = _count_brackets(rows, []).agg(_at_rank(F.lit(wanted))).first()[0]
    if found is None:
        raise ValueError("rank outside its bracket")
    return found


def _inside(value: str, reach: float) -> Column:
    length = F.col("q3") - F.col("q1")
    return F.col(value).between(F.col("q1") - reach * length, F.col("q3") + reach * length)


def box_outliers(df: DataFrame, group: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """The rows, with all their columns, whose value lies more than ``reach`` box lengths outside their group's box.

    Rows without a value are none. The quartiles are one row per group, joined to the rows.
    """
    quartiles = exact_quantiles(df, group, value, {"q1": 0.25, "q3": 0.75})
    joined = join_matching_nulls(df, quartiles, group, "inner")
    return joined.where(~_inside(value, reach)).select(*df.columns)


def box_summary(df: DataFrame, group: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Minimum, quartiles, maximum and the outermost values within ``reach`` box lengths."""
    quartiles = exact_quantiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    joined = join_matching_nulls(df.select(*group, value), quartiles, group, "inner")
    inside = _inside(value, reach)
    return joined.groupBy(*group, "q1", "median", "q3").agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
    )
