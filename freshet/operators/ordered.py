"""Order-dependent measures over series.

Every function takes ``group`` (the series), ``order`` (a total order inside a
series) and an optional ``chunk``. Without it a series is one window partition,
which is right for daily rows: a site has at most 366 of them per water year.

With ``chunk``, a column that never decreases along ``order``, a series of any
length is worked on piecewise, however many of all rows it holds. with_chunks
adds one whose chunks hold about the same number of rows, however the rows are
spread over time.

* unbounded measures (row numbers, running sums) run inside each chunk, and one
  row of totals per chunk carries the state over;
* measures that look at a bounded number of neighbours (rolling windows, gap
  fills) run on blocks of consecutive rows, to which copies of the few
  neighbouring rows are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.calendar import position
from freshet.operators.joins import join_matching_nulls
from freshet.sources.stages import stage

BLOCK_ROWS = 100_000  # rows per block of a long series

CHUNK_ROWS = 1_000_000  # rows per chunk aimed at by with_chunks
STEPS = 2000
ACCURACY = 20_000

Piece = Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]


def _before(group: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running(group: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _marks(df: DataFrame, position: Column, rows: int) -> list[float]:
    """Values that cut the column into stretches of about ``rows`` rows, repeated where one value fills several."""
    shares = ", ".join(f"{i / STEPS}D" for i in range(1, STEPS))
    n, marks = (
        df.select(position.alias("_p"))
        .agg(F.count("_p"), F.expr(f"percentile_approx(_p, array({shares}), {ACCURACY})"))
        .first()
    )
    step = max(1, int(STEPS * rows / max(n, 1)))
    return list(marks[step - 1 :: step]) if marks else []


def _place(df: DataFrame, position: Column, marks: Sequence[float], name: str) -> DataFrame:
    """Number of the stretch a value falls in; each mark is a stretch of its own (odd numbers)."""
    cuts = sorted(set(marks))
    if not cuts:
        return df.withColumn(name, F.lit(0))
    at = df.withColumn("_p", position)
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_p", outputCol="_b", handleInvalid="keep").transform(at)
    # bucket b starts at mark b; missing values, the extra last bucket, sort first as Spark does
    bucket = F.col("_b").cast("int")
    table = F.expr("array(" + ", ".join(f"{float(c)!r}D" for c in cuts) + ")")
    is_mark = F.col("_p") == F.element_at(table, F.least(F.greatest(bucket, F.lit(1)), F.lit(len(cuts))))
    number = F.when(is_mark & (bucket > 0), 2 * bucket - 1).otherwise(2 * bucket)
    return split.withColumn(name, F.when(F.col("_p").isNull(), -1).otherwise(number)).drop("_p", "_b")


def with_chunks(df: DataFrame, order: Sequence[str], name: str = "_chunk", rows: int = CHUNK_ROWS) -> DataFrame:
    """Add a chunk number that never decreases along ``order`` and whose chunks have about ``rows`` rows.

    The cuts come from a sketch of the first order column. A single value that
    fills several stretches (many readings at one instant) is cut further along
    the second order column. The cuts are constants of the plan, so every branch
    of a query sees the same chunks.
    """
    first = position(df, order[0])
    marks = _marks(df, first, rows)
    heavy = sorted({a for a, b in zip(marks, marks[1:]) if a == b})
    out = _place(df, first, marks, name)
    if not heavy or len(order) == 1:
        return out
    tied = first.isin(heavy)
    second = position(df, order[1])
    inner = _place(out, second, _marks(df.where(tied), second, rows), "_inner")
    width = 4 * STEPS + 4
    return inner.withColumn(name, F.col(name).cast("long") * width + F.when(tied, F.col("_inner") + 1).otherwise(0)).drop("_inner")


def _carried(df: DataFrame, group: Sequence[str], chunk: str, totals: dict[str, Column]) -> DataFrame:
    """Attach to each row the sum of each total over all earlier chunks of its series."""
    keys = [*group, chunk]
    per_chunk = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    w = _before(group, [chunk])
    carried = per_chunk.select(
        *keys, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in totals]
    )
    # one row per chunk and series, written out: with its size known it is broadcast if it is
    # small, and the rows are then shuffled only once, for the window over (series, chunk)
    return join_matching_nulls(df, stage(carried, "carried"), keys, "left")


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "n", chunk: str | None = None) -> DataFrame:
    """Number the rows of each series from 1."""
    if chunk is None:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    w = Window.partitionBy(*group, chunk).orderBy(*order)
    with_offset = _carried(df, group, chunk, {"_offset": F.count(F.lit(1))})
    return with_offset.withColumn(name, F.row_number().over(w) + F.col("_offset")).drop("_offset")


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, chunk: str | None = None) -> DataFrame:
    """Cumulative sum; from the first missing value of a series on it is missing."""
    v = F.col(value)
    missing = F.when(v.isNull(), 1).otherwise(0)
    if chunk is None:
        w = running(group, order)
        return df.withColumn(name, F.when(F.sum(missing).over(w) == 0, F.sum(v).over(w)))
    w = running([*group, chunk], order)
    out = _carried(df, group, chunk, {"_sum": F.sum(v), "_gaps": F.sum(missing)})
    total = F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col("_sum")
    gaps = F.sum(missing).over(w) + F.col("_gaps")
    return out.withColumn(name, F.when(gaps == 0, total)).drop("_sum", "_gaps")


def on_pieces(df: DataFrame, group: Sequence[str], order: Sequence[str], reach: int, work: Piece, chunk: str | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Apply work(df, partition, order), which looks at most reach rows to either side.

    Blocks follow the exact row number, so they hold the same number of rows
    however the values are spread, and each row is copied at most once more.
    """
    if chunk is None:
        return work(df, group, order)
    if block_rows < reach:
        raise ValueError("a block must hold at least as many rows as the reach")
    numbered = row_numbers(df, group, order, "_row", chunk)
    block = F.floor((F.col("_row") - 1) / block_rows)
    place = (F.col("_row") - 1) % block_rows
    homes = F.filter(
        F.array(
            block,
            F.when(place >= block_rows - reach, block + 1),
            F.when((place < reach) & (block > 0), block - 1),
        ),
        lambda b: b.isNotNull(),
    )
    copies = numbered.withColumn("_home", block).withColumn("_block", F.explode(homes))
    done = work(copies, [*group, "_block"], ["_row"])
    return done.where(F.col("_block") == F.col("_home")).drop("_row", "_home", "_block")


def rolling(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, width: int, name: str, how: str = "sum", chunk: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum or mean of the last ``width`` rows; missing until full or if one of them is missing."""
    agg = {"sum": F.sum, "mean": F.avg}[how]

    def work(part: DataFrame, keys: Sequence[str], sort: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(1 - width, 0)
        return part.withColumn(name, F.when(F.count(value).over(w) == width, agg(value).over(w)))

    return on_pieces(df, group, order, width - 1, work, chunk, block_rows)


def rolling_mode(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, width: int = 3, chunk: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Most frequent value of a centered window, the first seen winning a tie; missing at the edges."""
    if width % 2 == 0:
        raise ValueError("a centered window has an odd width")
    half = width // 2

    def work(part: DataFrame, keys: Sequence[str], sort: Sequence[str]) -> DataFrame:
        ordered = Window.partitionBy(*keys).orderBy(*sort)
        if width == 3:
            here, prev, after = F.col(value), F.lag(value).over(ordered), F.lead(value).over(ordered)
            full = F.lag(F.lit(1)).over(ordered).isNotNull() & F.lead(F.lit(1)).over(ordered).isNotNull()
            mode = F.when(here.eqNullSafe(after), here).otherwise(prev)
            return part.withColumn(name, F.when(full, mode))
        w = ordered.rowsBetween(-half, half)
        # wrapped in structs so that missing values take part like any other
        seen = F.collect_list(F.struct(F.col(value).alias("v"))).over(w)
        out = part.withColumn("_seen", seen)
        hits = lambda x: F.size(F.filter(F.col("_seen"), lambda y: y["v"].eqNullSafe(x["v"])))
        best = F.array_max(F.transform(F.col("_seen"), hits))
        mode = F.filter(F.col("_seen"), lambda x: hits(x) == best)[0]["v"]
        return out.withColumn(name, F.when(F.size("_seen") == width, mode)).drop("_seen")

    return on_pieces(df, group, order, half, work, chunk, block_rows)


def percent_of_total(df: DataFrame, group: Sequence[str], cumulative: str, value: str, name: str, counted: Column | None = None) -> DataFrame:
    """Cumulative value as a percentage of the group's total.

    ``counted`` marks the rows that make up the total (all rows if not given); a
    missing value among them makes the total missing. The total is a window
    aggregate, so detail is not joined back to itself.
    """
    w = Window.partitionBy(*group)
    use = F.lit(True) if counted is None else counted
    v = F.when(use, F.col(value))
    rows = F.count(F.when(use, 1)).over(w)
    total = F.when((F.count(v).over(w) == rows), F.sum(v).over(w))
    return df.withColumn(name, F.col(cumulative) / total * 100)
