"""Choosing the number of lattice nodes, the lattice shape and the number of clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from freshet.operators.moments import principal_components
from freshet.operators.som import epoch_sums


def node_count(df: DataFrame) -> DataFrame:
    """Observations and the rule-of-thumb number of nodes, 5 * sqrt(n)."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), F.round(F.sqrt(n) * 5).cast("long").alias("nodes"))


def side_ratio(df: DataFrame, cols: Sequence[str]) -> float:
    """Ratio of the two largest eigenvalues of the correlation matrix, one decimal."""
    values, _ = principal_components(df, cols)
    return round(float(values[0] / values[1]), 1)


def lattice_size(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return node_count(df).withColumn("col_row_ratio", F.lit(side_ratio(df, cols)))


def lattices(nodes: int, ratio: float, most: int, count: int = 5) -> list[tuple[int, int]]:
    """(rows, cols) of the lattices nearest to a number of nodes and a ratio of columns to rows, at most ``most`` nodes.

    Nearness is the sum of the two deviations in logarithms; of equally near ones that with fewer rows, then columns,
    comes first.
    """
    far = lambda r, c: round(abs(math.log(r * c / nodes)) + abs(math.log(c / r / ratio)), 9)
    found = []
    for r in range(1, 2 * math.isqrt(max(nodes, 1)) + count + 1):
        # for a number of rows the deviation falls up to the nearer of the two aims and rises from the other one on
        aims = sorted((nodes / r, r * ratio))
        for c in range(max(1, math.floor(aims[0]) - count), math.ceil(aims[1]) + count + 1):
            if r * c <= most:
                found.append((far(r, c), r, c))
    return [(r, c) for _, r, c in sorted(found)[:count]]


def grid_from_data(df: DataFrame, cols: Sequence[str], count: int = 5) -> DataFrame:
    """(place, rows, cols, nodes, col_row_ratio) of the ``count`` lattices that suit the rows best, the best first.

    The aims are 5 * sqrt(n) nodes and the ratio of the two largest eigenvalues; no lattice has more nodes
    than there are rows.
    """
    size = lattice_size(df, cols).first()
    found = lattices(size["nodes"], size["col_row_ratio"], size["n"], count)
    rows = [(i, r, c, r * c, round(c / r, 1)) for i, (r, c) in enumerate(found, 1)]
    return df.sparkSession.createDataFrame(rows, "place int, rows int, cols int, nodes int, col_row_ratio double")


def kmeans_elbow(df: DataFrame, cols: Sequence[str], most: int = 8, start: Sequence[Column] = (), steps: int = 30) -> DataFrame:
    """(k, wss): within-cluster sum of squares for 1 to ``most`` clusters, all found in shared passes.

    Every pass over the rows makes one Lloyd step for each k that still moves, with all centres in one broadcast, so
    there are as many passes as the slowest k needs, ``steps`` at most, and a last one to measure. k starts from the
    first k rows in the order of ``start``, by default of a hash of the row. A centre without rows stays.
    """
    order = list(start) or [F.xxhash64(*cols), *map(F.col, cols)]
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    data = df.dropna(subset=list(cols)).select(*[c.alias(f"_{i}") for i, c in enumerate(order)], vector.alias("_x")).persist()
    try:
        first = np.array([r[0] for r in data.orderBy(*[f"_{i}" for i in range(len(order))]).limit(most).select("_x").collect()], dtype=float)
        centres = {k: first[:k].copy() for k in range(1, min(most, len(first)) + 1)}
        moving, costs = set(centres), {}
        for step in range(steps + 1):
            for k, table in epoch_sums(data, len(cols), {k: centres[k] for k in moving}).items():
                costs[k] = float(table[:, 1].sum())
                n = table[:, :1]
                new = np.where(n > 0, table[:, 2:] / np.maximum(n, 1), centres[k])
                if step == steps or np.allclose(new, centres[k], rtol=0, atol=1e-13):
                    moving.discard(k)
                centres[k] = new
            if not moving:
                break
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(sorted(costs.items()), "k int, wss double")
