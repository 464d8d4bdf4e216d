"""Second moments of all pairs of columns in one pass: correlations of wide tables and principal components.

Every task adds up matrix products per Arrow batch. Values are moved by a row of the table first, so that large
means do not cancel. A pair of columns counts the rows in which both are known, as null or NaN is missing. What is
shuffled is one row per task and column, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.operators.columns import complete_cases

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
MOST_COLUMNS = 4096  # of a matrix that comes to the driver


def _products(x: np.ndarray) -> np.ndarray:
    """(6, p, p): the sums of SUMS over the rows in which both columns are known."""
    known = ~np.isnan(x)
    z, m = np.where(known, x, 0.0), known.astype(float)
    return np.stack([m.T @ m, z.T @ m, m.T @ z, (z * z).T @ m, m.T @ (z * z), z.T @ z])


def _middle(df: DataFrame, cols: Sequence[str], values: DataFrame) -> np.ndarray:
    """A value of about the right size for every column: the mean of the first rows, or else any known value."""
    seen = np.array([r[0] for r in values.head(100)], dtype=float).reshape(-1, len(cols))
    known = ~np.isnan(seen)
    middle = np.where(known, seen, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    for low in range(0, len(bare := np.flatnonzero(~known.any(axis=0))), 200):
        part = bare[low : low + 200]
        some = df.agg(*[F.max(F.nullif(F.col(f"`{cols[i]}`").cast("double"), F.lit(float("nan")))).alias(f"c{i}") for i in part]).first()
        middle[part] = [0.0 if v is None else v for v in some]
    return middle


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, sums): for column i the six sums with every column j >= i, one after the other, as one array."""
    p = len(cols)
    values = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))
    shift = _middle(df, cols, values)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), p, p))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            total += _products(x - shift)
        for i in range(p):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[:, i, i:].ravel()], pa.list_(pa.float64()))], names=["i", "sums"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held], pa.list_(pa.float64()))], names=["i", "sums"])
        now, held = None, None
        for batch in batches:
            for i, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums = sums.values.to_numpy()
                if i == now:
                    held = held + sums
                    continue
                if now is not None:
                    yield out()
                now, held = i, sums
        if now is not None:
            yield out()

    schema = "i int, sums array<double>"
    return values.mapInArrow(add_up, schema).repartition("i").sortWithinPartitions("i").mapInArrow(combine, schema)


def _correlation(sums: np.ndarray) -> np.ndarray:
    """r from (6, ...) sums; NaN for fewer than two rows or a constant column."""
    n, sx, sy, sxx, syy, sxy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
        return np.where((n > 1) & (vx > 1e-14 * sxx) & (vy > 1e-14 * syy), np.clip(r, -1.0, 1.0), np.nan)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var_a, var_b, r, n) of every pair of columns, each pair once in the order of ``cols``; none for an empty table."""
    names, p = list(cols), len(cols)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums = sums.values.to_numpy().reshape(len(SUMS), p - i)[:, 1:]
                r = _correlation(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i]] * (p - i - 1), pa.string()), pa.array(names[i + 1 :], pa.string()), pa.array(r, pa.float64(), from_pandas=True), pa.array(sums[0].astype("int64"))],
                    names=["var_a", "var_b", "r", "n"],
                )

    return pair_sums(df, cols).mapInArrow(spread, "var_a string, var_b string, r double, n long")


def principal_components(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, loadings) of the correlation matrix of the complete rows, the largest first.

    Loadings are columns of length one; the sign is such that the largest entry is positive. The matrix comes
    to the driver, so the number of columns is bounded.
    """
    p = len(cols)
    if p > MOST_COLUMNS:
        raise ValueError(f"at most {MOST_COLUMNS} columns")
    matrix = np.eye(p)
    for i, sums in pair_sums(complete_cases(df, cols), cols).collect():
        r = _correlation(np.array(sums).reshape(len(SUMS), p - i))
        matrix[i, i:] = matrix[i:, i] = r
    if np.isnan(matrix).any():
        raise ValueError("a column is constant, or there are fewer than two complete rows")
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(p)])
    return values, vectors * signs


def first_loadings(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Loadings of the first principal component by column: the weights of a map weighted by PCA."""
    return dict(zip(cols, map(float, principal_components(df, cols)[1][:, 0])))
