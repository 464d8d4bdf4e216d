"""Self-organizing maps: the batch rule, with the data side entirely on the executors.

A codebook has one row per run and node; its size is set by the lattice in the
sweep grid, not by the data. Each epoch broadcasts it, finds the best-matching
node of every row and adds up rows per node inside each task, so what is
shuffled and returned to the driver is one row per node. All runs of a sweep
share each pass over the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshet.operators.columns import complete_cases
from freshet.session import shared_dir

SLICE_NODES = 4096  # nodes per broadcast when assigning rows; larger codebooks take several
AT_ONCE = 4_000_000  # row-node distances that a task holds while training
CODEBOOK = "run int, node int, gx double, gy double, w array<double>"


def lattice(rows: int, cols: int, topology: str = "hexagonal") -> np.ndarray:
    """Node positions, columns running fastest; every other row of a hexagonal grid is shifted by half."""
    y, x = np.meshgrid(np.arange(1, rows + 1.0), np.arange(1, cols + 1.0), indexing="ij")
    x, y = x.ravel(), y.ravel()
    if topology == "hexagonal":
        x, y = x + 0.5 * (y % 2), y * math.sqrt(3) / 2
    return np.column_stack([x, y])


def start_radius(rows: int, cols: int, topology: str = "hexagonal") -> float:
    """The 2/3 quantile of the grid distances of all pairs of nodes, from the counts of their offsets."""
    down, across = np.meshgrid(np.arange(rows), np.arange(-(cols - 1), cols), indexing="ij")
    pairs = ((rows - down) * (cols - np.abs(across))).astype(float)
    if topology == "rectangular":
        sides = [(np.maximum(down, np.abs(across)).astype(float), pairs)]
    else:
        odd = down % 2 == 1
        # an odd number of rows apart, half of the pairs are shifted to either side (one more where rows are odd)
        first = np.where(odd, ((rows - down + 1) // 2) * (cols - np.abs(across)), pairs)
        height = down * (math.sqrt(3) / 2)
        sides = [(np.hypot(across - 0.5 * odd, height), first), (np.hypot(across + 0.5, height), np.where(odd, pairs - first, 0))]
    distance, count = (np.concatenate([s[i].ravel() for s in sides]) for i in (0, 1))
    # pairs in one row are met from both sides
    count = np.where(np.concatenate([(down == 0).ravel()] * len(sides)), count / 2, count)
    use = (count > 0) & (distance > 0)
    distance, count = distance[use], count[use]
    if not len(distance):
        return 0.0
    order = np.argsort(distance)
    distance, upto = distance[order], np.cumsum(count[order])
    at = (upto[-1] - 1) * 2 / 3
    low = math.floor(at + 1e-9)
    value = lambda rank: distance[min(np.searchsorted(upto, rank + 0.5), len(distance) - 1)]
    return float(value(low) + (at - low) * (value(min(low + 1, upto[-1] - 1)) - value(low)))


def neighbourhood_sums(table: np.ndarray, points: np.ndarray, radius: float, topology: str = "hexagonal") -> np.ndarray:
    """For every node the sum of ``table`` over the nodes within the radius.

    Nodes of one lattice row within reach are a run of columns, so sums are differences of
    prefix sums along the row; no table of node pairs is made.
    """
    out = np.zeros_like(table)
    heights, row_of = np.unique(np.round(points[:, 1], 9), return_inverse=True)
    rows = []
    for i in range(len(heights)):
        nodes = np.flatnonzero(row_of == i)
        nodes = nodes[np.argsort(points[nodes, 0], kind="stable")]
        rows.append((nodes, points[nodes, 0], np.vstack([np.zeros(table.shape[1]), np.cumsum(table[nodes], axis=0)])))
    reach = radius + 1e-9
    for i, (nodes, x, _) in enumerate(rows):
        for j in range(np.searchsorted(heights, heights[i] - reach), np.searchsorted(heights, heights[i] + reach, "right")):
            gap = heights[i] - heights[j]
            half = reach if topology == "rectangular" else math.sqrt(max(reach**2 - gap**2, 0.0))
            _, other, upto = rows[j]
            out[nodes] += upto[np.searchsorted(other, x + half, "right")] - upto[np.searchsorted(other, x - half)]
    return out


def lattice_columns(node: Column, cols: int) -> tuple[Column, Column]:
    """Hexagonal position of a node numbered from 1, as column expressions."""
    across = (node - 1) % cols + 1
    down = F.floor((node - 1) / cols) + 1
    return across + (down % 2) * 0.5, down * (math.sqrt(3) / 2)


def _vectors(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def _pool(data: DataFrame, order: Sequence[Column], runs: Sequence[Mapping[str, Any]], times: int) -> np.ndarray:
    """The first rows of a table with _x, ``times`` as many as the largest lattice has nodes."""
    most = max(int(r["rows"]) * int(r["cols"]) for r in runs)
    pool = np.array([r[0] for r in data.orderBy(*order).limit(times * most).select("_x").collect()], dtype=float)
    if most > len(pool):
        raise ValueError("a lattice cannot have more nodes than there are observations")
    return pool


def _starting_codes(data: DataFrame, runs: Sequence[Mapping[str, Any]], seed: int) -> dict[int, np.ndarray]:
    """Distinct rows per run, drawn from a pool of rows with the smallest seeded hash of their key."""
    pool = _pool(data, [F.xxhash64(F.lit(seed), F.col("_key")), F.col("_key")], runs, 2)
    codes = {}
    for r in runs:
        rng = np.random.default_rng(seed * 100_003 + int(r["run"]))
        codes[int(r["run"])] = pool[rng.permutation(len(pool))[: int(r["rows"]) * int(r["cols"])]].copy()
    return codes


def _first_rows(df: DataFrame, cols: Sequence[str], runs: Sequence[Mapping[str, Any]], start: Sequence[Column]) -> dict[int, np.ndarray]:
    pool = _pool(df.withColumn("_x", _vectors(cols)), start, runs, 1)
    return {int(r["run"]): pool[: int(r["rows"]) * int(r["cols"])].copy() for r in runs}


def epoch_sums(data: DataFrame, width: int, codes: Mapping[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per run a (nodes, 2 + features) table: rows, summed distance and summed features of each node.

    Every task adds up its rows per node; its totals are combined by one shuffle
    on (run, slot), where a slot is one cell of that table.
    """
    shared = data.sparkSession.sparkContext.broadcast(dict(codes))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = shared.value
        totals = {run: np.zeros((len(w), width + 2)) for run, w in current.items()}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for run, w in current.items():
                square, step = (w**2).sum(axis=1)[None, :], max(1, AT_ONCE // len(w))
                parts = [(square - 2.0 * (x[at : at + step] @ w.T)).argmin(axis=1) for at in range(0, len(x), step)]
                node = np.concatenate(parts) if parts else np.zeros(0, dtype=int)
                gap = ((x - w[node]) ** 2).sum(axis=1)
                t = totals[run]
                for j, v in enumerate([np.ones(len(x)), gap, *x.T]):
                    t[:, j] += np.bincount(node, weights=v, minlength=len(w))
        for run, t in totals.items():
            slots = np.flatnonzero(np.repeat(t[:, 0] > 0, width + 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slots), run, dtype="int32")), pa.array(slots.astype("int64")), pa.array(t.ravel()[slots])],
                names=["run", "slot", "v"],
            )

    partial = data.select("_x").mapInArrow(add_up, "run int, slot long, v double")
    summed = partial.groupBy("run", "slot").agg(F.sum("v").alias("v")).toPandas()
    shared.unpersist()
    out = {}
    for run, part in summed.groupby("run"):
        table = np.zeros(len(codes[run]) * (width + 2))
        table[part["slot"].to_numpy()] = part["v"].to_numpy()
        out[int(run)] = table.reshape(-1, width + 2)
    return out


def _smooth(w: np.ndarray, table: np.ndarray, points: np.ndarray, radius: float, topology: str, rate: float | None = None, repeats: float = 1.0) -> np.ndarray:
    """Every node moves towards the mean of the rows won inside its neighbourhood; without any it stays.

    Without a rate it moves all the way. With one it moves as far as ``repeats`` single steps of that rate for each
    of those rows would take it: each leaves 1 - rate of the distance.
    """
    summed = neighbourhood_sums(np.delete(table, 1, axis=1), points, radius, topology)
    weight, moved = np.round(summed[:, 0])[:, None], summed[:, 1:]
    mean = moved / np.maximum(weight, 1e-300)
    if rate is None:
        return np.where(weight > 0, mean, w)
    stays = np.exp(np.log1p(-min(rate, 1 - 1e-12)) * repeats * weight)
    return np.where(weight > 0, stays * w + (1 - stays) * mean, w)


def _rate(run: Mapping[str, Any], done: float, share: float) -> tuple[float | None, float]:
    """(rate, presentations of each row) of a step; no rate for a run without any."""
    coarse = run.get("alpha_coarse")
    if coarse is None:
        return None, 1.0
    fine = coarse if run.get("alpha_fine") is None else run["alpha_fine"]
    if not 0 < fine <= coarse <= 1:
        raise ValueError(f"run {run['run']}: rates must fall from at most one and stay above zero")
    return coarse + (fine - coarse) * done, (run.get("iterations") or 1) * share


def train_epoch(df: DataFrame, cols: Sequence[str], codes: DataFrame, radius: float) -> DataFrame:
    """One batch update of a codebook (run, node, gx, gy, w) on a Euclidean grid."""
    book: dict[int, list] = {}
    for r in codes.orderBy("run", "node").collect():
        book.setdefault(r["run"], []).append(r)
    start = {run: np.array([r["w"] for r in nodes], dtype=float) for run, nodes in book.items()}
    sums = epoch_sums(complete_cases(df, cols).select(_vectors(cols).alias("_x")), len(cols), start)
    rows = []
    for run, nodes in book.items():
        points = np.array([[r["gx"], r["gy"]] for r in nodes])
        new = _smooth(start[run], sums[run], points, radius, "hexagonal")
        rows += [(run, r["node"], r["gx"], r["gy"], [float(v) for v in w]) for r, w in zip(nodes, new)]
    return df.sparkSession.createDataFrame(rows, CODEBOOK)


def fit(df: DataFrame, key: str, cols: Sequence[str], runs: Sequence[Mapping[str, Any]], epochs: int = 30, tolerance: float = 1e-4, seed: int = 1, batch_rows: int | None = None, start: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """Train one map per run; returns (codebook, progress).

    A run with ``alpha_coarse`` follows the rates of the sequential rule in steps of whole batches: the rate falls
    linearly to ``alpha_fine``, and a step stands for as many presentations of its rows as make up ``iterations``
    passes in all. With ``batch_rows`` the rows are dealt by a hash of their key into batches of about that many;
    a step then reads one batch only, written apart, and ``epochs`` counts steps. Small batches make noisy last steps:
    they should hold many rows per node. Every run starts from distinct rows drawn with the seed, or from the first
    rows in the order of ``start``.

    ``runs`` are grid rows with run, rows, cols and optionally topology. The
    neighbourhood is a bubble whose radius falls linearly from the 2/3 quantile of
    the grid distances to 0. Rows with a missing feature are left out. Codebook: run, node, gx, gy, w. Progress: run, epoch,
    the mean distance to the codes of that epoch and the mean change they then make.
    """
    spark = df.sparkSession
    complete = complete_cases(df, cols)
    data = complete.select(F.col(key).alias("_key"), _vectors(cols).alias("_x"))
    batches = 1
    if batch_rows:
        batches = max(1, -(-data.count() // batch_rows))
    if batches > 1:
        path = shared_dir(spark, "batches")
        dealt = data.withColumn("_batch", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.lit(batches)).cast("int"))
        dealt.write.partitionBy("_batch").parquet(path)
        data = spark.read.schema(dealt.schema).parquet(path)
    else:
        data = data.persist()
    try:
        codes = _first_rows(complete, cols, runs, start) if start else _starting_codes(data, runs, seed)
        points = {int(r["run"]): lattice(int(r["rows"]), int(r["cols"]), r.get("topology", "hexagonal")) for r in runs}
        kind = {int(r["run"]): r.get("topology", "hexagonal") for r in runs}
        start = {int(r["run"]): start_radius(int(r["rows"]), int(r["cols"]), kind[int(r["run"])]) for r in runs}
        rates = {int(r["run"]): r for r in runs}
        active, progress = set(codes), []
        for epoch in range(1, epochs + 1):
            part = data.where(F.col("_batch") == (epoch - 1) % batches) if batches > 1 else data
            done = (epoch - 1) / max(epochs - 1, 1)
            for run, table in epoch_sums(part, len(cols), {r: codes[r] for r in active}).items():
                w, n = codes[run], table[:, 0]
                radius = start[run] * (1 - done)
                new = _smooth(w, table, points[run], radius, kind[run], *_rate(rates[run], done, batches / epochs))
                change = float(np.abs(new - w).mean())
                progress.append((int(run), epoch, float(table[:, 1].sum() / n.sum()), change))
                codes[run] = new
                # the radius must have shrunk to single nodes before a run may stop early
                if change < tolerance and radius < 1:
                    active.discard(run)
            if not active:
                break
    finally:
        if batches == 1:
            data.unpersist()
    rows = [
        (run, i + 1, float(points[run][i, 0]), float(points[run][i, 1]), [float(v) for v in w[i]])
        for run, w in codes.items()
        for i in range(len(w))
    ]
    book = spark.createDataFrame(rows, CODEBOOK)
    return book, spark.createDataFrame(progress, "run int, epoch int, mean_distance double, mean_change double")


def assign(df: DataFrame, cols: Sequence[str], codes: DataFrame) -> DataFrame:
    """Best-matching node and squared distance of every complete row under every run; ties go to the lowest node.

    Rows with a missing feature have no place on the map and are left out.

    The codebook (run, node, w) is broadcast in slices of SLICE_NODES nodes. Each
    slice is a narrow pass that keeps the best node so far, so neither the rows
    nor row-node pairs are shuffled, whatever the size of the codebook.
    """
    sc = df.sparkSession.sparkContext
    last = codes.agg(F.max("node")).first()[0] or 0
    runs = [r[0] for r in codes.select("run").distinct().orderBy("run").collect()]
    out = complete_cases(df, cols).withColumn("_x", _vectors(cols)).withColumn("run", F.explode(F.array(*[F.lit(r).cast("int") for r in runs])))
    out = out.withColumn("node", F.lit(None).cast("int")).withColumn("dist", F.lit(None).cast("double"))
    for low in range(1, last + 1, SLICE_NODES):
        part = codes.where(F.col("node").between(low, low + SLICE_NODES - 1)).orderBy("run", "node").collect()
        book: dict[int, tuple[list[int], list[list[float]]]] = {}
        for r in part:
            ids, ws = book.setdefault(r["run"], ([], []))
            ids.append(r["node"])
            ws.append(list(r["w"]))
        shared = sc.broadcast({run: (np.array(i), np.array(w)) for run, (i, w) in book.items()})

        @F.pandas_udf("node int, dist double")
        def nearest(x: pd.Series, run: pd.Series) -> pd.DataFrame:
            mine = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            node = np.zeros(len(x), dtype="int32")
            dist = np.full(len(x), np.inf)
            for r, (ids, w) in shared.value.items():
                at = np.flatnonzero(run.to_numpy() == r)
                if len(at):
                    # differences, not the expanded square: equal distances must compare equal
                    gap = np.zeros((len(at), len(ids)))
                    for j in range(w.shape[1]):
                        gap += (mine[at, j][:, None] - w[:, j][None, :]) ** 2
                    best = gap.argmin(axis=1)
                    node[at], dist[at] = ids[best], gap[np.arange(len(at)), best]
            return pd.DataFrame({"node": node, "dist": dist})

        found = out.withColumn("_f", nearest("_x", "run"))
        better = F.col("dist").isNull() | (F.col("_f.dist") < F.col("dist"))
        out = (
            found.withColumn("node", F.when(better, F.col("_f.node")).otherwise(F.col("node")))
            .withColumn("dist", F.when(better, F.col("_f.dist")).otherwise(F.col("dist")))
            .drop("_f")
        )
    return out.drop("_x")


def node_clusters(codes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cut a complete-linkage tree of each run's codes at its number of clusters.

    ``clusters`` has run and k. A group is one run's codebook, whose size is the
    lattice, so runs are spread over the executors and no group grows with data.
    Clusters are numbered in order of their first node.
    """

    def cut(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("node")
        w = np.array(book["w"].tolist(), dtype=float)
        k = int(book["k"].iloc[0])
        d = ((w[:, None, :] - w[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        member = np.arange(len(w))
        for _ in range(max(len(w) - k, 0)):
            i, j = sorted(divmod(int(d.argmin()), len(w)))
            d[i] = d[:, i] = np.maximum(d[i], d[j])
            d[i, i] = np.inf
            d[j] = d[:, j] = np.inf
            member[member == j] = i
        label = {c: n + 1 for n, c in enumerate(dict.fromkeys(member))}
        return pd.DataFrame({"run": book["run"], "node": book["node"], "cluster": [label[c] for c in member]})

    joined = codes.select("run", "node", "w").join(F.broadcast(clusters.select("run", "k")), "run")
    return joined.groupBy("run").applyInPandas(cut, "run int, node int, cluster int")


def quantization_error(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("run").agg(F.avg("dist").alias("qe"))


def node_quality(assigned: DataFrame) -> DataFrame:
    """Hits and mean distance per node."""
    return assigned.groupBy("run", "node").agg(F.count(F.lit(1)).alias("hits"), F.avg("dist").alias("mean_dist"))


def u_matrix(codes: DataFrame) -> DataFrame:
    """Mean code distance of each node to the nodes next to it on the grid.

    Neighbours are at grid distance one, so candidates are found by an equi-join
    on unit cells of the grid instead of comparing all nodes.
    """
    cell = lambda c: F.floor(F.col(c))
    here = codes.select("run", "node", "gx", "gy", "w", cell("gx").alias("cx"), cell("gy").alias("cy"))
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    there = (
        here.withColumn("dx", F.explode(around))
        .withColumn("dy", F.explode(around))
        .select(
            "run",
            (F.col("cx") + F.col("dx")).alias("cx"),
            (F.col("cy") + F.col("dy")).alias("cy"),
            F.col("node").alias("other"),
            F.col("gx").alias("ox"),
            F.col("gy").alias("oy"),
            F.col("w").alias("ow"),
        )
    )
    near = F.pow(F.col("gx") - F.col("ox"), F.lit(2)) + F.pow(F.col("gy") - F.col("oy"), F.lit(2)) <= 1.0 + 1e-6
    gap = F.sqrt(F.aggregate(F.zip_with("w", "ow", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    pairs = here.join(there, ["run", "cx", "cy"]).where((F.col("node") != F.col("other")) & near)
    return pairs.groupBy("run", "node").agg(F.avg(gap).alias("mean_neighbour_dist"), F.count(F.lit(1)).alias("neighbours"))


def component_planes(codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per run, node and feature."""
    names = F.array(*[F.lit(c) for c in cols])
    return codes.select("run", "node", F.explode(F.arrays_zip(names.alias("var"), F.col("w").alias("value"))).alias("z")).select(
        "run", "node", F.col("z.var").alias("var"), F.col("z.value").alias("value")
    )


def cluster_profile(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    """Cluster mean minus overall mean per feature, and rows per cluster."""
    overall = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    means = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    return means.withColumns({c: F.col(c) - overall[c] for c in cols})
