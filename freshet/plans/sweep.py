"""A clustering sweep: every row of a grid trained, scored and cut in shared passes over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from freshet.operators import permanova, som
from freshet.operators.moments import first_loadings
from freshet.operators.ranking import upper_half
from freshet.operators.reshape import bind_rows
from freshet.operators.scaling import scale_by
from freshet.sources.stages import stage


GRID_SCHEMA = (
    "myRun int, myDataSet string, nodes int, myTopo string, rows int, cols int, normMeth string, wghtMeth string, "
    "niter int, crsAlpha double, finAlpha double, nClusters int, colRowRatio double"
)
#: Fields of a run that the score table carries.
CARRIED = {"dataset": "string", "nodes": "int", "scaling": "string", "weighting": "string", "iterations": "int", "alpha_coarse": "double", "alpha_fine": "double", "col_row_ratio": "double"}


def read_grid(params: DataFrame) -> list[dict[str, Any]]:
    """Rows of a parameter file, one entry per run, with every field.

    Iterations and learning rates are those of the sequential rule; training follows them in steps of
    whole batches (``som.fit``). A number of nodes that is not that of the lattice is an error.
    """
    out = []
    for r in params.orderBy("myRun").collect():
        if r["nodes"] is not None and r["nodes"] != r["rows"] * r["cols"]:
            raise ValueError(f"run {r['myRun']} has {r['nodes']} nodes on a lattice of {r['rows']} x {r['cols']}")
        out.append(
            {
                "run": int(r["myRun"]),
                "topology": r["myTopo"],
                "rows": int(r["rows"]),
                "cols": int(r["cols"]),
                "scaling": r["normMeth"],
                "weighting": r["wghtMeth"],
                "k": int(r["nClusters"]),
                "dataset": r["myDataSet"],
                "nodes": r["nodes"],
                "iterations": r["niter"],
                "alpha_coarse": r["crsAlpha"],
                "alpha_fine": r["finAlpha"],
                "col_row_ratio": r["colRowRatio"],
            }
        )
    return out


def best_runs(scores: DataFrame) -> DataFrame:
    """Among the upper half by pseudo-F, the run of least error for each number of clusters."""
    order = F.struct("qe", (-F.col("npf")).alias("npf"), "run")
    best = upper_half(scores, "npf", "run").groupBy("clusters").agg(F.min_by(F.struct("run", "npf", "qe"), order).alias("b"))
    return best.select("clusters", "b.run", "b.npf", "b.qe")


def sweep(features: DataFrame, key: str, cols: Sequence[str], grid: Sequence[Mapping[str, Any]], weights: Mapping[str, float] | None = None, epochs: int = 30, permutations: int = 99, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(scores, assignments) of complete feature rows under every run of the grid.

    Scores: run, rows, cols, topology, clusters, the carried fields, qe, npf, p_value. Assignments are
    long, (run, key, node, dist, cluster); there is never a column per observation.
    Runs with the same scaling and weighting are trained together. Runs whose weighting is ``PCA`` take
    ``weights``, by default the loadings of the features' first principal component.
    """
    together: dict[tuple[str, bool], list[Mapping[str, Any]]] = {}
    for run in grid:
        weighted = run.get("weighting") == "PCA"
        if weighted and weights is None:
            weights = first_loadings(features, cols)
        together.setdefault((run.get("scaling", "minmax"), weighted), []).append(run)
    results = []
    for (method, weighted), runs in together.items():
        scaled = scale_by(features.select(key, *cols), method, cols, weights if weighted else None)
        results.append(_train_and_score(stage(scaled, "scaled"), key, cols, runs, epochs, permutations, seed))
    return bind_rows(*[r[0] for r in results]), bind_rows(*[r[1] for r in results])


def _train_and_score(data: DataFrame, key: str, cols: Sequence[str], grid: Sequence[Mapping[str, Any]], epochs: int, permutations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    spark = data.sparkSession
    codes, _ = som.fit(data, key, cols, grid, epochs=epochs, seed=seed)
    k = spark.createDataFrame([(int(g["run"]), int(g["k"])) for g in grid], "run int, k int")
    nodes = som.node_clusters(codes, k)
    found = som.assign(data.select(key, *cols), cols, codes)
    # read by three scores; the node table's size is known once it is written
    labelled = stage(found.join(stage(nodes, "nodes"), ["run", "node"]), "assignments")
    error = som.quantization_error(labelled)
    scored = permanova.permanova(labelled, key, "cluster", cols, by=["run"], permutations=permutations, seed=seed)
    setup = spark.createDataFrame(
        [(int(g["run"]), int(g["rows"]), int(g["cols"]), g.get("topology", "hexagonal"), int(g["k"]), *[g.get(c) for c in CARRIED]) for g in grid],
        "run int, rows int, cols int, topology string, clusters int, " + ", ".join(f"{c} {t}" for c, t in CARRIED.items()),
    )
    scores = setup.join(error, "run").join(scored.select("run", F.col("f").alias("npf"), "p_value"), "run", "left")
    return scores, labelled.select("run", key, "node", "dist", "cluster")
