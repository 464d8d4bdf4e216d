"""Embedding near-duplicates by a forest of random-projection trees with spill.

Every tree has a random direction per level. A node is split at the median projection of the
fitting sample's vectors in it; where the sample has too few, at the projection of the mean of the
last node that had enough. Vectors within ``spill`` of the cut go to both sides. All vectors are
indexed; within the leaves all are compared in double precision, in blocks. A pair that shares
several leaves counts in the first of them only, by comparing the leaves of its two vectors.

Equal vectors are one class first. Leaves beyond ``block`` vectors are cut into pairs of blocks
that are tasks of their own, so a leaf of any size is compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from freshet.llm.common import discard, keep
from freshet.llm.components import components

TREES = 8
LEAF = 512
SPILL = 0.015
SAMPLE = 20_000
ENOUGH = 16
BLOCK = 2048


class Forest:
    """Directions and cuts; its size is bounded by the sample, the trees and the depth."""

    def __init__(self, sample: np.ndarray, depth: int, width: int, trees: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        d = rng.standard_normal((trees, max(depth, 1), width))
        self.directions = d / np.linalg.norm(d, axis=2, keepdims=True)
        self.cuts: list[dict[tuple[int, int], float]] = []
        self.means: list[dict[tuple[int, int], np.ndarray]] = []
        for t in range(trees):
            cuts, means, nodes = {}, {}, {0: np.arange(len(sample))}
            for level in range(depth):
                following = {}
                for node, rows in nodes.items():
                    if len(rows) < ENOUGH:
                        means[level, node] = sample[rows].mean(0) if len(rows) else np.zeros(width)
                        continue
                    at = sample[rows] @ self.directions[t, level]
                    cut = float(np.median(at))
                    cuts[level, node] = cut
                    following[2 * node], following[2 * node + 1] = rows[at <= cut], rows[at > cut]
                nodes = following
            self.cuts.append(cuts)
            self.means.append(means)

    def _cut(self, tree: int, level: int, node: int) -> float:
        if (level, node) in self.cuts[tree]:
            return self.cuts[tree][level, node]
        up = node
        for l in range(level, -1, -1):
            if (l, up) in self.means[tree]:
                return float(self.means[tree][l, up] @ self.directions[tree, level])
            up >>= 1
        return 0.0

    def leaves(self, vectors: np.ndarray, spill: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per tree the pairs (row, leaf)."""
        out = []
        for t in range(self.trees):
            rows, nodes = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
            for level in range(self.depth):
                at = np.einsum("ij,j->i", vectors, self.directions[t, level])[rows]
                present, which = np.unique(nodes, return_inverse=True)
                cut = np.array([self._cut(t, level, int(n)) for n in present])[which] if len(present) else np.zeros(0)
                left, right = at <= cut + spill, at > cut - spill
                rows = np.concatenate([rows[left], rows[right]])
                nodes = np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
            out.append((rows, nodes))
        return out


def _vec(vectors: DataFrame) -> Column:
    """The vector column; single precision stays so until it is compared."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col("embedding").cast("array<float>" if single else "array<double>")


def classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors (vec, node, n): not null, not zero, of finite components only."""
    vec = _vec(vectors)
    usable = F.col("embedding").isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable & F.exists(vec, lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), vec).alias("vec"))
    return rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as unit rows in double precision, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, width))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.zeros((len(sizes), width))
    m[np.arange(width)[None, :] < sizes[:, None]] = flat
    return unit(m)


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the link matrix connects, one per member and parent."""
    todo, edges = np.ones(len(near), bool), []
    for start in range(len(near)):
        if not todo[start]:
            continue
        todo[start], stack = False, [start]
        while stack:
            i = stack.pop()
            fresh = np.flatnonzero(near[i] & todo)
            todo[fresh] = False
            edges += [(i, int(j)) for j in fresh]
            stack += fresh.tolist()
    return edges


FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _met_before(places: pa.Array, rows: np.ndarray, here: int) -> np.ndarray:
    """Whether two of the rows share a leaf that comes before this one."""
    sizes = places.value_lengths().to_numpy(zero_copy_only=False)
    flat = places.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.full(len(sizes), -1)
    order[rows] = np.arange(len(rows))
    used = (order[owner] >= 0) & (flat < here)
    leaves, which = np.unique(flat[used], return_inverse=True)
    member = np.zeros((len(rows), max(1, len(leaves))), np.float32)
    member[order[owner[used]], which] = 1
    return member @ member.T > 0


def compare(least: float, width: int):
    """One pair of blocks of one leaf -> links counted here per class, and spanning edges."""

    def run(key, group):
        tree, spot, low, high = (k.as_py() for k in key)
        vectors, part = matrix(group.column("vec"), width), group.column("part").to_numpy()
        a = np.flatnonzero(part == low)
        b = a if low == high else np.flatnonzero(part == high)
        near = vectors[a] @ vectors[b].T >= least
        if low == high:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        if not len(i):
            return pa.table([[], [], []], schema=FOUND)
        i, j = a[i], b[j]
        if low != high:
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
        rows, place = np.unique(i, return_inverse=True)
        other = np.searchsorted(rows, j)
        # a pair counts in the first tree and the first leaf of it that its vectors share
        seen = _met_before(group.column("places").combine_chunks(), rows, (tree << 48) + spot)[place, other]
        nodes, n = group.column("node").to_numpy()[rows], group.column("n").to_numpy()[rows]
        links = np.bincount(place[~seen], n[other[~seen]], len(rows)).astype(np.int64)
        linked = np.zeros((len(rows), len(rows)), bool)
        linked[place, other] = True
        edges = np.array(_spanning(linked), np.int64).reshape(-1, 2)
        counted = np.flatnonzero(links)
        cols = [
            np.concatenate([nodes[counted], nodes[edges[:, 0]]]),
            np.concatenate([links[counted], np.zeros(len(edges), np.int64)]),
            np.concatenate([nodes[counted], nodes[edges[:, 1]]]),
        ]
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=FOUND)

    return run


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding).

    n_links: other rows with cosine >= least that were found; component_id: the smallest vec_id
    reachable over links. Vectors that are null, zero, or hold null or non-finite components link
    with nothing. Equal vectors are always linked, also rows that repeat a vec_id. Vectors of
    other widths than the most frequent one are compared among themselves by padding with zeros.
    Rows with a null vec_id come out as their own, without links.
    """
    spark = vectors.sparkSession
    known, _ = keep(classes(vectors.where("vec_id is not null")), "forest-classes")
    stats = known.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    vec = _vec(vectors)
    if not stats.n:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    width = stats.width
    # the fitting sample: the vectors with the smallest hashes, a bounded number
    rows = known.orderBy(F.xxhash64("node"), "node").select("vec").limit(sample).toArrow()
    depth = max(0, math.ceil(math.log2(max(1, stats.n / leaf))))
    forest = Forest(matrix(rows.column("vec"), width), depth, width, trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for t, (where, leaves) in enumerate(forest.leaves(matrix(batch.column("vec"), width), spill)):
                for r, l in zip(where.tolist(), leaves.tolist()):
                    own[r].append((t << 48) + l)
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("node"), batch.column("n"), pa.array(own, pa.list_(pa.int64()))], names=["vec", "node", "n", "places"])

    placed, placed_path = keep(known.mapInArrow(place, f"vec {known.schema['vec'].dataType.simpleString()}, node long, n long, places array<long>"), "forest-places")
    sizes = placed.select(F.explode("places").alias("place")).groupBy("place").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    each = placed.select("*", F.explode("places").alias("place")).join(sizes, "place")
    each = each.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("low"), F.greatest(p, F.col("part")).alias("high")))
    each = each.withColumn("pair", F.explode(pairs)).withColumns({"tree": F.shiftright("place", 48).cast("int"), "spot": F.col("place").bitwiseAND(F.lit((1 << 48) - 1))})
    groups = each.select("tree", "spot", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "vec", "node", "n", "places", "part").groupBy("tree", "spot", "low", "high")
    found, found_path = keep(groups.applyInArrow(compare(least, width), "node long, links long, other long"), "forest-links")
    linked = components(found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")), "forest-groups")
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    whole = known.join(counts, "node", "left").join(linked, "node", "left")
    whole = whole.select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    whole, _ = keep(whole, "forest-classes-linked")
    discard(spark, placed_path)
    discard(spark, found_path)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), vec).alias("vec"))
    out = own.join(whole, "vec", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.coalesce(F.col("vec_id") == component, F.lit(True))).alias("kept"))
