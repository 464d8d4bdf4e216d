"""Links against all pairs."""

import math

import numpy as np
import pytest

from freshet.llm import forest


def rows(n=600, width=16, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.standard_normal(width)
        out.append(v)
        if i % 3 == 0:
            for _ in range(rng.integers(1, 6)):
                out.append(v + rng.standard_normal(width) * rng.choice([0.02, 0.1, 0.2]))
    out += [out[0] * 3.0] * 40 + [out[5]] * 30
    dense = rng.standard_normal(width) * 4
    out += [dense + rng.standard_normal(width) * 0.3 for _ in range(200)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


def brute(data):
    m = np.array([v for _, v in data])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def reach(near):
    group = np.arange(len(near))
    while True:
        low = np.array([min(group[i], group[near[i]].min() if near[i].any() else i) for i in range(len(near))])
        if (low == group).all():
            return group
        group = low


@pytest.mark.parametrize("block,leaf", [(2048, 64), (20, 64)])
def test_recall_and_groups(spark, block, leaf):
    data = rows()
    near = brute(data)
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in forest.near_duplicates(docs, leaf=leaf, block=block, spill=0.05).collect()}
    links = near.sum(1)
    assert len(got) == len(data)
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * links.sum()
    true = reach(near)
    assert np.mean([got[i].component_id == true[i] for i in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_of_deep_trees(spark):
    """The query's trees and spill, 11 levels deep: copies from just above the least cosine on."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((20_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * base[:4000]).sum(1, keepdims=True) * base[:4000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.999, (4000, 1))
    m = np.concatenate([base, cosine * base[:4000] + np.sqrt(1 - cosine**2) * side])
    links = np.concatenate([(m[a : a + 2000] @ m.T >= 0.95).sum(1) - 1 for a in range(0, len(m), 2000)])
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in forest.near_duplicates(docs, leaf=16).select("vec_id", "n_links").collect()}
    assert all(got[i] <= n for i, n in enumerate(links))
    assert sum(got.values()) >= 0.9 * links.sum()


def test_one_leaf_is_exact(spark):
    data = rows(60)
    near = brute(data)
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(docs, leaf=10_000, block=30, trees=2).collect()}
    true = reach(near)
    assert got == {i: (int(near[i].sum()), int(true[i])) for i in range(len(data))}


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    data = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [2.0, 0.0]), (7, [1.0, 0.0]), (9, []), (8, [0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-200, 0.0])]
    docs = spark.createDataFrame([(a, b, 0) for a, b in data], "vec_id long, embedding array<double>, vec int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(docs).collect()), key=str)
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 8, 9)] + [(None, 0, None, True)]
    assert got == sorted(alone + [(1, 3, 1, True), (7, 3, 1, False), (7, 3, 1, False), (10, 3, 1, False)], key=str)
    assert forest.near_duplicates(docs.limit(0)).collect() == []
