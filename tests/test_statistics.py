"""Regression, correlation, pseudo-F and maps against direct formulas."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from freshet.functions.tails import student_t_quantile, student_t_two_sided
from freshet.operators import models, moments, permanova, sizing, som
from freshet.plans.sweep import read_grid, sweep

# two-sided tails of Student's t: statistic, degrees of freedom, p (fixed values from printed tables)
TAILS = [(12.706205, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05), (2.228139, 10, 0.05), (2.085963, 20, 0.05), (2.845340, 20, 0.01), (1.983972, 100, 0.05), (1.959964, 10**9, 0.05), (4.891638, 10**9, 1e-6), (0.0, 7, 1.0)]


def test_t_tails(spark):
    df = spark.createDataFrame([(t, float(d), p) for t, d, p in TAILS], "t double, dof double, p double")
    for r in df.withColumn("got", student_t_two_sided(F.col("t"), F.col("dof").cast("long"))).collect():
        assert r["got"] == pytest.approx(r["p"], rel=2e-5, abs=1e-9)


def _beta_tail(t: float, n: int) -> float:
    """By the continued fraction of the incomplete beta function."""
    a, b, x = n / 2, 0.5, n / (n + t * t)

    def fraction(a, b, x):
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 100_000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def test_tails_by_one_method_for_every_dof(spark):
    places = [(n, t) for n in (1, 2, 7, 999, 1001, 100_000, 10**9) for t in (0.01, 0.5, 2.0, 4.0, 6.0, 10.0)]
    df = spark.createDataFrame(places, "dof long, t double").withColumn("p", student_t_two_sided(F.col("t"), F.col("dof")))
    for r in df.collect():
        if r["dof"] < 100_000:
            want = _beta_tail(r["t"], r["dof"])
        else:  # the normal tail and the first two corrections in 1/dof
            t, n, z = r["t"], r["dof"], math.exp(-r["t"] ** 2 / 2) / math.sqrt(2 * math.pi)
            first = (t + t**3) / (4 * n)
            second = (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / (96 * n * n)
            want = math.erfc(t / math.sqrt(2)) + 2 * z * (first + second)
        assert r["p"] == pytest.approx(want, rel=1e-8 if r["dof"] != 100_000 or r["t"] < 5 else 1e-5)


def test_quantiles_give_their_tail_back(spark):
    places = [(n,) for n in (1, 2, 3, 10, 97, 1000, 10**6, 10**9)]
    for level in (0.1, 0.5, 0.95, 0.99, 1 - 1e-6):
        df = spark.createDataFrame(places, "dof long").withColumn("t", student_t_quantile(level, F.col("dof")))
        for r in df.withColumn("p", student_t_two_sided(F.col("t"), F.col("dof"))).collect():
            assert r["p"] == pytest.approx(1 - level, rel=1e-8)
            if r["dof"] == 1:
                assert r["t"] == pytest.approx(math.tan(math.pi * level / 2), rel=1e-8)
            if r["dof"] == 2:
                assert r["t"] == pytest.approx(level * math.sqrt(2 / (1 - level * level)), rel=1e-8)
    assert spark.range(1).select(student_t_quantile(0.95, F.lit(0))).first()[0] is None


def test_band_of_small_groups(spark):
    """Against the matrix formula; groups of two pairs, of one place, and rows without x or y."""
    rng = np.random.default_rng(2)
    xs, noise = rng.normal(size=30), rng.normal(size=30)
    rows = [("a", float(x), float(2 * x + 1 + e)) for x, e in zip(xs, noise)] + [("a", None, 1.0), ("a", 0.5, None), ("two", 1.0, 1.0), ("two", 2.0, 3.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 4.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = models.fitted_band(df, "y", "x", ["g"]).collect()
    assert len(got) == len(rows)
    design = np.column_stack([np.ones(30), xs])
    ys = 2 * xs + 1 + noise
    beta, rest, _, _ = np.linalg.lstsq(design, ys, rcond=None)
    inverse, spread = np.linalg.inv(design.T @ design), math.sqrt(rest[0] / 28)
    for r in got:
        if r["g"] == "a" and r["x"] is not None:
            at = np.array([1, r["x"]])
            half = 2.048407141795244 * spread * math.sqrt(at @ inverse @ at)  # fixed value: the 0.975 quantile for 28 degrees
            assert (r["fitted"], r["lower"], r["upper"]) == pytest.approx((at @ beta, at @ beta - half, at @ beta + half), rel=1e-9)
        elif r["g"] == "two":
            assert r["fitted"] == pytest.approx(r["y"]) and r["lower"] is None
        else:
            assert r["lower"] is None
    one = models.fitted_band(df.where("g = 'a'").drop("g"), "y", "x").where("x is not null").orderBy("x").first()
    grid = models.band_grid(df, "y", "x", ["g"], points=5).where("g = 'a'").orderBy("point").collect()
    assert [r["x"] for r in grid] == pytest.approx(list(np.linspace(xs.min(), xs.max(), 5)))
    assert (grid[0]["lower"], grid[0]["upper"]) == pytest.approx((one["lower"], one["upper"]))


def test_rows_with_a_missing_feature_do_not_reach_a_map(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(59, 2)))] + [(59, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    codes, progress = som.fit(df, "id", ["x", "y"], [{"run": 1, "rows": 3, "cols": 3}], epochs=4)
    assert all(np.isfinite(r["w"]).all() for r in codes.collect()) and progress.where("isnan(mean_distance)").count() == 0
    assert som.assign(df, ["x", "y"], codes).count() == 59


def test_exact_line_with_missing_pairs(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(6)] + [(None, 3.0), (4.0, None)], "x double, y double")
    r = models.linear_fit(df, "y", "x").first()
    assert (r["n"], r["slope"], r["intercept"], r["r2"]) == (6, pytest.approx(2), pytest.approx(1), pytest.approx(1))
    assert models.fitted_line(df, "y", "x").where("x = 5").first()["fitted"] == pytest.approx(11)


@pytest.mark.parametrize("n", [3, 4, 5, 20, 41])
def test_slope_p_value_matches_a_full_fit(spark, n):
    rng = np.random.default_rng(n)
    data = [(float(x), float(x + rng.normal() * 3)) for x in rng.normal(size=n)]
    df = spark.createDataFrame(data, "x double, y double")
    full = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(df))
    r = models.linear_fit(df, "y", "x").first()
    assert r["p_value"] == pytest.approx(full.summary.pValues[0], abs=1e-9)
    assert r["adj_r2"] == pytest.approx(full.summary.r2adj, abs=1e-9)


def pair_f(x, labels, power):
    d = lambda a: (np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1)) ** power).sum() / (2 * len(a))
    groups = [x[labels == k] for k in np.unique(labels)]
    within, total, k, n = sum(map(d, groups)), d(x), len(groups), len(x)
    return ((total - within) / (k - 1)) / (within / (n - k))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.2, (60, 3)), rng.normal(2, 0.3, (90, 3)), rng.normal((0, 3, 0), 0.2, (40, 3))])
    label = np.repeat([1, 2, 3], [60, 90, 40])
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(label, x))], "id long, c int, a double, b double, d double")
    return df, x, label


COLS = ["a", "b", "d"]


@pytest.mark.parametrize("power", [2, 4])
def test_pseudo_f_equals_the_pair_formula(blobs, power):
    df, x, label = blobs
    r = permanova.pseudo_f(df, "c", COLS, power=power).first()
    assert (r["n"], r["k"]) == (190, 3) and r["f"] == pytest.approx(pair_f(x, label, power), rel=1e-9)


def test_permutations_keep_label_counts_and_are_uniform(blobs):
    df, _, label = blobs
    got = permanova.permuted_labels(df, "id", "c", [], 50, 3, ["id"]).toPandas()
    for _, part in got.groupby("perm"):
        assert part["_label"].value_counts().to_dict() == {2: 90, 1: 60, 3: 40}
        assert sorted(part["id"]) == list(range(190))
    # each row gets each label about as often as the label occurs
    share = (got["_label"] == 2).groupby(got["id"]).mean()
    assert abs(share.mean() - 90 / 190) < 1e-9 and share.std() < 0.15


def test_permutation_p(spark, blobs):
    df, _, _ = blobs
    assert permanova.permanova(df, "id", "c", COLS).first()["p_value"] == pytest.approx(0.01)
    noise = df.withColumn("c", F.when(F.xxhash64("id") % 2 == 0, 1).otherwise(2))
    both = df.withColumn("run", F.lit(1)).unionByName(noise.withColumn("run", F.lit(2)))
    got = {r["run"]: r["p_value"] for r in permanova.permanova(both, "id", "c", COLS, by=["run"]).collect()}
    assert got[1] == pytest.approx(0.01) and got[2] > 0.05


GRID = [{"run": 1, "rows": 3, "cols": 4, "k": 3}, {"run": 2, "rows": 4, "cols": 4, "topology": "rectangular", "k": 2}]


def test_training_improves_and_repeats(blobs):
    df, x, _ = blobs
    codes, progress = som.fit(df, "id", COLS, GRID, epochs=12)
    again, _ = som.fit(df, "id", COLS, GRID, epochs=12)
    key = lambda d: sorted((r["run"], r["node"], tuple(np.round(r["w"], 9))) for r in d.collect())
    assert key(codes) == key(again)
    p = progress.toPandas().sort_values(["run", "epoch"])
    for _, part in p.groupby("run"):
        assert part["mean_distance"].iloc[-1] < part["mean_distance"].iloc[1]
    qe = {r["run"]: r["qe"] for r in som.quantization_error(som.assign(df, COLS, codes)).collect()}
    spread = ((x - x.mean(0)) ** 2).sum(1).mean()
    assert all(v < spread / 10 for v in qe.values())


def test_assignment_in_slices_equals_brute_force(spark, blobs, monkeypatch):
    df, x, _ = blobs
    rng = np.random.default_rng(1)
    w = rng.normal(1, 1, (11, 3))
    w[7] = w[2]  # equal codes: the lower node wins
    codes = spark.createDataFrame([(1, i + 1, [float(v) for v in r]) for i, r in enumerate(w)], "run int, node int, w array<double>")
    d = ((x[:, None] - w[None]) ** 2).sum(-1)
    for size in (4096, 4, 1):
        monkeypatch.setattr(som, "SLICE_NODES", size)
        got = som.assign(df, COLS, codes).orderBy("id").toPandas()
        assert (got["node"].to_numpy() == d.argmin(1) + 1).all()
        assert got["dist"].to_numpy() == pytest.approx(d.min(1))


def slow_complete_linkage(w, k):
    groups = [[i] for i in range(len(w))]
    far = lambda a, b: max(((w[i] - w[j]) ** 2).sum() for i in a for j in b)
    while len(groups) > k:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    order = sorted(groups, key=min)
    return [next(n for n, g in enumerate(order, 1) if i in g) for i in range(len(w))]


def test_tree_cut_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    books = {1: (rng.normal(size=(14, 2)), 4), 2: (rng.normal(size=(9, 2)), 2)}
    codes = spark.createDataFrame([(run, i + 1, [float(v) for v in r]) for run, (w, _) in books.items() for i, r in enumerate(w)], "run int, node int, w array<double>")
    k = spark.createDataFrame([(run, k) for run, (_, k) in books.items()], "run int, k int")
    got = som.node_clusters(codes, k).toPandas()
    for run, (w, cut) in books.items():
        assert got[got.run == run].sort_values("node")["cluster"].tolist() == slow_complete_linkage(w, cut)


def test_hexagonal_grid():
    points = som.lattice(2, 3)
    assert points[:, 0].tolist() == [1.5, 2.5, 3.5, 1.0, 2.0, 3.0]
    near = som.neighbourhood_sums(np.ones((25, 1)), som.lattice(5, 5), 1.0)
    assert near[12, 0] == pytest.approx(7)  # an inner node has six neighbours


def test_sweep_from_a_parameter_table(spark, blobs):
    df, _, _ = blobs
    params = spark.createDataFrame(
        [(1, "both", 12, "hexagonal", 3, 4, "L2norm", "noPCA", 1500, 0.05, 0.01, 3, 1.3), (2, "both", 16, "hexagonal", 4, 4, "scale", "PCA", 1500, 0.05, 0.01, 2, 1.0)],
        "myRun int, myDataSet string, nodes int, myTopo string, rows int, cols int, normMeth string, wghtMeth string, niter int, crsAlpha double, finAlpha double, nClusters int, colRowRatio double",
    )
    scores, found = sweep(df, "id", COLS, read_grid(params), weights={"a": 2.0}, epochs=10)
    got = {r["run"]: r for r in scores.collect()}
    assert got[1]["p_value"] == pytest.approx(0.01) and got[2]["clusters"] == 2
    n = found.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("k")).collect()
    assert {(r["run"], r["n"], r["k"]) for r in n} == {(1, 190, 3), (2, 190, 2)}
    # three separated blobs: pseudo-F of the found clusters is that of the true ones
    truth = found.where("run = 1").join(df.select("id", "c"), "id").groupBy("c").agg(F.countDistinct("cluster").alias("k"))
    assert {r["k"] for r in truth.collect()} == {1}


def test_lattice_is_not_larger_than_the_data(blobs):
    df, _, _ = blobs
    with pytest.raises(ValueError):
        som.fit(df.limit(5), "id", COLS, GRID)


def test_sizing(blobs):
    df, x, _ = blobs
    r = sizing.lattice_size(df, COLS).first()
    eigen = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert (r["n"], r["nodes"]) == (190, round(5 * 190**0.5)) and r["col_row_ratio"] == round(eigen[0] / eigen[1], 1)
    elbow = {r["k"]: r["wss"] for r in sizing.kmeans_elbow(df, COLS, most=4).collect()}
    assert elbow[1] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    assert elbow[1] > elbow[2] > elbow[3]


@pytest.mark.parametrize("rows,cols,topology", [(1, 1, "hexagonal"), (1, 6, "hexagonal"), (5, 1, "hexagonal"), (4, 5, "hexagonal"), (5, 6, "hexagonal"), (7, 3, "hexagonal"), (4, 5, "rectangular"), (6, 2, "rectangular")])
def test_lattice_neighbourhood_is_that_of_all_pairs(rows, cols, topology):
    points = som.lattice(rows, cols, topology)
    gap = np.abs(points[:, None, :] - points[None, :, :])
    distance = gap.max(axis=2) if topology == "rectangular" else np.sqrt((gap**2).sum(axis=2))
    pairs = distance[np.triu_indices(len(points), 1)]
    assert som.start_radius(rows, cols, topology) == pytest.approx(np.quantile(pairs, 2 / 3) if len(pairs) else 0.0)
    table = np.random.default_rng(1).normal(size=(len(points), 3))
    for radius in (0.0, 0.5, 1.0, 1.7, 2.0, 9.0):
        assert np.allclose(som.neighbourhood_sums(table, points, radius, topology), (distance <= radius + 1e-9) @ table)


def test_a_lattice_of_twenty_thousand_nodes_trains(spark):
    df = spark.range(25_000).selectExpr("id", "pmod(xxhash64(id), 1000) / 1000.0D AS x", "pmod(xxhash64(id, 1), 1000) / 1000.0D AS y")
    codes, progress = som.fit(df, "id", ["x", "y"], [{"run": 1, "rows": 100, "cols": 200}], epochs=2)
    assert codes.count() == 20_000 and progress.count() == 2


def test_correlations_with_missing_values_and_constant_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 40)) + 1e6
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=400)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 39] = 5.0
    names = [f"c{i}" for i in range(40)]
    table = [[None if math.isnan(v) and i % 2 else float(v) for i, v in enumerate(row)] for row in x]  # both null and NaN
    df = spark.createDataFrame(table, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r["var_a"], r["var_b"]): (r["r"], r["n"]) for r in moments.correlations(df, names).collect()}
    assert len(got) == 40 * 39 // 2
    for i, j in itertools.combinations(range(40), 2):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        r, n = got[names[i], names[j]]
        assert n == both.sum()
        if j == 39:
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], rel=1e-6, abs=1e-8)
    assert moments.correlations(df.limit(0), names).count() == 0


def test_weights_are_loadings_of_complete_rows(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 1))
    x = np.hstack([base + rng.normal(size=(300, 1)) * s for s in (0.1, 0.5, 2.0)]) * [1, -30, 4]
    df = spark.createDataFrame([[float(v) for v in row] for row in x] + [[None, 1.0, 2.0]], "a double, b double, c double")
    got = moments.first_loadings(df, ["a", "b", "c"])
    vector = np.linalg.eigh(np.corrcoef(x.T))[1][:, -1]
    vector *= np.sign(vector[np.abs(vector).argmax()])
    assert [got[c] for c in "abc"] == pytest.approx(list(vector))
    with pytest.raises(ValueError, match="constant"):
        moments.first_loadings(df.withColumn("c", F.lit(1.0)), ["a", "c"])


def test_learning_rates_act(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rng.normal(size=(3000, 3)))], "id long, a double, b double, c double")
    cols, size = ["a", "b", "c"], {"rows": 4, "cols": 5}
    rates = [{}, {"alpha_coarse": 0.05, "alpha_fine": 0.01, "iterations": 1000}, {"alpha_coarse": 0.0005, "alpha_fine": 0.0001, "iterations": 1}]
    runs = [{"run": i, **size, **r} for i, r in enumerate(rates)]

    def train(**more):
        codes, _ = som.fit(df, "id", cols, runs, seed=3, **more)
        errors = {r["run"]: r["qe"] for r in som.quantization_error(som.assign(df, cols, codes)).collect()}
        return errors, {(r["run"], r["node"]): np.array(r["w"]) for r in codes.collect()}

    errors, codes = train()
    again = train()[1]
    assert all((codes[k] == again[k]).all() for k in codes)
    assert errors[1] == pytest.approx(errors[0], rel=0.05)
    assert max(np.abs(codes[2, n] - codes[0, n]).max() for n in range(1, 21)) > 0.05
    # in three batches
    errors, dealt = train(batch_rows=1000)
    assert errors[1] == pytest.approx(errors[0], rel=0.05) and errors[0] < 0.8
    assert any((dealt[k] != codes[k]).any() for k in codes)
    with pytest.raises(ValueError, match="rates"):
        som.fit(df, "id", cols, [{"run": 1, **size, "alpha_coarse": 0.01, "alpha_fine": 0.05}])


def test_lattices_near_the_aims():
    for nodes, ratio, most in ((115, 1.3, 530), (20, 4.0, 1000), (3, 1.0, 2), (1000, 1.1, 10**6)):
        every = [(round(abs(math.log(r * c / nodes)) + abs(math.log(c / r / ratio)), 9), r, c) for r in range(1, 300) for c in range(1, 300) if r * c <= most]
        assert sizing.lattices(nodes, ratio, most, 4) == [(r, c) for _, r, c in sorted(every)[:4]]


def test_every_permutation_has_its_own_labels(spark):
    """Pseudo-F of a permutation is that of the rows with its labels, in several groups with nulls among them."""
    rng = np.random.default_rng(12)
    rows = [(i, g, f"l{rng.integers(3)}", *map(float, rng.normal(size=2))) for g in ("x", None) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, g string, l string, a double, b double").repartition(3)
    got = {(r["g"], r["perm"]): r["f"] for r in permanova.permuted_f(df, "id", "l", ["a", "b"], ["g"], permutations=7, seed=5).collect()}
    labelled = permanova.permuted_labels(df, "id", "l", ["g"], 7, 5, ["id", "a", "b"])
    want = {(r["g"], r["perm"]): r["f"] for r in permanova.pseudo_f(labelled, "_label", ["a", "b"], ["g", "perm"]).collect()}
    assert len(got) == 14 and got.keys() == want.keys()
    for k, f in want.items():
        assert got[k] == pytest.approx(f, rel=0.2) and len({round(v, 9) for v in got.values()}) == 14  # centred over other rows
    p = {r["g"]: r["p_value"] for r in permanova.permanova(df, "id", "l", ["a", "b"], ["g"], permutations=7, seed=5).collect()}
    assert set(p) == {"x", None} and all(0 < v <= 1 for v in p.values())
