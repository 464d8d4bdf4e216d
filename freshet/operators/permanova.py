"""Pseudo-F of a grouping and its permutation p-value, without pairwise distances.

A sum over all pairs of |x-y|^2 or |x-y|^4 is a polynomial in the first moments
of the rows, so one grouped aggregation replaces the n x n distance matrix.

A permutation of the labels is drawn without moving or copying rows: a row has one 64-bit number, from which
every permutation makes another by a bijection, and the label counts cut the order of those into
stretches, one per label. The cuts are order statistics, found by counting buckets and ranking only the numbers in
the buckets that contain a cut. Tasks then add up the moments of all permutations and labels per Arrow batch, so what
is shuffled does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.joins import join_matching_nulls
from freshet.sources.stages import stage

BUCKET_BITS = 12  # the leading bits of a number that name its bucket
AT_ONCE = 1 << 16  # rows of a batch whose moments are added up at once
# fixed values: increment and multipliers of the splitmix64 generator
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str], power: int) -> DataFrame:
    square = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    df = df.withColumn("_s", square)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_s").alias("ss")]
    aggs += [F.sum(c).alias(f"s1_{i}") for i, c in enumerate(cols)]
    if power == 4:
        aggs.append(F.sum(F.col("_s") * F.col("_s")).alias("ss2"))
        aggs += [F.sum(F.col("_s") * F.col(c)).alias(f"sx_{i}") for i, c in enumerate(cols)]
        aggs += [
            F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}")
            for i, a in enumerate(cols)
            for j, b in enumerate(cols)
            if i <= j
        ]
    return df.groupBy(*keys).agg(*aggs)


def _within(p: int, power: int) -> Column:
    """Sum over ordered pairs of the distance to the given power, divided by 2n."""
    n = F.col("n")
    total = lambda terms: sum(terms, F.lit(0.0))
    if power == 2:
        pairs = n * 2.0 * F.col("ss") - total(F.col(f"s1_{i}") * F.col(f"s1_{i}") for i in range(p)) * 2.0
    else:
        m2 = total(
            F.col(f"m_{i}_{j}") * F.col(f"m_{i}_{j}") * (1.0 if i == j else 2.0)
            for i in range(p)
            for j in range(i, p)
        )
        cross = total(F.col(f"sx_{i}") * F.col(f"s1_{i}") for i in range(p))
        pairs = n * 2.0 * F.col("ss2") + F.col("ss") * F.col("ss") * 2.0 + m2 * 4.0 - cross * 8.0
    return pairs / (n * 2.0)


def _f_table(moments: DataFrame, keys: Sequence[str], p: int, power: int) -> DataFrame:
    sums = [c for c in moments.columns if c not in keys and c != "_label"]
    per_label = moments.withColumn("_ssw", _within(p, power))
    overall = per_label.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("_ssw").alias("_ssw"), F.count(F.lit(1)).alias("k")
    )
    between = (_within(p, power) - F.col("_ssw")) / (F.col("k") - 1)
    f = F.try_divide(between, F.col("_ssw") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    return overall.select(*keys, "n", "k", F.when(F.col("k") > 1, f).alias("f"))


def _centred(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    mean = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    return df.withColumns({c: F.col(c) - mean[c] for c in cols})


def pseudo_f(df: DataFrame, label: str, cols: Sequence[str], by: Sequence[str] = (), power: int = 4) -> DataFrame:
    """Rows n, clusters k and pseudo-F per ``by`` group.

    ``power`` 4 squares a distance that already is a sum of squares, as the
    published sweep scores do; 2 is the usual form.
    """
    if power not in (2, 4):
        raise ValueError("power is 2 or 4")
    rows = _centred(df, cols).withColumnRenamed(label, "_label")
    moments = _moments(rows, [*by, "_label"], cols, power)
    return _f_table(moments, list(by), len(cols), power)


def _number(df: DataFrame, key: str) -> Column:
    """A row's 64-bit number: whole numbers and days are their own, others are hashed."""
    kind = dict(df.dtypes)[key]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(key).cast("long")
    if kind == "date":
        return F.date_diff(F.col(key), F.lit("1970-01-01").cast("date")).cast("long")
    return F.xxhash64(key)


def shuffled(numbers: np.ndarray, perm: int, seed: int) -> np.ndarray:
    """The rows' numbers in a permutation, as unsigned: a bijection, so rows with different numbers never tie."""
    mask = (1 << 64) - 1
    z = numbers.astype(np.int64).view(np.uint64) + np.uint64((perm * STEP + seed * FIRST) & mask)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def _signed(numbers: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (numbers ^ np.uint64(1 << 63)).view(np.int64)


class _Groups:
    """The ``by`` groups by number, and where the stretches of their labels end."""

    def __init__(self, df: DataFrame, by: Sequence[str], label: str):
        counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c")).orderBy(*by, label).collect()
        self.by, self.keys, self.labels, self.upto = list(by), [], [], []
        for row in counts:
            key = tuple(row[c] for c in by)
            if not self.keys or self.keys[-1] != key:
                self.keys.append(key)
                self.labels.append([])
                self.upto.append([])
            self.labels[-1].append(row[label])
            self.upto[-1].append(row["_c"] + (self.upto[-1][-1] if self.upto[-1] else 0))

    def table(self, df: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in self.by)
        return df.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(self.keys)], f"_g int, {schema}")

    def numbered(self, df: DataFrame) -> DataFrame:
        """The rows with the number of their group."""
        if not self.by:
            return df.withColumn("_g", F.lit(0))
        return join_matching_nulls(df, self.table(df), self.by, "left")


def _each(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of every group of a batch."""
    if len(group) and (group[0] == group).all():
        yield int(group[0]), np.arange(len(group))
        return
    order = np.argsort(group, kind="stable")
    found, starts = np.unique(group[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, starts[1:]))


def _cuts(rows: DataFrame, groups: _Groups, permutations: int, seed: int) -> dict[int, np.ndarray]:
    """Per group a (permutations, labels) table of the last number of every label's stretch. ``rows`` has _g and _b."""
    shift = np.uint64(64 - BUCKET_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers = batch.column(1).to_numpy(zero_copy_only=False)
            for g, at in _each(batch.column(0).to_numpy(zero_copy_only=False)):
                table = found.setdefault(g, np.zeros((permutations, 1 << BUCKET_BITS), np.int64))
                for p in range(permutations):
                    table[p] += np.bincount((shuffled(numbers[at], p + 1, seed) >> shift).astype(np.int64), minlength=1 << BUCKET_BITS)
        for g, table in found.items():
            perm, bucket = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(perm), g, np.int32)), pa.array(perm.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[perm, bucket])],
                names=["_g", "_p", "_bucket", "_c"],
            )

    counted = rows.select("_g", "_b").mapInArrow(count, "_g int, _p int, _bucket int, _c long")
    hist = counted.groupBy("_g", "_p", "_bucket").agg(F.sum("_c").alias("_c"))
    upto = Window.partitionBy("_g", "_p").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_to", F.sum("_c").over(upto)).withColumn("_from", F.col("_to") - F.col("_c"))
    ends = rows.sparkSession.createDataFrame([(g, i, u) for g, all_ in enumerate(groups.upto) for i, u in enumerate(all_)], "_g int, _l int, _upto long")
    placed = hist.join(ends, "_g").where((F.col("_from") < F.col("_upto")) & (F.col("_upto") <= F.col("_to")))
    # one row per group, permutation and label: the bucket in which the label's stretch ends, and the rank in it
    placed = stage(placed.select("_g", "_p", "_bucket", "_l", (F.col("_upto") - F.col("_from")).alias("_rank")), "placed")
    wanted: dict[int, np.ndarray] = {}
    for g, p, bucket in placed.select("_g", "_p", "_bucket").distinct().collect():
        wanted.setdefault(g, np.zeros((permutations, 1 << BUCKET_BITS), bool))[p, bucket] = True
    shared = rows.sparkSession.sparkContext.broadcast({g: np.packbits(t, axis=1) for g, t in wanted.items()})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {g: np.unpackbits(t, axis=1).astype(bool) for g, t in shared.value.items()}
        for batch in batches:
            numbers = batch.column(1).to_numpy(zero_copy_only=False)
            for g, at in _each(batch.column(0).to_numpy(zero_copy_only=False)):
                for p in range(permutations):
                    h = shuffled(numbers[at], p + 1, seed)
                    bucket = (h >> shift).astype(np.int64)
                    use = tables[g][p, bucket]
                    n = int(use.sum())
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, g, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(bucket[use].astype(np.int32)), pa.array(_signed(h[use]))],
                            names=["_g", "_p", "_bucket", "_h"],
                        )

    ranked = rows.select("_g", "_b").mapInArrow(near, "_g int, _p int, _bucket int, _h long").join(placed, ["_g", "_p", "_bucket"])
    place = F.row_number().over(Window.partitionBy("_g", "_p", "_l").orderBy("_h"))
    out = {g: np.zeros((permutations, len(u)), np.int64) for g, u in enumerate(groups.upto)}
    for g, p, label, h in ranked.withColumn("_n", place).where("_n = _rank").select("_g", "_p", "_l", "_h").collect():
        out[g][p, label] = h
    return out


def permuted_labels(df: DataFrame, key: str, label: str, by: Sequence[str], permutations: int, seed: int, keep: Sequence[str]) -> DataFrame:
    """Rows (by, perm, label, keep...) with the labels of each ``by`` group shuffled anew per permutation.

    ``key`` is unique within a ``by`` group. Label counts are preserved exactly. Every row comes out once per
    permutation; the p-value itself is found without such copies.
    """
    groups = _Groups(df, by, label)
    rows = groups.numbered(df.withColumn("_b", _number(df, key)))
    cuts = df.sparkSession.sparkContext.broadcast(_cuts(rows, groups, permutations, seed))

    @F.pandas_udf("array<int>")
    def drawn(group: pd.Series, number: pd.Series) -> pd.Series:
        out = np.zeros((len(group), permutations), np.int32)
        for g, at in _each(group.to_numpy()):
            for p in range(permutations):
                out[at, p] = np.searchsorted(cuts.value[g][p], _signed(shuffled(number.to_numpy()[at], p + 1, seed)))
        return pd.Series(list(out))

    names = F.array(*[F.array(*map(F.lit, labels)) for labels in groups.labels])
    each = rows.select(*by, *[c for c in keep if c not in by], "_g", F.posexplode(drawn("_g", "_b")).alias("perm", "_l"))
    found = F.element_at(F.element_at(names, F.col("_g") + 1), F.col("_l") + 1)
    return each.select(*by, (F.col("perm") + 1).alias("perm"), found.alias("_label"), *[c for c in keep if c not in by])


def _permuted_moments(rows: DataFrame, groups: _Groups, cuts: dict[int, np.ndarray], width: int, power: int, permutations: int, seed: int) -> DataFrame:
    """(_g, perm, _label, moments...) of all permutations; ``rows`` has _g, _b and the centred features _x."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    names = ["n", "ss", *[f"s1_{i}" for i in range(width)]]
    if power == 4:
        names += ["ss2", *[f"sx_{i}" for i in range(width)], *[f"m_{i}_{j}" for i, j in pairs]]

    def terms(x: np.ndarray) -> np.ndarray:
        s = (x * x).sum(axis=1)
        out = [np.ones(len(x)), s, *x.T]
        if power == 4:
            out += [s * s, *(s[:, None] * x).T, *(x[:, i] * x[:, j] for i, j in pairs)]
        return np.stack(out, axis=1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                numbers = part.column(1).to_numpy(zero_copy_only=False)
                every = terms(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                for g, at in _each(part.column(0).to_numpy(zero_copy_only=False)):
                    k = ends[g].shape[1]
                    total = sums.setdefault(g, np.zeros((permutations, k, len(names))))
                    mine, own = numbers[at], every[at]
                    for p in range(permutations):
                        drawn = np.searchsorted(ends[g][p], _signed(shuffled(mine, p + 1, seed)))
                        total[p] += (drawn[None, :] == np.arange(k)[:, None]).astype(float) @ own
        for g, total in sums.items():
            perm, label = np.nonzero(total[:, :, 0] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(perm), g, np.int32)), pa.array((perm + 1).astype(np.int32)), pa.array(label.astype(np.int32)), *map(pa.array, total[perm, label].T)],
                names=["_g", "perm", "_label", *names],
            )

    schema = "_g int, perm int, _label int, " + ", ".join(f"{n} double" for n in names)
    made = rows.select("_g", "_b", "_x").mapInArrow(add_up, schema)
    return made.groupBy("_g", "perm", "_label").agg(*[F.sum(n).alias(n) for n in names])


def permuted_f(df: DataFrame, key: str, label: str, cols: Sequence[str], by: Sequence[str] = (), power: int = 4, permutations: int = 99, seed: int = 1) -> DataFrame:
    """(by, perm, f): the pseudo-F of every permutation of the labels."""
    by = list(by)
    groups = _Groups(df, by, label)
    if not groups.keys:
        return df.select(*by, F.lit(0).alias("perm"), F.lit(0.0).alias("f")).limit(0)
    features = F.array(*[F.col(c).cast("double") for c in cols])
    rows = groups.numbered(_centred(df, cols).select(*by, _number(df, key).alias("_b"), features.alias("_x")))
    cuts = _cuts(rows, groups, permutations, seed)
    moments = _permuted_moments(rows, groups, cuts, len(cols), power, permutations, seed)
    f = _f_table(moments, ["_g", "perm"], len(cols), power)
    if by:
        f = f.join(groups.table(df), "_g")
    return f.select(*by, "perm", "f")


def permanova(df: DataFrame, key: str, label: str, cols: Sequence[str], by: Sequence[str] = (), power: int = 4, permutations: int = 99, seed: int = 1) -> DataFrame:
    """pseudo_f with the share of permutations that reach it; 1/(permutations+1) is the smallest p."""
    by = list(by)
    observed = pseudo_f(df, label, cols, by, power)
    drawn = permuted_f(df, key, label, cols, by, power, permutations, seed).groupBy(*by).agg(F.collect_list("f").alias("_all"))
    if by:
        scored = join_matching_nulls(observed, drawn, by, "left")
    else:
        all_ = drawn.select("_all").scalar()
        scored = observed.withColumn("_all", all_)
    # an undefined pseudo-F is null and reached by none
    reached = F.size(F.filter(F.coalesce("_all", F.array()), lambda f: f >= F.col("f")))
    return scored.select(*by, "n", "k", "f", ((reached + 1) / (permutations + 1)).alias("p_value"))
