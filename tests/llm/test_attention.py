"""Gradients against differences, scores against labels kept out of the fit."""

import zlib

import numpy as np
import pytest

from freshet.llm import attention as at
from freshet.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def test_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.standard_normal((n, at.WIDTH)) for n in (1, 4, 2)]
    rows, starts, labels, w = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0, 1]), np.array([0.2, 0.5, 0.3])
    net = at.fit(bags, labels, w, steps=1)

    def loss():
        p = net.forward(rows, starts)["p"]
        decayed = sum((getattr(net, k) ** 2).sum() for k in net.LEARNED if not k.endswith("_b"))
        return -(w * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() + 0.5 * 0.1 * decayed

    slope = net.gradient(rows, starts, labels, w, 0.1)
    for k in net.LEARNED:
        value = getattr(net, k)
        for place in list(np.ndindex(value.shape))[::17] or [(0,)]:
            old = value[place]
            value[place] = old + 1e-6
            up = loss()
            value[place] = old - 1e-6
            down = loss()
            value[place] = old
            assert abs((up - down) / 2e-6 - slope[k][place]) < 1e-6


def test_passages_cover_the_text():
    for raw in (b"", b"x" * 5000, b"word " * 1000, "é ".encode() * 900, b"a\n" * 700):
        cuts = at.passages(raw)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(raw)
        assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and all(b - a <= 2 * at.PASSAGE for a, b in cuts)


def test_one_bad_passage_is_found():
    """Attention: a single junk passage among many decides the label."""
    rng = np.random.default_rng(2)
    bags, labels = [], []
    for i in range(300):
        bag = rng.standard_normal((12, at.WIDTH)) * 0.3
        if i % 2:
            bag[rng.integers(12), 0] += 4
        bags.append(bag)
        labels.append(1.0 - i % 2)
    net = at.fit(bags[:200], np.array(labels[:200]), np.ones(200))
    p = net.forward(np.concatenate(bags[200:]), np.arange(100) * 12)["p"]
    assert ((p >= 0.5) == np.array(labels[200:])).mean() > 0.95


@pytest.fixture(scope="module")
def network(spark):
    return at.train(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))


def test_held_out_rows(spark, network):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels").toPandas().set_index("doc_id").quality
    got = at.score(docs, network).toPandas().set_index("doc_id")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.iterrows())
    assert (got.predicted == (got.score >= 0.3)).all()
    own = got[got.held_out].join(labels, how="inner")
    assert len(own) > 40 and (own.predicted == own.quality).mean() > 0.95


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark, network):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    from pyspark.sql import functions as F

    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = at.train(docs.withColumns({"lang": F.lit("zz"), "quality": F.lit(0)}), wrong)
    assert all(np.array_equal(getattr(network, k), getattr(again, k)) for k in network.LEARNED)


def test_edges(spark, network):
    rows = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "word " * 50_000, "x"), (2, "word " * 50_000, "x")], "doc_id long, text string, score string")
    got = sorted((tuple(r) for r in at.score(rows, network).collect()), key=str)
    assert len(got) == 4 and all(0 <= r[2] <= 1 for r in got) and got[1][2] == got[2][2] and got[0][2] == got[3][2]
    assert at.score(rows.limit(0), network).collect() == []
    none = at.train(rows, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and {r.score for r in at.score(rows, None).collect()} == {0.5}
    assert at.keep_good(rows, None).count() == 4


def test_every_passage_counts_while_fitting(spark):
    """Labels that only passages from the forty-ninth on tell apart, in texts of 64 and in ids that repeat."""
    plain, odd = "some plain words of no account. " * 14, "####|||| !!!! 0000 **** ---- " * 16
    rows = [(i, plain * 50 + (odd if i % 2 else plain) * 2 + plain * 12) for i in range(80)]
    docs = spark.createDataFrame(rows + rows[:6], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    network = at.train(docs, labels)
    scores = {r.doc_id: r.score for r in at.score(docs, network).collect()}
    assert min(s for i, s in scores.items() if i % 2 == 0) > max(s for i, s in scores.items() if i % 2)
