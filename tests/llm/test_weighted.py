"""Collision rates against the generalised Jaccard similarity; edits against plain slicing."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from freshet.llm import weighted


def jaccard(a: str, b: str) -> float:
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys)


def test_collision_rate_is_the_similarity():
    rng = random.Random(6)
    sampler = weighted.Sampler(4096)
    for _ in range(12):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
        other = [w for w in words if rng.random() < 0.8] + [f"v{rng.randrange(60)}" for _ in range(rng.randrange(80))]
        a, b = " ".join(words), " ".join(other)
        assert abs((sampler.samples_of(a) == sampler.samples_of(b)).mean() - jaccard(a, b)) < 0.035


def test_order_case_and_memory_do_not_matter(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(2000))
    one = weighted.Sampler().hexadecimal(text)
    monkeypatch.setattr(weighted, "LIGHT", 100)
    monkeypatch.setattr(weighted, "HEAVY", 10)
    small = weighted.Sampler()
    small.hexadecimal("some other words before it")
    assert small.hexadecimal(" ".join(reversed(text.upper().split()))) == one
    long = " ".join(f"x{i}" for i in range(30_000))
    assert small.hexadecimal(long) == weighted.Sampler().hexadecimal(long)


def test_compared(spark):
    rng = random.Random(9)
    rows = [(i * 3, " ".join(rng.choice("abcdefgé😀") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60)))) for i in range(70)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "same text here"), (504, "same text here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, next_text string").repartition(5)
    got = {r.doc_id: r for r in weighted.compared(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    sampler = weighted.Sampler()
    same = lambda a, b: float(np.mean(sampler.samples_of(a) == sampler.samples_of(b)))
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == sampler.hexadecimal(t) and r.edited_fingerprint == sampler.hexadecimal(new)
        assert r.near_edited == same(t, new) and r.near_next == same(t, following)
    prints = {r.doc_id: r.fingerprint for r in weighted.fingerprints(docs).collect()}
    assert prints == {i: r.fingerprint for i, r in got.items()}
    assert prints[503] == prints[504] and prints[500] == prints[501] == prints[502]


def test_likeness_column(spark):
    a, b = "one two two three", "one two three four"
    s = weighted.Sampler()
    row = spark.createDataFrame([(s.hexadecimal(a), s.hexadecimal(b))], "a string, b string").select(weighted.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert row.l == float(np.mean(s.samples_of(a) == s.samples_of(b)))


def test_few_rows(spark):
    assert weighted.compared(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = weighted.compared(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next, r.n_chars) for r in one] == [(4, 1.0, 6)]
    ties = spark.createDataFrame([(None, "n"), (None, "m"), (2, "b"), (2, "b")], "doc_id long, text string")
    assert len(weighted.compared(ties).collect()) == 4


def test_order_over_many_partitions(spark):
    """2000 ranges of ids; every row is followed by that of the next smaller id."""
    docs = spark.range(6000).selectExpr("id * 3 as doc_id", "concat('text ', id) as text")
    rows = weighted.followed(docs, parts=2000)
    import zstandard

    read = lambda v: int(zstandard.ZstdDecompressor().decompress(bytes(v)).decode().split()[1])
    got = {r.doc_id: (read(r.text), read(r.next_text)) for r in rows.collect()}
    assert got == {3 * i: (i, (i - 1) % 6000) for i in range(6000)}
