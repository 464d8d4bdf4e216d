"""Counts and base scores by brute force; probabilities that add up; mixing against a plain loop."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from freshet.llm import mixing as m
from freshet.llm.blocks import code_blocks
from freshet.llm.common import table, texts


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    return [w for w in low.split(" ") if w] + [None]


def learns(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def sample():
    rng = random.Random(8)
    vocabulary = [f"W{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "é  É x\x0by\x1cz"), (7, rows[7][1]), (None, "some text W1"), (203, "w1 " * 3000)]


def test_base_scores(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, learn boolean").repartition(3)
    counts = Counter(w for i, t in rows if learns(i) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        own = words_of(t)
        want.append((i, not learns(i), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    got = m.scores(docs).collect()
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5] and math.isclose(a.base_score, b[5], rel_tol=1e-9)
        assert -1e6 < a.score < 0 and (a.bits_per_byte > 0 if a.n_tokens > 1 else a.bits_per_byte is None or a.doc_id not in (200, 201))
    twice = [r.score for r in got if r.doc_id == 7]
    assert twice[0] == twice[1]
    again = {(str(r.doc_id), r.n_tokens): r.score for r in m.scores(docs.repartition(1)).collect()}
    assert all(math.isclose(again[str(r.doc_id), r.n_tokens], r.score, rel_tol=1e-6) for r in got)


def test_better_than_the_base_on_held_out_texts(spark):
    got = m.scores(table(spark, "/root/testdata/sf0.01", "documents")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > 0.85 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.9


def shape_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = code_blocks(texts(docs), m.tokens).mapInArrow(m._parts(4), m.PARTS)
    return m.tree(parts.groupBy("bucket").applyInArrow(m._counted, m.COUNTED))


@pytest.mark.parametrize("most", [None, 16 * 64])
def test_probabilities_add_up(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(m, "sizes_for", lambda n: (most, 21))
    rows = sample()
    shape = shape_of(spark, rows)
    assert most is None or (shape.top, shape.slot_bits, len(shape.class_counts)) == (most, 21, 64)
    assert math.isclose(sum(2.0 ** -int(s) for s in shape.sizes), 1)
    counts = Counter(m.END if w is None else w for i, t in rows if learns(i) for w in words_of(t))
    shares = Counter()
    for w, c in counts.items():
        leaf, share = shape.leaf(w, c)
        shares[leaf] += 10**share
    shares[shape.leaf("never seen", 0)[0]] += 10 ** shape.leaf("never seen", 0)[1]
    assert all(math.isclose(s, 1) for s in shares.values())
    assert np.allclose((10**shape.spelling).sum(1), 1)


def test_slot_counts(spark):
    rng = random.Random(1)
    texts_ = [[rng.randrange(0, 6) for _ in range(rng.randrange(1, 90))] for _ in range(40)]
    shape = shape_of(spark, sample())
    coded = spark.createDataFrame([(i % 3 > 0, bytes(np.array(t, np.uint16).tobytes())) for i, t in enumerate(texts_)], "learn boolean, leaves binary").repartition(4)
    got = m.slot_tables(coded, shape)
    want = Counter()
    for i, t in enumerate(texts_):
        if i % 3:
            bits, _, slots, _ = m.expand(np.array(t), np.array([0]), shape)
            for k in range(m.ORDERS):
                want.update((k, int(s), int(b)) for s, b in zip(slots[k], bits))
    assert {tuple(map(int, w)): int(got[tuple(w)]) for w in np.argwhere(got)} == want


@pytest.mark.parametrize("shared", [False, True])
def test_mixing_is_a_plain_loop_over_chunks(shared):
    rng = np.random.default_rng(3)
    sizes = [70, 5, 33]
    starts, n = np.cumsum([0, *sizes])[:-1], sum(sizes)
    token = np.repeat(np.arange(n), rng.integers(1, 5, n))
    size = len(token)
    x, gate, bits, depth = rng.standard_normal((size, m.ORDERS)).astype(np.float32), rng.integers(0, m.GATES, size), rng.integers(0, 2, size), rng.integers(0, 12, size)
    first = rng.random((m.GATES, m.ORDERS)) * 0.3
    got, weights = m.mixed(x, gate, bits, token, depth, starts, n, first, rate=0.05, shared=shared)
    doc = np.repeat(np.arange(3), sizes)[token]
    chunk = (token - starts[doc]) // m.CHUNK
    w = [first.copy()] * 3 if shared else [first.copy() for _ in range(3)]
    apm = [{} for _ in range(3)]
    total = np.zeros(3)
    for c in range(chunk.max() + 1):
        change, seen = [np.zeros_like(first) for _ in range(3)], [{} for _ in range(3)]
        for i in np.flatnonzero(chunk == c):
            d = doc[i]
            logit = float(x[i] @ w[d][gate[i]])
            p = 1 / (1 + math.exp(-logit))
            bucket = int(min(max(logit * 1.5 + m.BUCKETS / 2, 0), m.BUCKETS - 1))
            cell = (min(depth[i], 7), bucket)
            centre = 1 / (1 + math.exp(-(bucket - m.BUCKETS / 2 + 0.5) / 1.5))
            refined = 0.75 * p + 0.25 * apm[d].get(cell, centre)
            total[d] += math.log10(refined if bits[i] else 1 - refined)
            change[d][gate[i]] += 0.05 * (bits[i] - p) * x[i]
            seen[d].setdefault(cell, (centre, []))[1].append(bits[i])
        whole = sum(change)
        for d in range(3):
            if not shared:
                w[d] = w[d] + change[d]
            for cell, (centre, hits) in seen[d].items():
                old = apm[d].get(cell, centre)
                apm[d][cell] = old + (np.mean(hits) - old) * len(hits) / (len(hits) + 30)
        if shared:
            w = [w[0] + whole] * 3
    assert np.allclose(got, total, rtol=1e-3)
    assert np.allclose(weights, w[:1] if shared else w, atol=1e-3)


def coded_from(spark, texts_):
    rows = [(True, bytes(np.array(t, np.uint16).tobytes())) for t in texts_]
    return spark.createDataFrame(rows, "learn boolean, leaves binary").repartition(3)


def test_inputs_leave_out_the_own_occurrence(spark):
    rng = random.Random(2)
    texts_ = [[rng.randrange(0, 5) for _ in range(rng.randrange(1, 60))] for _ in range(9)]
    shape = shape_of(spark, sample())
    starts = np.cumsum([0, *map(len, texts_)])[:-1]
    bits, _, slots, _ = m.expand(np.concatenate([np.array(t) for t in texts_]), starts, shape)
    counts = np.zeros((m.ORDERS, 1 << shape.slot_bits, 2), np.uint32)
    for k, s in enumerate(slots):
        np.add.at(counts[k], (s, bits), 1)
    stretch, seen = zip(*map(m.without_own, counts))
    x, gate = m.inputs_without_own(stretch, seen, slots, bits)
    for i, bit in enumerate(bits.tolist()):
        hits = [[int(n) - (v == bit) for v, n in enumerate(counts[k, slots[k][i]])] for k in range(m.ORDERS)]
        assert np.allclose(x[i], [math.log((b + 0.4) / (a + 0.4)) for a, b in hits], atol=5e-3)
        levels = [(sum(h) > 0) + (sum(h) > 3) for h in hits[1:4]]
        assert gate[i] == levels[0] * 9 + levels[1] * 3 + levels[2]


def test_curvature_is_the_sum_over_bits():
    rng = np.random.default_rng(7)
    x, gate, bits = rng.standard_normal((400, m.ORDERS)).astype(np.float32), rng.integers(0, 4, 400), rng.integers(0, 2, 400)
    weights, total = rng.random((m.GATES, m.ORDERS)), np.zeros((m.GATES, m.ORDERS, 1 + m.ORDERS))
    m.curvature(x, gate, bits, weights, total)
    want = np.zeros_like(total)
    for row, g, y in zip(x.astype(float), gate, bits):
        p = 1 / (1 + math.exp(-float(row @ weights[g])))
        want[g, :, 0] += (y - p) * row
        want[g, :, 1:] += p * (1 - p) * np.outer(row, row)
    assert np.allclose(total, want, rtol=1e-3, atol=1e-3)


def test_first_weights_read_whole_texts_and_all_documents(spark):
    rng = random.Random(4)
    shape = shape_of(spark, sample())
    texts_ = [[rng.randrange(0, 6) for _ in range(40)] for _ in range(500)] + [[rng.randrange(0, 6) for _ in range(1400)]]
    weights = []
    for tail in ([], [0, 3] * 200):
        coded = coded_from(spark, [*texts_[:-1], texts_[-1][:1000] + tail])
        counts = m.slot_tables(coded, shape)
        weights.append(m.first_weights(coded, shape, counts))
        # the same on one partition: sums do not depend on how texts are dealt
        assert np.allclose(weights[-1], m.first_weights(coded.repartition(1), shape, counts), atol=1e-4)
    assert np.abs(weights[0] - weights[1]).max() > 1e-3
    # the derivative is near zero after a few more steps: they go to the largest likelihood
    total = np.zeros((m.GATES, m.ORDERS, 1 + m.ORDERS))
    more = m.first_weights(coded, shape, counts, steps=8)
    stretch, seen = map(np.stack, zip(*map(m.without_own, counts)))
    for batch in m._curvature(shape, stretch, seen, more)(iter(coded.select("leaves").toArrow().to_batches())):
        total.ravel()[batch.column("i").to_numpy()] = batch.column("v").to_numpy()
    rest = total[:, :, 0] - m.PULL * (more - m.START)
    assert np.abs(rest).max() < 1e-2 * max(1, np.abs(total[:, :, 1:]).max())


def test_sizes_follow_the_tokens():
    assert m.sizes_for(0) == m.sizes_for(1_000_000) == (m.TOP, m.SLOT_BITS)
    sizes = [m.sizes_for(n) for n in (10**6, 10**7, 4 * 10**7, 10**8, 10**9, 10**13)]
    assert sizes == sorted(sizes) and sizes[2][0] > m.TOP and sizes[2][1] > m.SLOT_BITS
    assert sizes[-1] == (m.MOST_TOP, m.MOST_SLOT_BITS)
    assert m.MOST_TOP + m.MOST_CLASSES + 1 <= 1 << 16 and all(m.MOST_CLASSES % (t // m.WORDS_A_CLASS) == 0 for t, _ in sizes)


def test_empty_table(spark):
    assert m.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = m.scores(spark.createDataFrame([(9, "only held out or not")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].n_tokens == 6


def test_sums_of_a_task_do_not_grow_with_its_buckets(spark):
    blocks = code_blocks(texts(spark.createDataFrame(sample(), "doc_id long, text string")), m.tokens)
    rows, shapes = [], []
    for buckets in (2, 40):
        counted = blocks.mapInArrow(m._parts(buckets), m.PARTS).groupBy("bucket").applyInArrow(m._counted, m.COUNTED)
        rows.append(m._sums(counted.where("block is null").coalesce(1)).count())
        shapes.append(m.tree(counted))
    assert rows[0] == rows[1] and shapes[0].leaf_of == shapes[1].leaf_of
    assert (shapes[0].class_counts == shapes[1].class_counts).all() and (shapes[0].spelling == shapes[1].spelling).all()


def test_tables_come_by_slices(spark):
    rng = random.Random(6)
    shape = shape_of(spark, sample())
    coded = coded_from(spark, [[rng.randrange(0, 30) for _ in range(rng.randrange(1, 200))] for _ in range(30)])
    counts = m.slot_tables(coded, shape)
    want = m.tables_of(counts, m.without_own, 2), m.tables_of(counts, m.with_own, 1)
    for a, b in zip(m.tables_by_slice(coded, shape), want, strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
    # half precision leaves the bits free that hold the levels
    (stretch, seen), slots = want[1], [np.arange(len(counts[0]))] * m.ORDERS
    x, gate = m.looked_up(m.joined(stretch, seen, 1), slots)
    assert (x.T == stretch).all() and (gate == m._gate([seen[k] for k in (1, 2, 3)])).all()


def test_words_at_once_are_words_one_by_one(spark):
    rows = sample()
    shape = shape_of(spark, rows)
    counts = Counter(m.END if w is None else w for i, t in rows if learns(i) for w in words_of(t))
    words = [*counts, "never", "\u00fc\u2028", m.END]
    n = np.array([*counts.values(), 0, 0, 0])
    leaf, share, spell = shape.leaves(words, n)
    for w, c, a, b, s in zip(words, n.tolist(), leaf, share, spell):
        assert (a, b) == shape.leaf(w, c)
        raw = [256 if v == 10 else v for v in b"\n" + w.encode() + b"\n"]
        assert math.isclose(s, 0 if c else sum(shape.spelling[v, u] for v, u in zip(raw, raw[1:])))
    for text in ("", " \t\x0b ", "A  b\x1cC\x85d\u2028E\u3000f\r\n", "\u0130 \u00c9"):
        assert m.tokens(text) == ["".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w) for w in re.findall(r"[^ \t-\r]+", text)] + [m.END]
