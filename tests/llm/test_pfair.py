"""Schedules against their definition, mixtures against brute force."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from freshet.llm import pfair


@pytest.mark.parametrize("shares", [[1], [1, 1], [3, 1], [7, 2, 1], [500, 300, 199, 1], [1] * 9 + [91]])
def test_less_than_one_block_off_at_any_time(shares):
    slots, period, had = pfair.schedule(shares), sum(shares), Counter()
    for t, s in enumerate(slots, 1):
        had[s] += 1
        assert all(abs(had[i] * period - t * q) < period for i, q in enumerate(shares))
    assert [had[i] for i in range(len(shares))] == shares


def test_plan_uses_every_block_once_and_keeps_to_the_weights():
    blocks, weights = {"a": 70, "b": 11, "c": 400, "d": 0}, {"a": 5.0, "b": 3.0, "c": 2.0, "d": 9.0}
    rows = pfair.plan(blocks, weights, 10)
    taken = {}
    for s, phase, lo, hi, share, first, places, target in rows:
        for k in range(lo, hi):
            slot = first + (k - lo) // share * 10 + places[(k - lo) % share]
            assert slot not in taken
            taken[slot] = (s, phase, share)
    assert sorted(taken) == list(range(sum(blocks.values())))
    assert Counter(s for s, _, _ in taken.values()) == {s: n for s, n in blocks.items() if n}
    start, had, phase = 0, Counter(), 0
    for t in range(len(taken)):
        s, p, _ = taken[t]
        if p != phase:
            start, had, phase = t, Counter(), p
        had[s] += 1
        for q in [r for r in rows if r[1] == p]:
            assert abs(had[q[0]] * 10 - (t + 1 - start) * q[4]) < 10


def test_mix_keeps_every_row(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(0, 300), rng.choice(["big", "big", "b", None]), "k") for i in range(400)]
    rows += [(7, "dup", "big", "k"), (7, "dup", "big", "k"), (None, None, "b", "k"), (900, "y" * 5000, "b", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix string").repartition(4)
    got = pfair.mix(docs, {"big": 3.0, "b": 1.0}, block_chars=1000, period=20, max_sources=5).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(r[:3] for r in rows)
    # a source's documents follow each other without a gap, and blocks are where the text begins
    for s in {"big", "b", ""}:
        own = sorted(((r.mix.block * 1000 + r.mix.place, max(1, len(r.text or ""))) for r in got if r.mix.source == s))
        at = 0
        for begin, size in own:
            assert begin == at
            at += size
    slots = {}
    for r in got:
        slots.setdefault(r.mix.slot, set()).add((r.mix.source, r.mix.block))
    assert all(len(v) == 1 for v in slots.values())


def test_small_sources_are_pooled_and_empty(spark):
    docs = spark.createDataFrame([(i, "t" * (i + 1), f"s{i}") for i in range(9)], "doc_id long, text string, source string")
    got = pfair.mix(docs, block_chars=4, max_sources=3, period=10).collect()
    assert len(got) == 9 and Counter(r.mix.source for r in got) == {"s8": 1, "s7": 1, "s6": 1, "": 6}
    assert pfair.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "blocks,weights",
    [
        ({f"s{i}": 100 + 90 * i for i in range(20)}, {f"s{i}": (100 + 90 * i) ** 0.5 for i in range(20)}),
        ({"big": 20_000, **{f"s{i}": 40 for i in range(100)}}, {"big": 0.9, **{f"s{i}": 0.001 for i in range(100)}}),
        ({"a": 1, "b": 1, "c": 7, "d": 0}, {"a": 1.0, "b": 1.0, "c": 0.1, "d": 5.0}),
    ],
)
def test_less_than_one_block_off_the_exact_target(blocks, weights):
    rows = list(pfair.exact_schedule(blocks, weights))
    assert [r[2] for r in rows] == list(range(sum(blocks.values())))
    exact = {s: Fraction(w) for s, w in weights.items() if blocks[s]}
    had, due, seen = Counter(), dict.fromkeys(exact, Fraction(0)), 0
    for s, k, _, phase, target in rows:
        assert k == had[s]
        had[s] += 1
        # the fluid, step by step: one slot is shared by all that have blocks left
        rest = Fraction(1)
        while rest:
            active = [x for x in exact if due[x] < blocks[x]]
            total = sum(exact[x] for x in active)
            step = min(rest, min((blocks[x] - due[x]) * total / exact[x] for x in active))
            for x in active:
                due[x] += step * exact[x] / total
            rest -= step
        assert all(abs(had[x] - due[x]) < 1 for x in exact)
        seen += 1
        if seen > 3000:
            break
    first = sum(weights[s] for s in exact)
    assert all(r[4] == pytest.approx(weights[r[0]] / first) for r in rows if r[3] == 0)


def test_every_source_has_its_own_row(spark):
    docs = spark.createDataFrame([(i, "t" * (1 + i % 3), f"s{i % 600}" if i else None) for i in range(1300)], "doc_id long, text string, source string")
    got = pfair.mix(docs, block_chars=4).collect()
    assert len(got) == 1300 and all(r.mix.source == (r.source or "") for r in got)
    assert len({r.mix.slot for r in got}) == len({(r.mix.source, r.mix.block) for r in got})


def test_columns_with_names_used_inside(spark):
    names = ["p_slot", "p_source", "p_block", "o_source", "o_upto", "o_chunk", "o_before", "o_id", "row", "mix"]
    rows = [(i, "x" * (i % 7), f"s{i % 2}", *(f"{n} {i}" for n in names)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = pfair.mix(docs, name="place in the mixture")
    assert got.columns == [*docs.columns, "place in the mixture"]
    assert sorted(tuple(r)[:-1] for r in got.collect()) == sorted(rows)
    want = {r.doc_id: tuple(r.mix) for r in pfair.mix(docs.select("doc_id", "text", "source")).collect()}
    assert {r.doc_id: tuple(r[-1]) for r in got.collect()} == want
