"""Conversation repair against every possible repair of small conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from freshet.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit of every row and up to two insertions between."""
    best = None

    def go(i, state, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda b: b[:2])
        if not re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or "-" for r, _ in out)):
            return
        if state < 2:
            for role in ("user", "assistant"):
                go(i, state + 1, cost + 5, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, 0, cost + 2, audit + "D", out)
            if fault in "-t":
                more = 5 * (fault == "t")
                go(i + 1, 0, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, 0, cost + 1 + more, audit + "R", [*out, (new, text)])

    go(0, 0, 0, "", [])
    return best


def faults(rows):
    """Rows of (turn, role, text) in order, with their first fault."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def report(rows):
    """What the operator should say of one conversation's (turn, role, text) rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marked = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, out = cheapest(marked)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(sum(f == k for _, _, f in marked) for k in "bdt"),
        sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def made_up(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 6)):
            at = rng.choice([turn, turn, turn, turn, None, 2 * turn])
            rows.append((conv, at, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(["Yes.", "No!", "and so", " ", "", None, "é?\t", "x ", "|.", "Yes."])))
    return rows


@pytest.mark.parametrize("initials", ["", *("".join(p) for n in (1, 2, 3) for p in product("suat", repeat=n))])
def test_agenda_finds_the_cheapest(initials):
    rng = random.Random(initials)
    for marks in {"-" * len(initials), *("".join(rng.choice("-bdt") for _ in initials) for _ in range(4))}:
        rows = [({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[c], f"text {i}", m) for i, (c, m) in enumerate(zip(initials, marks))]
        cost, audit, out = cheapest(rows)
        found = min((w[0] + repair.ENDS[q][0], w[1] + repair.ENDS[q][1]) for q, w in repair.ways(initials, marks, 0).items())
        assert found == (cost, audit)
        edits, roles, said = repair.applied([r for r, _, _ in rows], [t for _, t, _ in rows], audit, 0)
        assert list(zip(roles, said)) == out
        assert "".join(edits) == audit.replace("D", "")


@pytest.mark.parametrize("block_rows", [1, 2, 3, 512])
def test_report_of_made_up_conversations(spark, block_rows):
    rows = made_up(block_rows, 120)
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cost string").repartition(7)
    got = {r.conv_id: tuple(r)[1:] for r in repair.audits(frame, block_rows).collect()}
    assert got == {c: report(r) for c, r in by_conv.items()}


def test_whole_query_with_nulls_and_lost_conversations(spark):
    rows = [*made_up(9, 200), *((c, 0, "user", "Lost?") for c in range(1000, 1080)), (None, None, None, None), (None, 3, "user", "Hm."), (None, 3, "user", "Hm.")]
    after = {c: [] for c, *_ in rows}
    for conv, *row in damaged(rows):
        after[conv].append(tuple(row))
    got = {r.conv_id: tuple(r)[1:] for r in repair.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert any(not r for r in after.values())
    assert got == {c: report(r) for c, r in after.items()}


def test_one_long_conversation_in_many_blocks_and_tasks(spark):
    """Many blocks give what one block gives."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {t}.", "again.", "", f"cut {t}"])) for t in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    several = repair.audits(frame.repartition(5), 64).collect()
    one = repair.audits(frame.coalesce(1), 1 << 20).collect()
    assert several == one
    assert len(several[0].audit.replace("I", "")) == 3000


def test_repaired_rows(spark):
    rows = [(7, 0, "user", "Hello."), (7, 1, "user", "Still there?"), (7, 2, "assistant", "Yes.")]
    out = [(r.edit, r.role, r.text) for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("part", "block", "place").collect()]
    assert out == [("K", "user", "Still there?"), ("K", "assistant", "Yes.")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.damaged_and_repaired(empty).collect() == []
    assert repair.repair(empty).collect() == []
