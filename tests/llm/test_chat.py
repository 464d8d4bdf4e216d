"""Windows against a plain reading of the conversations."""

import hashlib
import random

import pytest

from freshet.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window int"


def rows():
    rng = random.Random(3)
    out = []
    for conv in range(6):
        turns = [("system", "be [kind] \\0 </s>")] if conv % 2 else []
        for i in range(rng.randrange(1, 30)):
            turns.append((("user", "assistant")[i % 2], " ".join(rng.choice(["a", "<s>", "[x]", "\\1", "é😀", "\\"]) for _ in range(rng.randrange(0, 40)))))
        out += [(conv, t, r, x, 1) for t, (r, x) in enumerate(turns)]
    out += [(50, 0, "assistant", "word " * 900, 1), (50, 1, "assistant", None, 1), (50, 1, "assistant", None, 1), (50, 5000, None, "tail", 1)]
    out += [(60, None, "assistant", "no turn", 1), (60, 3, "tool]x", "t", 1), (None, 0, "user", "</s>[INST] ok [/INST]", 1), (None, 1, "assistant", "</s>[INST] ok [/INST]", 1)]
    return out


def plain(data):
    convs = {}
    for c, t, r, x, _ in data:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (said, loss)]
        out[c] = (len(turns), sha[0], len(loss), sha[1])
    return out


@pytest.mark.parametrize("budget,history", [(512, 128), (40, 20), (30, 0)])
def test_digests(spark, budget, history):
    data = rows()
    made = chat.windows(spark.createDataFrame(data, SCHEMA), budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == plain(data)


def test_windows_repeat_limited_history_and_the_system_turn(spark):
    data = [(1, 0, "system", "sys", 0)] + [(1, i, ("assistant", "user")[i % 2], f"w{i} a b c d e", 0) for i in range(1, 12)]
    made = sorted(chat.windows(spark.createDataFrame(data, SCHEMA), 60, 20).collect(), key=lambda r: r.window)
    assert len(made) > 2
    for r in made:
        assert r.formatted.startswith("<s>[system]sys</s>")
        assert r.formatted.count("</s>") == r.n_turns
        lost = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert lost and all(x.startswith("w") and int(x.split()[0][1:]) % 2 == 0 for x in lost)
    # system and two turns of ten tokens; where four turns are new, the budget leaves room for one
    assert [(r.n_turns, r.n_repeated) for r in made] == [(5, 0), (6, 3), (6, 2)]


@pytest.mark.parametrize("budget,history", [(60, 20), (30, 15), (16, 8), (9, 0)])
def test_no_window_exceeds_its_budget(spark, budget, history):
    rng = random.Random(budget)
    data = []
    for conv in range(40):
        turns = ["system"] * (conv % 3 == 0) + [rng.choice(["user", "assistant"]) for _ in range(rng.randrange(0, 25))]
        data += [(conv, t, r, f"t{t} " + "w " * rng.choice([0, 1, 3, 9, 20, 70]), 0) for t, r in enumerate(turns)]
    made = {}
    for r in chat.windows(spark.createDataFrame(data, SCHEMA), budget, history).collect():
        turns = [t.split("]", 1) for t in r.formatted[len("<s>") :].split("</s>")[:-1]]
        sizes = [len(text.split()) + 4 for _, text in turns]
        assert r.n_tokens == sum(sizes)
        system = sizes[0] if turns[0][0] == "[system" else 0
        own = [s for s, old in zip(sizes, r.repeats) if not old]
        if r.over_budget:
            # one turn that does not fit, beside the system turn
            assert len([s for s, (role, _) in zip(sizes, turns) if role != "[system"]) <= 1 and system + max(own) > budget
        else:
            assert r.n_tokens <= budget
        repeated = sum(s for s, old, (role, _) in zip(sizes, r.repeats, turns) if old and role != "[system")
        assert repeated <= history
        made.setdefault(r.conv_id, []).append((r.window, [int(text.split()[0][1:]) for _, text in turns], r.repeats))
    for conv in {d[0] for d in data}:
        found = sorted(made[conv])
        has_system = data[[d[0] for d in data].index(conv)][2] == "system"
        new = [n for _, turns, old in found for n, o in zip(turns, old) if not o]
        assert new == [d[1] for d in data if d[0] == conv]
        for _, turns, old in found:
            run = turns[1:] if has_system and turns[0] == 0 else turns
            assert run == list(range(run[0], run[0] + len(run))) if run else True
            assert not has_system or turns[0] == 0


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.windows(empty)).collect() == []
