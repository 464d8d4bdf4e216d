"""Plain identifiers against the patterns themselves; disguised ones at their places."""

import hashlib
import random
import re
import time

import pytest

from freshet.llm import pii


def plain(text):
    """By the patterns, without any shortcut."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_plain_spans_on_random_texts():
    rng = random.Random(1)
    alphabet = list("ab0123456789") * 2 + list("@@..+-()% _é\n") + ["a@b.c", "1.2.3.4", "+1 (375) 555-4393", "4207051279108084", "4111 1111 1111 1111"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        assert [s[:3] for s in pii.spans(text) if s[3]] == plain(text), text


DISGUISED = [
    ("email", "reach ", "jane [at] mail [dot] example [dot] com", " now"),
    ("email", "write to ", "jane.doe at example dot com", ", please"),
    ("email", "", "jane(at)example.com", ""),
    ("email", "x ", "jаne@exаmple.com", " y"),  # two Cyrillic letters
    ("email", "x ", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", " y"),
    ("email", "é ", "ja​ne@exam​ple.com", " y"),
    ("email", "x ", "jane @ example.com", " y"),
    ("ip", "host ", "10[.]0[.]0[.]7", " up"),
    ("ip", "host ", "one nine two dot one six eight dot zero dot seven", " up"),
    ("ip", "host ", "１９２.168.0.1", " up"),
    ("card", "pay ", "four one one one, one one one one, one one one one, one one one one", " ok"),
    ("card", "pay ", "4lll 1111 1111 1111", " ok"),
    ("card", "pay ", "4111–1111–1111–1111", " ok"),
    ("card", "zahl ", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", " ok"),
    ("phone", "call ", "plus one three seven five five five five four three nine three", " soon"),
    ("phone", "call ", "+1 (375) five five five four three nine three", " soon"),
    ("phone", "call ", "+1 (375) 555-439O", " soon"),
    ("phone", "call ", "plus one three seven five triple five four three nine three", " soon"),
]

# in plain texts without any other disguise
ALONE = [
    ("email", "x ", "jane{@}example.com", " y"),
    ("email", "x ", "jane<@>example.com", " y"),
    ("email", "x ", "jane{ at }example.com", " y"),
    ("email", "x ", "jane@example<.>com", " y"),
    ("email", "x ", "jane@example{punto}com", " y"),
    ("ip", "host ", "one.two.three.four", " up"),
    ("ip", "host ", "192.168.one.two", " up"),
    ("phone", "call ", "+1 800 555 five five five five", " soon"),
]


@pytest.mark.parametrize("kind,before,it,after", [*DISGUISED, *ALONE])
def test_disguises_do_not_depend_on_their_neighbours(kind, before, it, after):
    text = before + it + after
    assert (kind, it) in [(k, text[a:b]) for k, a, b, base in pii.spans(text) if not base]
    assert pii.spans(text) == pii.spans(text, lambda _: True)
    both = text + " . and x [dot] y"
    assert (kind, it) in [(k, both[a:b]) for k, a, b, base in pii.spans(both) if not base]


def test_few_spelled_digits_beside_plain_numbers():
    assert pii.spans("host 10.0.0.1 one of two") == [("ip", 5, 13, True)]
    assert [s[:3] for s in pii.spans("host 10[.]0[.]0[.]7 one of two")] == [("ip", 5, 19)]


def test_spans_with_the_prefilter_and_without():
    rng = random.Random(8)
    parts = "jane example com at dot AT Dot punto point arroba @ . [ ] ( ) { } < > one two five fIve ſix double plus + - , 1 192 555 10.0.0 4111 1111 l1 O O5 é « a".split() + [" ", " ", "  ", "\t", "\n"]
    for _ in range(30000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "", ".", "@"]) for _ in range(rng.randrange(1, 16)))
        assert pii.spans(text) == pii.spans(text, lambda _: True), text


@pytest.mark.parametrize("text", ["İ192.168.1.1l", ",+1 800 555 0199Oİ2…", "ſ10.0.0.O1", "ı4111 1111 1111 111l"])
def test_letters_that_fold_to_others(text):
    assert pii.spans(text) == pii.spans(text, lambda _: True)


def test_letters_that_fold_with_the_prefilter_and_without():
    rng = random.Random(21)
    for _ in range(60000):
        text = "".join(rng.choices("İıſ0189OIl.+- ()@a:…", k=rng.randrange(6, 26)))
        assert pii.spans(text) == pii.spans(text, lambda _: True), text


@pytest.mark.parametrize("kind,before,it,after", DISGUISED)
def test_disguises(kind, before, it, after):
    text = before + it + after
    got = [(k, text[a:b]) for k, a, b, base in pii.spans(text) if not base]
    assert (kind, it) in got, got


@pytest.mark.parametrize(
    "text",
    [
        "We met at noon. The dot over the i is small, and at home a dot comes.",
        "one two three four words, one at a time",
        "version 1.2.3 of 2024-01-02, 12 345 678 people; see section 10.2",
        "un deux trois soleil, six sept huit",
        "Привет мир, как дела? αβγ δε",
        "he said (at last) it was done [p. 12]",
        "look at example.com for it",
    ],
)
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == []


@pytest.mark.parametrize("unit", ["1", "1.", "+1", "a@", "@", "+1(", "one ", "a.", "at ", " dot ", "（", "O1", "x [at] "])
def test_long_runs_are_linear(unit):
    begun = time.time()
    pii.spans(unit * (200_000 // len(unit)))
    assert time.time() - begun < 20


def test_tables(spark):
    rows = [(1, "a@b.co and a [at] b [dot] co", "c"), (2, None, "c"), (3, "", "c"), (1, "a@b.co", "c"), (None, "+1 (375) 555-4393 ok", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in pii.digests(pii.detect(docs)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted(
        [
            (1, 1, 0, 0, 0, sha("email:0:6"), "email:0:6,email:11:28", 1),
            (2, 0, 0, 0, 0, sha(""), "", 0),
            (3, 0, 0, 0, 0, sha(""), "", 0),
            (1, 1, 0, 0, 0, sha("email:0:6"), "email:0:6", 0),
            (None, 0, 0, 0, 1, sha("phone:0:17"), "phone:0:17", 0),
        ],
        key=str,
    )
    masked = {(r.doc_id, r.text) for r in pii.redact(docs).collect()}
    assert masked == {(1, "[EMAIL] and [EMAIL]"), (2, None), (3, ""), (1, "[EMAIL]"), (None, "[PHONE] ok")}
    assert pii.detect(docs.limit(0)).collect() == []
