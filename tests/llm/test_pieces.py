"""Encoding and decoding against the library itself."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from freshet.llm import pieces

TEXTS = [None, "", " ", "  ", "Hello wörld.\nIt's 42　<0x41></s>▁x\x00 \U0001f600İ", "the " * 4000, "x" * 20000, " " * 9000, "…—…" * 100, "日本語 текст данных", "twice", "twice"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def words():
    return pieces.vocabulary()


def test_random_texts(library, words):
    own, rng = pieces.Codec(words), random.Random(3)
    alphabet = [*"abcdeinorst  \t\n.,'0123▁éßжи日本\U0001f600İ\x00\x01<>x_/=-", "  ", "    ", "the", "ing", "<0x41>", "</s>", "<unk>", *(p for p in words.pieces if rng.random() < 0.02)]
    for _ in range(15000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert own.encode(text) == library.encode(text), text
        assert own.decode(own.encode(text)) == library.decode(library.encode(text))


def test_random_ids(library, words):
    own, rng = pieces.Codec(words), random.Random(4)
    for _ in range(8000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(4)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_without_cuts_and_with_little_memory(library, words, monkeypatch):
    for name in ("KEPT_RUNS", "KEPT_PAIRS"):
        monkeypatch.setattr(pieces, name, 5)
    own, rng = pieces.Codec(words), random.Random(5)
    own.runs = None
    for _ in range(500):
        text = "".join(rng.choices(["the ", "in", "g", "  ", ".\n", "é", "ж", "0", "\U0001f600"], k=40))
        assert own.encode(text) == library.encode(text), text


def test_every_pair_is_what_merging_gives(words):
    """The answer read off the histories is that of merging the joined text."""
    own, rng = pieces.Codec(words), random.Random(6)
    normal = [p for p in own.id if len(p) <= 5]
    tried = 0
    for _ in range(20000):
        a, b = rng.choice(normal), rng.choice(normal)
        if own.history(a) is None or own.history(b) is None:
            continue
        parts = list(a + b)
        while True:
            best, at = max(((own.score.get(x + y, float("-inf")), -i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(float("-inf"), 0))
            if best == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        assert own.side_by_side(a, b) == (parts == [a, b])
        tried += 1
    assert tried > 15000


def test_tables(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y")], "doc_id long, text string, ids string").repartition(3)
    wanted = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs)).collect()}
    digests = {r.doc_id: r for r in pieces.digests(docs).collect()}
    assert got.keys() == digests.keys() == wanted.keys()
    for key, text in wanted.items():
        ids = library.encode(text)
        assert list(got[key].ids) == ids
        assert got[key].text == library.decode(ids)
        assert digests[key].n_tokens == len(ids)
        assert digests[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[key].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_table_and_odd_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.digests(empty).collect() == []
    odd = spark.createDataFrame([(1, [28705, None, -4, 99999, 264]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(odd).collect()} == {1: " a", 2: ""}
