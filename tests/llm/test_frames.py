"""Fill-in-middle over frames against plain slices of whole texts."""

import hashlib

import pytest

from freshet.llm import frames
from tests.compare import connect, differences

TEXTS = [None, "", "a", "short text", "naïve 日本 \U0001f600 text é́", "has <P> inside", "<S>", "x<M", "<<S", "P>S>M>", "<" * 50, "word " * 3000, "same", "same"]
SCHEMA = "doc_id long, text string, frames string, n string"


def expected(key, text, rate=90, spm_rate=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_rate else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("units", [1, 3, 4096])
def test_same_as_slices(spark, units):
    rows = [(100 * k + i, t) for k in range(6) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    planned = frames.plan(frames.store(docs, units), rate=95, spm_rate=40)
    got = sorted((tuple(r) for r in frames.digests(planned).collect()), key=str)
    want = []
    for key, text in rows:
        form, prefix, middle, out = expected(key, text, 95, 40)
        want.append((key, len(text or ""), form, prefix, middle, sha(out), sha(text or "")))
    assert got == sorted(want, key=str)
    made = frames.transform(planned)
    assert sorted((str(r.doc_id), r.text) for r in frames.output_texts(made).collect()) == sorted((str(k), expected(k, t, 95, 40)[3]) for k, t in rows)
    assert sorted((str(r.doc_id), r.text) for r in frames.restore(made).collect()) == sorted((str(k), t or "") for k, t in rows)


def test_frames_inside_a_range_are_taken_over():
    shelf = frames.Shelf()
    kept = shelf.store("0123456789" * 10, 10)
    out = list(shelf.select(kept, 5, 95))
    assert [u for u, _ in out] == [5, *[10] * 8, 5]
    assert all(f is g for (_, f), g in zip(out[1:-1], kept.frames[1:-1]))
    assert "".join(shelf.read(kept, 37, 62)) == ("0123456789" * 10)[37:62]


def test_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert differences(frames.digests(frames.plan(frames.store(docs))), connect(folder), frames.ORACLE) == []


def test_empty_table_and_wrong_size(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert frames.digests(frames.plan(frames.store(empty))).collect() == []
    with pytest.raises(ValueError):
        frames.store(empty, 0)
