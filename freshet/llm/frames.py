"""Fill-in-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of at most ``frame_units`` code points, with the
cumulative unit counts beside them. A range of the text is then a run of frames: the frames inside
it are taken over as they are, and only the one or two frames that a cut goes through are opened,
cut and compressed anew. The output text is stored the same way, its markers being frames of their
own, so a rearranged text is never whole in memory; digests stream its frames in order.

Each row is taken by itself: no shuffle, and a lost task is simply run again. Null texts are empty,
empty texts are plain, a null id is hashed as the empty text. Repeated rows are cut each, at the same
places if their ids are the same. Other columns are not carried, so none can clash. Texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import give_back, in_batches, texts

FRAME_UNITS = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"

_STORED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("upto", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))])
_OUTPUT = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("upto", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


class Stored(NamedTuple):
    """Frames of a text and, for each, the units up to its end."""

    upto: Sequence[int]
    frames: Sequence[bytes]


class Shelf:
    """Compression contexts of a task; the frame opened last stays open, as neighbouring cuts often share it."""

    def __init__(self, level: int = 3):
        import zstandard

        self._pack = zstandard.ZstdCompressor(level=level).compress
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._open: tuple[bytes, str] = (b"", "")
        self.marker = {m: self.pack(m) for m in MARKERS}

    def pack(self, text: str) -> bytes:
        return self._pack(text.encode("utf-8"))

    def raw(self, frame: bytes) -> bytes:
        return self._unpack(frame)

    def opened(self, frame: bytes) -> str:
        if self._open[0] is not frame:
            self._open = frame, self.raw(frame).decode("utf-8")
        return self._open[1]

    def store(self, text: str, units: int) -> Stored:
        parts = [text[i : i + units] for i in range(0, len(text), units)]
        return Stored(list(accumulate(map(len, parts))), list(map(self.pack, parts)))

    def select(self, kept: Stored, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(units, frame) of a range: frames inside it as they are, cut ones compressed anew."""
        i = bisect_right(kept.upto, start)
        while start < end:
            begin, stop = kept.upto[i - 1] if i else 0, kept.upto[i]
            if begin == start and stop <= end:
                yield stop - start, kept.frames[i]
            else:
                yield min(stop, end) - start, self.pack(self.opened(kept.frames[i])[start - begin : end - begin])
            start, i = stop, i + 1

    def read(self, kept: Stored, start: int, end: int) -> Iterator[str]:
        """The text of a range, frame by frame."""
        i = bisect_right(kept.upto, start)
        while start < end:
            begin, stop = kept.upto[i - 1] if i else 0, kept.upto[i]
            yield self.opened(kept.frames[i])[max(start - begin, 0) : end - begin]
            start, i = stop, i + 1

    def arrange(self, kept: Stored, form: str, a: int, b: int) -> Stored:
        """The frames of the output text."""
        if form == PLAIN:
            return kept
        n = kept.upto[-1]
        prefix, middle, suffix = (0, a), (a, b), (b, n)
        order = ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)) if form == PSM else ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))
        sizes, frames = [], []
        for marker, part in order:
            sizes.append(len(marker))
            frames.append(self.marker[marker])
            for units, frame in self.select(kept, *part):
                sizes.append(units)
                frames.append(frame)
        return Stored(list(accumulate(sizes)), frames)

    def places(self, out: Stored, form: str) -> list[int]:
        """Unit offsets of the three markers of an output text, found by streaming its frames once."""
        wanted = list(MARKERS) if form == PSM else [SUFFIX, PREFIX, MIDDLE]
        found, tail, at = [], "", 0  # at: units before the tail
        for frame in out.frames:
            now = tail + self.opened(frame)
            i = 0
            while len(found) < 3 and (j := now.find(wanted[len(found)], i)) >= 0:
                found.append(at + j)
                i = j + 3
            rest = max(i, len(now) - 2)  # a marker may begin in the last two units
            at, tail = at + rest, now[rest:]
        return found

    def restored(self, out: Stored, form: str) -> Iterator[str]:
        """The original text, part by part, from an output text and its form."""
        n = out.upto[-1] if out.upto else 0
        if form == PLAIN:
            yield from self.read(out, 0, n)
            return
        one, two, three = self.places(out, form)
        first, second, middle = (one + 3, two), (two + 3, three), (three + 3, n)
        for part in (first, middle, second) if form == PSM else (second, middle, first):
            yield from self.read(out, *part)


def digest(parts: Iterator[bytes]) -> str:
    whole = hashlib.sha256()
    for p in parts:
        whole.update(p)
    return whole.hexdigest()


def store(docs: DataFrame, frame_units: int = FRAME_UNITS) -> DataFrame:
    """(doc_id, n, marked, upto array<long>, frames array<binary>): every text as frames.

    n: code points; marked: whether the text holds a marker itself.
    """
    if frame_units < 1:
        raise ValueError("a frame holds at least one unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf()

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    kept = shelf.store(text, frame_units)
                    yield sum(map(len, kept.frames)), (key, len(text), any(m in text for m in MARKERS), kept.upto, kept.frames)

        yield from in_batches(rows(), _STORED)
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, n long, marked boolean, upto array<long>, frames array<binary>")


def _draw(key: Column, group: int, salt: str) -> Column:
    """One of the 8-digit groups of the hex sha256 of ``salt:key`` as a number."""
    hexed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hexed, 8 * group + 1, 8), 16, 10).cast("long")


def plan(stored: DataFrame, rate: int = 90, spm_rate: int = 20, salt: str = "1") -> DataFrame:
    """The stored rows with form and cuts: prefix is [0, a), middle [a, b); both null if plain.

    Draws depend on the id alone: of a hundred documents ``rate`` are transformed, of a hundred of
    those ``spm_rate`` put the suffix first.
    """
    h = [_draw(F.col("doc_id"), g, salt) for g in range(4)]
    left, right = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate)
    form = F.when(plain, PLAIN).when(h[3] % 100 < spm_rate, SPM).otherwise(PSM)
    return stored.withColumns({"form": form, "a": F.when(~plain, F.least(left, right)), "b": F.when(~plain, F.greatest(left, right))})


def transform(planned: DataFrame) -> DataFrame:
    """(doc_id, form, upto, frames) of the output texts, as frames again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf()

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    key, form, a, b, upto, frames = (c[i].as_py() for c in batch.columns)
                    out = shelf.arrange(Stored(upto, frames), form, a, b)
                    yield sum(map(len, out.frames)), (key, form, out.upto, out.frames)

        yield from in_batches(rows(), _OUTPUT)
        give_back()

    return planned.select("doc_id", "form", "a", "b", "upto", "frames").mapInArrow(run, "doc_id long, form string, upto array<long>, frames array<binary>")


def _joined(rows: DataFrame, parts) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf()

        def out():
            for batch in batches:
                for i in range(batch.num_rows):
                    key, form, upto, frames = (c[i].as_py() for c in batch.columns)
                    text = "".join(parts(shelf, Stored(upto, frames), form))
                    yield len(text), (key, text)

        yield from in_batches(out(), _TEXT)
        give_back()

    return rows.select("doc_id", "form", "upto", "frames").mapInArrow(run, "doc_id long, text string")


def output_texts(transformed: DataFrame) -> DataFrame:
    """(doc_id, text): the output texts, written out."""
    return _joined(transformed, lambda shelf, out, form: map(shelf.opened, out.frames))


def restore(transformed: DataFrame) -> DataFrame:
    """(doc_id, text): the original texts, from output and form alone."""
    return _joined(transformed, lambda shelf, out, form: shelf.restored(out, form))


def digests(planned: DataFrame) -> DataFrame:
    """One row per document: cuts, digest of the output and of the text restored from it.

    The frames are rearranged as by ``transform`` and streamed in order, without leaving the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf()

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    key, n, form, a, b, upto, frames = (c[i].as_py() for c in batch.columns)
                    out = shelf.arrange(Stored(upto, frames), form, a, b)
                    said = digest(map(shelf.raw, out.frames))
                    back = digest(p.encode("utf-8") for p in shelf.restored(out, form))
                    yield 256, (key, n, form, a, b, said, back)

        yield from in_batches(rows(), _DIGESTS)
        give_back()

    made = planned.select("doc_id", "n", "form", "a", "b", "upto", "frames").mapInArrow(run, "doc_id long, n long, form string, a long, b long, output_sha256 string, restored_sha256 string")
    return made.select("doc_id", "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), "output_sha256", "restored_sha256")


#: The same rows by another engine.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST(('0x' || h[1:8]) AS UBIGINT) AS h1, CAST(('0x' || h[9:16]) AS UBIGINT) AS h2, CAST(('0x' || h[17:24]) AS UBIGINT) AS h3, CAST(('0x' || h[25:32]) AS UBIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b FROM d),
p AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1, n - b) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""
