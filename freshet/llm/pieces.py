"""SentencePiece encoding by a prefix table, for models whose pieces are made by merges.

Merging joins, again and again, the neighbours whose joint piece scores best, the leftmost first. Two
pieces may stand side by side in a result exactly if merging their joined text gives the same two pieces,
and a row of pieces is the result for a text exactly if all its neighbours may. So every prefix of a
text has one last piece: of the pieces that end there, which an automaton finds, the one that may stand
after the last piece of what lies before it. The ids are recovered backwards from the full prefix.

Whether two pieces may stand side by side is read off their merge histories: the merges of both happen
in the order of their scores, and the two may not if a merge across the border comes first at any moment.

Texts are first cut where no merge can reach across, as no piece has those two characters side by side
(a word before a space, a letter before a full stop). Such runs repeat, and a bounded memory of each
Python worker keeps their ids.
Characters without a piece are written as their bytes.

Null and empty texts have no ids; repeated rows are encoded each; texts of any length are read whole and a
run of any length is one table. Each row is taken by itself, without a shuffle. Other columns are not
carried, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freshet.llm.common import give_back, in_batches, texts

SPACE = "▁"
KEPT_CHARS, KEPT_RUNS, KEPT_PAIRS = 64, 1 << 18, 1 << 19  # what a worker remembers; results do not depend on it
_NEVER = float("-inf")

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Vocabulary(NamedTuple):
    """Pieces of a model by id; its size is fixed, so tasks may get a copy."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: bytes  # by id: n(ormal), b(yte), c(ontrol), u(nknown)


def vocabulary(path: str | None = None) -> Vocabulary:
    """The pieces of a model file, ``piece_bpe_32k.model`` of the public tokenizers by default."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " Ａ  Å①\t　x "
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("only models that leave texts as they are, but for spaces and one in front")
    n = model.vocab_size()
    if any(model.is_unused(i) for i in range(n)):
        raise ValueError("models with unused pieces are split further")
    kinds = bytes(ord("c" if model.is_control(i) else "u" if model.is_unknown(i) else "b" if model.is_byte(i) else "n") for i in range(n))
    if sum(k == ord("b") for k in kinds) != 256:
        raise ValueError("only models that write unknown characters as bytes")
    pieces = [model.id_to_piece(i) if kinds[i] != ord("u") else model.decode([i]) for i in range(n)]
    return Vocabulary(tuple(pieces), tuple(map(model.get_score, range(n))), kinds)


class History(NamedTuple):
    """How merging makes a piece: its outer symbols before, and after each merge with the merge's score."""

    first: str
    last: str
    lefts: tuple[tuple[float, str], ...]
    rights: tuple[tuple[float, str], ...]


def _runs(pieces) -> re.Pattern | None:
    """A pattern that cuts texts where no merge can reach across: between characters that are neighbours in no piece.

    Characters that are neighbours in some piece, directly or through others, form a class; a run is spaces
    and then characters of one class. None where a piece has a space after another character.
    """
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        return None
    above: dict[str, str] = {}

    def top(c: str) -> str:
        while (up := above.setdefault(c, c)) != c:
            above[c] = above.setdefault(up, up)
            c = above[c]
        return c

    for p in pieces:
        word = p.lstrip(SPACE)
        for x, y in zip(word, word[1:]):
            above[top(x)] = top(y)
    classes: dict[str, list[str]] = {}
    for c in sorted(above):
        classes.setdefault(top(c), []).append(c)
    sets = sorted(classes.values(), key=len, reverse=True)
    kinds = "|".join(f"[{''.join(map(re.escape, chars))}]+" for chars in sets)
    return re.compile(f"{SPACE}*(?:{kinds}|[^{SPACE}])|{SPACE}+" if kinds else f"{SPACE}*[^{SPACE}]|{SPACE}+")


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, words: Vocabulary):
        import ahocorasick

        normal = [i for i, k in enumerate(words.kinds) if k == ord("n")]
        self.pieces = words.pieces
        self.kinds = words.kinds
        self.id = {words.pieces[i]: i for i in normal}
        self.score = {words.pieces[i]: words.scores[i] for i in normal}
        self.byte = [0] * 256
        self.value = {}
        for i, k in enumerate(words.kinds):
            if k == ord("b"):
                self.byte[int(words.pieces[i][1:-1], 16)] = i
                self.value[i] = int(words.pieces[i][1:-1], 16)
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.runs = _runs(self.id)
        self.histories: dict[str, History | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def history(self, piece: str) -> History | None:
        """None for a piece that merging its own text does not give."""
        if piece not in self.histories:
            parts, lefts, rights = list(piece), [], []
            while len(parts) > 1:
                best, at = max((self.score.get(x + y, _NEVER), -i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if best == _NEVER:
                    break
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                lefts.append((best, parts[0]))
                rights.append((best, parts[-1]))
            self.histories[piece] = History(piece[0], piece[-1], tuple(lefts), tuple(rights)) if len(parts) == 1 else None
        return self.histories[piece]

    def _side_by_side(self, a: str, b: str) -> bool:
        before, after = self.history(a), self.history(b)
        if before is None or after is None:
            return False
        right, left, i, j = before.last, after.first, 0, 0
        while True:
            x = before.rights[i][0] if i < len(before.rights) else _NEVER
            y = after.lefts[j][0] if j < len(after.lefts) else _NEVER
            across = self.score.get(right + left, _NEVER)
            # equal scores: the leftmost merge comes first
            if across > x and across >= y:
                return False
            if x >= y and x != _NEVER:
                right, i = before.rights[i][1], i + 1
            elif y != _NEVER:
                left, j = after.lefts[j][1], j + 1
            else:
                return True

    def side_by_side(self, a: str | None, b: str) -> bool:
        """Whether b may follow a, or begin a text where a is None; remembered."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        fits = self.pairs[a, b] = self._side_by_side(a, b) if a else self.history(b) is not None
        return fits

    def last_pieces(self, run: str) -> list[str | None]:
        """The prefix table: the last piece of every prefix; None for the empty one."""
        table: list[str | None] = [None] * (len(run) + 1)
        lone = [] if self.id.keys() >= set(run) else [i for i, c in enumerate(run, 1) if c not in self.id]
        for i in lone:
            table[i] = run[i - 1]
        pairs = self.pairs
        done = 0
        for at, (piece, size) in self.automaton.iter(run):
            at += 1
            if at == done:
                continue
            before = table[at - size]
            fits = pairs.get((before, piece))
            if self.side_by_side(before, piece) if fits is None else fits:
                table[at] = piece
                done = at
        return table

    def _encode_run(self, run: str) -> list[int]:
        table, at, ids = self.last_pieces(run), len(run), []
        while at:
            piece = table[at]
            own = self.id.get(piece)
            if own is None:
                ids += [self.byte[b] for b in reversed(piece.encode("utf-8"))]
            else:
                ids.append(own)
            at -= len(piece)
        ids.reverse()
        return ids

    def _recall(self, run: str) -> list[int]:
        """Ids of a run that the newer memory does not hold."""
        ids = self.old.get(run)
        if ids is None:
            ids = self._encode_run(run)
        if len(run) <= KEPT_CHARS:
            if len(self.young) >= KEPT_RUNS:
                self.old, self.young = self.young, {}
            self.young[run] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        ids: list[int] = []
        for run in self.runs.findall(whole) if self.runs else [whole]:
            known = self.young.get(run)
            ids += self._recall(run) if known is None else known
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces joined; bytes together, a wrong one as the replacement character; one space in front goes."""
        if self.value.keys().isdisjoint(ids):
            said = "".join([self.pieces[i] for i in ids if self.kinds[i] != ord("c")])
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in self.value:
                    held.append(self.value[i])
                    continue
                if held:
                    parts.append(_from_bytes(bytes(held)))
                    held.clear()
                if self.kinds[i] != ord("c"):
                    parts.append(self.pieces[i])
            if held:
                parts.append(_from_bytes(bytes(held)))
            said = "".join(parts)
        front = next((i for i in ids if self.kinds[i] != ord("c")), None)
        if front is not None and self.kinds[front] == ord("n") and said.startswith(SPACE):
            said = said[1:]
        return said.replace(SPACE, " ")


def _from_bytes(held: bytes) -> str:
    """UTF-8, each byte outside a character as the replacement character."""
    out = []
    while held:
        try:
            return "".join(out) + held.decode("utf-8")
        except UnicodeDecodeError as wrong:
            out.append(held[: wrong.start].decode("utf-8") + "�")
            held = held[wrong.start + 1 :]
    return "".join(out)


_codecs: dict[int, tuple[Vocabulary, Codec]] = {}


def codec(words: Vocabulary) -> Codec:
    """The worker's codec of a vocabulary; made once, as workers live on between tasks."""
    key = hash(words)
    if key not in _codecs or _codecs[key][0] != words:
        _codecs.clear()
        _codecs[key] = words, Codec(words)
    return _codecs[key][1]


def encode(docs: DataFrame, words: Vocabulary | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    words = words or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(words)

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = own.encode(text.as_py())
                    yield 4 * len(ids), (key, np.array(ids, np.int32))

        yield from in_batches(rows(), _IDS)
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, words: Vocabulary | None = None) -> DataFrame:
    """(doc_id, ids, text): the texts of rows of ids; null ids and ids out of range are left out."""
    words = words or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(words)

        def rows():
            for batch in batches:
                for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = ids.as_py()
                    text = own.decode([i for i in ids or [] if i is not None and 0 <= i < len(own.pieces)])
                    yield 4 * len(ids or []) + len(text), (key, ids, text)

        yield from in_batches(rows(), _TEXT)
        give_back()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, words: Vocabulary | None = None) -> DataFrame:
    """One row per document: number of ids, digests of the ids and of the text decoded from them.

    As ``decode(encode(docs))``, but ids and texts stay in the worker that makes them.
    """
    words = words or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(words)

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = own.encode(text.as_py())
                    written = ",".join(map(str, ids)).encode()
                    yield 256, (key, len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())

        yield from in_batches(rows(), _DIGESTS)
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
