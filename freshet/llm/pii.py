"""Personal data in disguise, found at its place in the original text.

Plain identifiers are found in the text as it is. Then a chain of transducers normalises it:
look-alike characters, spelled digits, letters that stand for digits, and at/dot disguises. Each
pass keeps its edits, so a span found in the normalised text is mapped back through all passes to
the characters it came from. Offsets are code points, ends are exclusive.

Null and empty texts have no spans. Texts are read whole; every finder is linear in the text, also
for long runs of digits or signs. Repeated rows are searched each.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import give_back, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# --- plain identifiers -----------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does, as the last part always takes a run to its end
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    at, end = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield begin, end
        else:
            end = max(end, at + 1)
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = dict(zip(KINDS, (emails, ips, cards, phones)))

# --- transducers -----------------------------------------------------------------

# fixed values: characters that look like others
ALIKE = dict(
    zip(
        "аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅοανικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhlABEKMHOPCTXIJSoavikptuxABEZHIKMNOPTYX",
        strict=True,
    )
)
# fixed values: signs by code point
UNSEEN = {0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
SIGNS = {0xA0: " ", 0x2007: " ", 0x2009: " ", 0x202F: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x2024: ".", 0x3002: ".", 0xFF61: ".", 0xFE6B: "@"}
# blocks whose characters may have an ASCII form: superscripts, enclosed, letter-like and wide forms, digits of other scripts
ODD = re.compile("[\xad\xa0\xb2\xb3\xb9ʰ-˿Ͱ-ӿԀ-ԯ٠-٩۰-۹०-९০-৯ -‏‐-―․ -⁯⁰-₟℀-⅏①-⓿。〇︰-﹯﻿！-｡０-９\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff]")


@lru_cache(1 << 12)
def plain_form(c: str) -> str:
    """What a character stands for in ASCII, or itself."""
    if c in ALIKE:
        return ALIKE[c]
    if ord(c) in UNSEEN:
        return ""
    if ord(c) in SIGNS:
        return SIGNS[ord(c)]
    digit = unicodedata.decimal(c, None) if c.isdecimal() else unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and "!" <= wide <= "~" else c


# fixed values: spelled digits in English, German, French and Spanish
SPELLED = [
    "zero oh one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
DIGIT = {w: str(max(i - 1, 0) if n == 0 else i) for n, line in enumerate(SPELLED) for i, w in enumerate(line.split())}
NUMBER_WORDS = frozenset(DIGIT)
TIMES = {"double": 2, "triple": 3}
_W = "(?:" + "|".join(sorted(DIGIT, key=len, reverse=True)) + ")"
_STEP = rf"(?:(?:double|triple)[\s-]{{1,2}})?{_W}(?![^\W\d_])|[0-9]{{1,4}}(?![0-9])"
_DOT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|punto|punkt|point|\.)\s{0,3}[\])}>]\s{0,3}|\s{1,3}(?:dot|punto|punkt)\s{1,3})"
CHAIN = re.compile(rf"(?<![\w])(?:plus[\s-]{{1,2}})?(?:{_STEP})(?:(?:[\s,-]{{1,2}}|\.|{_DOT})(?:{_STEP}))*", re.I)
STEP = re.compile(rf"(plus)[\s-]{{1,2}}|(?:(double|triple)[\s-]{{1,2}})?({_W})(?![^\W\d_])(?:[\s,-]{{1,2}}(?={_STEP}))?|([0-9]+)(?:[\s,-]{{1,2}}(?={_STEP}))?", re.I)
LETTER_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1"}
MIXED = re.compile(r"(?<![A-Za-z0-9])(?:\+[0-9OoIl][\x20().0-9OoIl-]{7,24}|[0-9OoIl](?:[\x20-]?[0-9OoIl]){12,18}|[0-9OoIl]{1,3}(?:\.[0-9OoIl]{1,3}){3})(?![A-Za-z0-9])")
_AT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:at|arroba|arobase|@)\s{0,3}[\])}>]\s{0,3}|\s{0,3}@\s{0,3})"
_BARE = r"\s{1,3}(?:at|arroba|arobase)\s{1,3}"
_LABEL, _NAME = r"[A-Za-z0-9-]+", r"[A-Za-z0-9_%+-]+"
# a bare "at" is a sign only where a dot is disguised as well
MAIL = re.compile(
    rf"(?<![A-Za-z0-9_%+-]){_NAME}(?:(?:\.|{_DOT}){_NAME}){{0,8}}"
    rf"(?:{_AT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+|{_BARE}{_LABEL}(?:\.{_LABEL})*(?:{_DOT}{_LABEL}(?:\.{_LABEL})*)+)",
    re.I,
)
AT_OR_DOT = re.compile(rf"(?P<at>{_AT}|{_BARE})|(?P<dot>{_DOT})", re.I)
# what a disguise cannot do without
BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|arroba|arobase|@|dot|punto|punkt|point|\.)\s{0,3}[\])}>]", re.I)
BLANK_AT = re.compile(r"\s@|@\s")
TOKEN = re.compile(r"[^\W\d_]+|\d+")
BARE_DOTS = frozenset(("dot", "punto", "punkt"))
BESIDE = NUMBER_WORDS | BARE_DOTS | {"point", "plus", *TIMES}
FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s"}  # letters that patterns without case take for others
ADDRESS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


class Rewritten:
    """A text after a pass, and where its characters came from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """edits: (start, end, replacement) in order, apart from each other."""
        parts, at, size = [], 0, 0
        self.begin, self.end, self.old_begin, self.old_end = [], [], [], []
        for a, b, new in edits:
            parts += [text[at:a], new]
            size += a - at
            self.begin.append(size)
            size += len(new)
            self.end.append(size)
            self.old_begin.append(a)
            self.old_end.append(b)
            at = b
        parts.append(text[at:])
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> Span:
        return self._of(start)[0], self._of(end - 1)[1]

    def _of(self, at: int) -> Span:
        i = bisect_right(self.begin, at) - 1
        # a deleted character has no place of its own
        while i >= 0 and self.begin[i] == self.end[i]:
            if self.begin[i] < at:
                break
            i -= 1
        if i >= 0 and at < self.end[i]:
            return self.old_begin[i], self.old_end[i]
        i = bisect_right(self.end, at) - 1
        old = at + (self.old_end[i] - self.end[i] if i >= 0 else 0)
        return old, old + 1


@lru_cache(1 << 16)
def alike(c: str) -> bool:
    return ODD.match(c) is not None and plain_form(c) != c


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not any(map(alike, set(text))):
        return []
    return [(m.start(), m.end(), new) for m in ODD.finditer(text) if (new := plain_form(m[0])) != m[0]]


def spelled_digits(text: str, least: int = 3) -> list[tuple[int, int, str]]:
    edits = []
    for chain in CHAIN.finditer(text):
        steps = list(STEP.finditer(text, chain.start(), chain.end()))
        if sum(bool(s[3]) for s in steps) < least:
            continue
        for s in steps:
            new = "+" if s[1] else DIGIT[s[3].lower()] * TIMES.get((s[2] or "").lower(), 1) if s[3] else s[4]
            edits.append((s.start(), s.end(), new))
    return edits


def few_spelled_digits(text: str) -> list[tuple[int, int, str]]:
    return spelled_digits(text, 1)


def letter_digits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in MIXED.finditer(text):
        letters = [m.start() + i for i, c in enumerate(m[0]) if c in LETTER_DIGITS]
        if letters and 2 * len(letters) <= sum("0" <= c <= "9" for c in m[0]):
            edits += [(i, i + 1, LETTER_DIGITS[text[i]]) for i in letters]
    return edits


def at_and_dot(text: str) -> list[tuple[int, int, str]]:
    edits, at = [], 0
    for m in sorted((*MAIL.finditer(text), *ADDRESS.finditer(text)), key=lambda m: m.start()):
        for part in AT_OR_DOT.finditer(text, m.start(), m.end()):
            if part.start() >= at:
                edits.append((*part.span(), "@" if part["at"] else "."))
                at = part.end()
    return edits


def asks(text: str) -> bool:
    """Whether a pass can change the text: never false where one would, so that it only saves time.

    A disguised sign is in brackets, a sign beside a blank, or a bare word for a dot (a bare "at"
    needs a disguised dot as well). In an identifier, the word or number next to a spelled digit is a
    number, a word of a chain, or letters that stand for digits.
    """
    raw = text
    if not text.isascii():
        if look_alikes(text):
            return True
        if any(c in text for c in "İıſ"):
            text = text.translate(FOLDED)
    if BRACKETED.search(text) or "@" in text and BLANK_AT.search(text):
        return True
    words = TOKEN.findall(text.lower())
    if not BARE_DOTS.isdisjoint(words):
        return True
    if not NUMBER_WORDS.isdisjoint(words):
        for i, w in enumerate(words):
            if w in NUMBER_WORDS and any(o in BESIDE or o.isdecimal() or not o.strip("oil") for o in (*words[max(0, i - 1) : i], *words[i + 1 : i + 2])):
                return True
    # letters for digits are those of the text itself, and so are the letters beside them
    return MIXED.search(raw) is not None and bool(letter_digits(raw))


def _disguised(text: str, passes: tuple[Callable, ...]) -> list[tuple[str, int, int]]:
    """Identifiers of the text after the passes, at their places in the text."""
    done, now = [], text
    for rule in passes:
        if edits := rule(now):
            done.append(Rewritten(now, edits))
            now = done[-1].text
    found = []
    for kind, finder in FINDERS.items() if done else ():
        for span in finder(now):
            for p in reversed(done):
                span = p.source(*span)
            found.append((kind, *span))
    return found


def spans(text: str, ask: Callable[[str], bool] = asks) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of every identifier, by kind as in KINDS, then start, then end.

    Chains of fewer than three spelled digits count where they make an address, card or phone apart
    from all that is found without them.
    """
    base = {k: list(f(text)) for k, f in FINDERS.items()}
    found = {(k, *s): True for k in KINDS for s in base[k]}
    if ask(text):
        for kind, *span in _disguised(text, (look_alikes, spelled_digits, letter_digits, at_and_dot)):
            if not any(a <= span[0] and span[1] <= b for a, b in base[kind]):
                found.setdefault((kind, *span), False)
        now = Rewritten(text, look_alikes(text)).text
        few = few_spelled_digits(now) != spelled_digits(now)
        for kind, start, end in _disguised(text, (look_alikes, few_spelled_digits, letter_digits, at_and_dot)) if few else ():
            if kind != "email" and not any(a < end and start < b for _, a, b in found):
                found[kind, start, end] = False
    return sorted(((*s, plain) for s, plain in found.items()), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# --- tables ----------------------------------------------------------------------

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def masked(text: str) -> str:
    """The text with every identifier replaced by its kind in brackets; of overlapping ones the union."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows with identifiers in ``text`` masked; a null text stays null.

    Only the texts reach Python, a few at a time, and its memory is given back after each batch.
    """

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 256):
                parts.append(pa.array([None if t is None else masked(t) for t in batch.slice(at, 256).to_pylist()], pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            del batch, parts
            give_back()

    return docs.withColumn("text", mask(F.col("text").cast("string")))


def _written(which: Column) -> Column:
    return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda k: k == kind


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the plain identifiers, and all spans; n_added: those in disguise."""
    plain = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(F.filter("spans", lambda s: s["base"])["kind"], _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_written(plain), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(plain)).cast("long").alias("n_added"),
    )
