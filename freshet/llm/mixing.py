"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Tokens are lower-cased words and one end per text. Training counts of all words are gathered over
the corpus, dealt out by word; they come back to blocks of documents (see ``blocks``).

Every token is a path of bits in one Huffman tree whose leaves are the most frequent words, hash
classes of the other words seen at least twice, and one leaf for words seen once or never. Words,
classes and slots (below) follow the number of training tokens (``sizes_for``), up to tables that a
task can hold. A word's share of its leaf comes from the counts; an unseen word is one event, as in the
base score. Each bit is predicted in several contexts (none, the last one to three leaves, the last
frequent leaf): a context and the node of the tree are hashed to a slot, which holds how often
training texts went left and right there. The stretched predictions are added with weights chosen
by how much the contexts have seen (the gates); weights start as fitted on all training texts with
each bit's own occurrence taken out of the counts, and are updated in every document after each chunk of
tokens, together with a final adaptive map of probabilities. So every probability depends on
training texts and earlier tokens of its own document only.

Slot tables have a largest size, so tasks may have copies. Score and base score count an unseen word
as one event; bits_per_byte also spells unseen words out, by pairs of bytes, and divides by the bytes of the text
in UTF-8; it is null for an empty text.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.blocks import code_blocks, pack_words, unpack_words, widen
from freshet.llm.common import discard, give_back, keep, texts
from freshet.llm.bpe import pack, unpack

TOP, MOST_TOP = 4096, 32768  # frequent words, at least and at most; leaves fit two bytes
WORDS_A_CLASS = 16  # frequent words for each hash class of the others
MOST_CLASSES = MOST_TOP // WORDS_A_CLASS
SLOT_BITS, MOST_SLOT_BITS = 20, 22
TOKENS_A_SLOT = 32
SLOTS_AT_ONCE = 1 << 18
ORDERS = 5
CHUNK = 32  # tokens between updates
LANES = 128  # documents that are scored together, at most
TOKENS_AT_ONCE = 8_000  # whose bits go through numpy together: few enough for a core's cache
GATES = 27
RATE = 0.002
FOLDS, HELD_OUT = 7, 2
STEPS = 2  # passes over all training texts for the first weights
START, PULL = 0.3, 10.0
FREQUENT = 100
END = "\n"  # no word holds a white space

# fixed values: the white space that parts words, ASCII only
LOWER = bytes(range(9)) + b" " * 5 + bytes(range(14, 65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def tokens(text: str) -> list[str]:
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass").split(" ")
    if "" in found:
        found = [w for w in found if w]
    found.append(END)
    return found


def trained(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != HELD_OUT


def sizes_for(n: int) -> tuple[int, int]:
    """Frequent words and bits of a slot number for n training tokens, both in powers of two.

    Words grow with the square root of the tokens, as distinct words of a text do; slots with the tokens.
    """
    words = 1 << max(0, math.ceil(math.log2(max(2 * math.sqrt(n), 1))))
    bits = math.ceil(math.log2(max(n / TOKENS_A_SLOT, 1)))
    return min(max(words, TOP), MOST_TOP), min(max(bits, SLOT_BITS), MOST_SLOT_BITS)


# --- counts of words -------------------------------------------------------------

PARTS = "bucket int, block long, number binary, words binary, counts binary"
COUNTED = "block long, number binary, leaf_words binary, counts binary, n long, v long, v1 long, v2 long, classes array<long>, pairs binary, top array<string>, top_counts array<long>"


def _parts(buckets: int):
    """Each block's words with their training counts, cut into buckets by a hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes = unpack_words(row["words"]), widen(row["codes"])
                learn = np.repeat([trained(i) for i in row["doc_id"]], row["n_words"])
                counts = np.bincount(codes[learn.astype(bool)], minlength=len(words)).astype(np.uint32)
                cut = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int32, len(words))
                order = np.argsort(cut, kind="stable").astype(np.uint32)
                found, starts = np.unique(cut[order], return_index=True)
                runs = np.split(order, starts[1:])
                cols = [
                    pa.array(found, pa.int32()),
                    pa.array([row["block"]] * len(runs), pa.int64()),
                    pa.array([pack(np.diff(r, prepend=np.uint32(0)).astype(np.uint32).tobytes()) for r in runs], pa.binary()),
                    pa.array([pack_words(map(words.__getitem__, r.tolist())) for r in runs], pa.binary()),
                    pa.array([pack(counts[r].tobytes()) for r in runs], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "number", "words", "counts"])
        give_back()

    return run


def _byte_pairs(words) -> np.ndarray:
    """How often each byte follows each; 256 stands for the ends."""
    joined = np.frombuffer(b"".join(b"\n" + w.encode("utf-8", "surrogatepass") for w in words) + b"\n", np.uint8).astype(np.int64)
    joined[joined == 10] = 256
    return np.bincount(joined[:-1] * 257 + joined[1:], minlength=257 * 257)


def _counted(group: pa.Table) -> pa.Table:
    """One bucket: total counts given back to its blocks, and a row of sums (block null)."""
    place: defaultdict[str, int] = defaultdict()
    place.default_factory = place.__len__  # words are numbered as they come
    rows = group.to_pylist()
    for row in rows:
        words = unpack_words(row["words"])
        row["places"] = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    total = np.zeros(len(place), np.int64)
    for row in rows:  # a block has a word once
        total[row["places"]] += unpack(row["counts"])
    words = np.array(list(place), object)
    place.clear()
    often = np.flatnonzero(total >= 2)
    classes, v1, v2 = np.zeros(MOST_CLASSES, np.int64), int((total == 1).sum()), int((total == 2).sum())
    np.add.at(classes, [zlib.crc32(w.encode("utf-8", "surrogatepass"), 7) % MOST_CLASSES for w in words[often]], total[often])
    known = words[total > 0].tolist()
    top = heapq.nsmallest(MOST_TOP, zip((-total[often]).tolist(), words[often].tolist()))
    names = [c.strip().split(" ")[0] for c in COUNTED.split(", ")]
    out = [(r["block"], r["number"], r["words"], total[r["places"]].tobytes(), None, None, None, None, None, None, None, None) for r in rows]
    pairs = _byte_pairs(w for w in known if w != END).tobytes()
    out.append((None, None, None, None, int(total.sum()), len(known), v1, v2, classes.tolist(), pairs, [w for _, w in top], [-c for c, _ in top]))
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    give_back()
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


# --- the tree --------------------------------------------------------------------


@dataclass
class Tree:
    """Paths of the leaves: node numbers and bits, one after the other."""

    leaf_of: dict[str, int]
    class_counts: np.ndarray
    n: int
    v: int
    v1: int
    unseen: float
    spelling: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    top: int
    slot_bits: int
    depths: np.ndarray
    alone: np.ndarray  # slots of the nodes without a context

    def leaves(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' leaves, log10 of their shares of them, and log10 of the spelling of those unseen."""
        leaf, share, spell = np.full(len(words), self.top + len(self.class_counts)), np.zeros(len(words)), np.zeros(len(words))
        often = np.flatnonzero(counts >= 2)
        leaf[often] = np.fromiter((self.leaf_of.get(words[i], -1) for i in often.tolist()), np.int64, len(often))
        if (once := counts == 1).any():
            share[once] = math.log10((1 - self.unseen) / self.v1)
        often = often[leaf[often] < 0]
        own = np.fromiter((zlib.crc32(words[i].encode("utf-8", "surrogatepass"), 7) % len(self.class_counts) for i in often.tolist()), np.int64, len(often))
        leaf[often], share[often] = self.top + own, np.log10(counts[often] / self.class_counts[own])
        if len(never := np.flatnonzero(counts == 0)):
            share[never] = math.log10(self.unseen)
            spell[never] = self.spelled([words[i] for i in never.tolist()])
        return leaf, share, spell

    def leaf(self, word: str, count: int) -> tuple[int, float]:
        leaf, share, _ = self.leaves([word], np.array([count]))
        return int(leaf[0]), float(share[0])

    def spelled(self, words: list[str]) -> np.ndarray:
        """Sums over each word's pairs of bytes, from its start to its end; the end of a text is a word of one byte."""
        raw = np.frombuffer(b"".join(b"\n" + w.encode("utf-8", "surrogatepass") + b"\n" for w in words), np.uint8).astype(np.int64)
        raw[raw == 10] = 256
        sizes = np.array([len(w.encode("utf-8", "surrogatepass")) + 2 for w in words])
        ends = np.cumsum(sizes)
        pairs = np.append(self.spelling[raw[:-1], raw[1:]], 0)
        pairs[ends - 1] = 0  # from one word to the next
        return np.add.reduceat(pairs, ends - sizes)


def _huffman(weights: list[int]) -> list[list[tuple[int, int]]]:
    """Per leaf its path of (node, bit)."""
    heap = [(w, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    following = len(weights)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (following, 0), (following, 1)
        heapq.heappush(heap, (a + b, following, following))
        following += 1
    out = []
    for i in range(len(weights)):
        path, at = [], i
        while at in parent:
            node, bit = parent[at]
            path.append((node - len(weights), bit))
            at = node
        out.append(path[::-1])
    return out


def _sums(sums: DataFrame) -> DataFrame:
    """Counts of classes, then of pairs of bytes, added up in each task: its rows do not grow with the buckets it reads."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MOST_CLASSES + 257 * 257, np.int64)
        for batch in batches:
            for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[:MOST_CLASSES] += np.array(c, np.int64)
                total[MOST_CLASSES:] += np.frombuffer(p, np.int64)
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], names=["i", "c"])

    return sums.select("classes", "pairs").mapInArrow(add, "i long, c long")


def tree(counted: DataFrame) -> Tree:
    """The tree and the sums; only sums and at most ``MOST_TOP`` words come to the driver."""
    sums = counted.where("block is null")
    row = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "v1", "v2")]).first()
    most, slot_bits = sizes_for(row.n)
    classes = np.zeros(most // WORDS_A_CLASS, np.int64)  # their number divides that of the counted ones
    pairs = np.zeros(257 * 257)
    for r in _sums(sums).groupBy("i").agg(F.sum("c").alias("c")).collect():
        if r.i < MOST_CLASSES:
            classes[r.i % len(classes)] += r.c
        else:
            pairs[r.i - MOST_CLASSES] = r.c
    pairs = pairs.reshape(257, 257) + 0.1
    top = sums.select(F.explode(F.arrays_zip("top", "top_counts")).alias("t")).orderBy(F.desc("t.top_counts"), "t.top").limit(most).collect()
    words = [(r.t.top, r.t.top_counts) for r in top]
    for w, c in words:
        classes[zlib.crc32(w.encode("utf-8", "surrogatepass"), 7) % len(classes)] -= c
    weights = [c for _, c in words] + [1] * (most - len(words)) + [int(c) + 1 for c in classes] + [row.v1 + 1]
    paths = _huffman(weights)
    sizes = np.array([len(p) for p in paths], np.int64)
    flat = np.array([x for p in paths for x in p])
    starts = np.cumsum(sizes) - sizes
    unseen = (row.v1 + 1) / (row.v1 + 2 * row.v2 + 2)
    if not row.v1:
        unseen = 1.0
    return Tree(
        {w: i for i, (w, _) in enumerate(words)}, np.maximum(classes, 1), row.n, row.v, row.v1, unseen,
        np.log10(pairs / pairs.sum(1, keepdims=True)), starts, sizes, flat[:, 0].astype(np.uint32), flat[:, 1].astype(np.uint8), most, slot_bits,
        (np.arange(len(flat)) - np.repeat(starts, sizes)).astype(np.uint8), _slots(0, np.uint32(0), flat[:, 0].astype(np.uint32), slot_bits),
    )


CODED = "doc_id long, learn boolean, n_tokens long, n_known long, base double, shares double, spelling double, n_bytes long, leaves binary"


def _code(shape: Tree):
    """One block: its documents as leaves, with what the counts alone say about them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.strip().split(" ")[0] for c in CODED.split(", ")]
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * 3, pa.int64(), pa.binary()]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        row = {c: left.column(c)[0].as_py() for c in ("doc_id", "n_words", "codes", "carried")}
        codes = widen(row["codes"]).astype(np.int64)
        total = int(codes.max()) + 1
        count, leaf, share, spell = np.zeros(total, np.int64), np.zeros(total, np.uint16), np.zeros(total), np.zeros(total)
        for number, words, counts in zip(*(right.column(c).to_pylist() for c in ("number", "leaf_words", "counts"))):
            where, own = np.cumsum(unpack(number)).astype(np.int64), np.frombuffer(counts, np.int64)
            count[where] = own
            leaf[where], share[where], spell[where] = shape.leaves(unpack_words(words), own)
        base = np.log10((count + 1) / (shape.n + (shape.v + 1)))
        bounds = np.cumsum([0, *row["n_words"]])[:-1]  # every document has its end at least
        sums = [np.add.reduceat(x[codes], bounds) for x in (count > 0, base, share, spell)]
        held = [leaf[codes[a : a + n]].tobytes() for a, n in zip(bounds, row["n_words"])]
        give_back()
        cols = [row["doc_id"], [trained(i) for i in row["doc_id"]], row["n_words"], sums[0].astype(np.int64), *sums[1:4], row["carried"], held]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


# --- predictors ------------------------------------------------------------------


def _contexts(leaves: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Per order a hash of each token's context; ``starts``: where documents begin."""
    n = len(leaves)
    owner_start = np.repeat(starts, np.diff(np.append(starts, n)))
    at = np.arange(n) - owner_start
    own = leaves.astype(np.uint32) + np.uint32(1)

    def back(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint32)
        out[k:] = own[: n - k] if n > k else own[:0]
        out[at < k] = 0
        return out

    one, two, three = back(1), back(2), back(3)
    a = one * np.uint32(0x9E3779B1)
    b = (a ^ (a >> np.uint32(15))) + two * np.uint32(0x85EBCA77)
    c = (b ^ (b >> np.uint32(13))) * np.uint32(5) + three * np.uint32(0xC2B2AE3D)
    # the last frequent leaf before each token of the same document
    last = np.maximum.accumulate(np.where(leaves < FREQUENT, np.arange(n), -1))
    before = np.concatenate([[-1], last[:-1]])
    frequent = np.where(before >= owner_start, own[np.maximum(before, 0)], 0).astype(np.uint32)
    return [np.zeros(n, np.uint32), a, b, c, frequent * np.uint32(0x27D4EB2F)]


def _slots(order: int, context: np.ndarray, nodes: np.ndarray, slot_bits: int) -> np.ndarray:
    """Slots of (context, node) pairs; without a context a node's slot is its own."""
    x = nodes * np.uint32(0x9E3779B1) + np.uint32(order * 0x3C6EF372 & 0xFFFFFFFF)
    x ^= context
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x >>= np.uint32(32 - slot_bits)
    return x


def expand(leaves: np.ndarray, starts: np.ndarray, shape: Tree, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Bits, token of each bit, slots by context, and depth of each bit; tokens in the order given."""
    contexts = _contexts(leaves, starts)
    if order is not None:
        leaves, contexts = leaves[order], [c[order] for c in contexts]
    sizes = shape.sizes[leaves]
    token = np.repeat(np.arange(len(leaves)) if order is None else order, sizes)
    at = np.arange(len(token))
    at += np.repeat(shape.starts[leaves] - (np.cumsum(sizes) - sizes), sizes)
    # every step asked for is there, so that take need not look for others first
    nodes, bits, depth, alone = (v.take(at, mode="clip") for v in (shape.nodes, shape.bits, shape.depths, shape.alone))
    return bits, token, [alone, *(_slots(k, np.repeat(c, sizes), nodes, shape.slot_bits) for k, c in enumerate(contexts) if k)], depth


def by_chunk(starts: np.ndarray, n_tokens: int) -> np.ndarray:
    """Tokens ordered by their chunk, then by document."""
    at = np.arange(n_tokens) - np.repeat(starts, np.diff(np.append(starts, n_tokens)))
    return np.argsort(at // CHUNK, kind="stable")


def _count(shape: Tree):
    """A task's training texts -> its counts by slice of the slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ORDERS, 2 << shape.slot_bits), np.uint32)
        for batch in batches:
            held = batch.column("leaves").to_pylist()
            at = 0
            while at < len(held):
                part, size = [], 0
                while at < len(held) and size < TOKENS_AT_ONCE:
                    part.append(np.frombuffer(held[at], np.uint16).astype(np.int64))
                    size += len(part[-1])
                    at += 1
                starts = np.cumsum([0, *map(len, part)])[:-1]
                bits, _, slots, _ = expand(np.concatenate(part), starts, shape)
                for k, s in enumerate(slots):
                    np.add.at(total[k], s * np.uint32(2) + bits, np.uint32(1))
        for k in range(ORDERS):
            for i, own in enumerate(np.split(total[k], 16)):
                if own.any():
                    cols = [pa.array([k * 16 + i], pa.int32()), pa.array([pack(own.tobytes())], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["slice", "counts"])
        del total
        give_back()

    return run


def _add(group: pa.Table) -> pa.Table:
    total = None
    for packed in group.column("counts"):
        own = unpack(packed.as_py())
        total = own.astype(np.uint64) if total is None else total + own
    most = np.iinfo(np.uint32).max
    return pa.table([group.column("slice").slice(0, 1).cast(pa.int32()), pa.array([pack(np.minimum(total, most).astype(np.uint32).tobytes())], pa.binary())], names=["slice", "counts"])


def slot_slices(coded: DataFrame, shape: Tree) -> Iterator[tuple[int, int, np.ndarray]]:
    """Order, first slot and (slot, bit) counts of slices of the slots, over all training texts; slices without any are left out."""
    parts = coded.where("learn").select("leaves").mapInArrow(_count(shape), "slice int, counts binary")
    width = (1 << shape.slot_bits) // 16
    for r in parts.groupBy("slice").applyInArrow(_add, "slice int, counts binary").toLocalIterator():
        yield r.slice // 16, r.slice % 16 * width, unpack(bytes(r.counts)).reshape(width, 2)


def slot_tables(coded: DataFrame, shape: Tree) -> np.ndarray:
    """(order, slot, bit) counts over all training texts; the size is that of ``sizes_for``."""
    out = np.zeros((ORDERS, 1 << shape.slot_bits, 2), np.uint32)
    for k, a, counts in slot_slices(coded, shape):
        out[k, a : a + len(counts)] = counts
    return out


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


@dataclass
class Model:
    shape: Tree
    stretch: np.ndarray  # order, slot: float16
    seen: np.ndarray  # order, slot: 0 never, 1 up to three times, 2 more
    weights: np.ndarray  # gate, order



def joined(stretch: np.ndarray, seen: np.ndarray, width: int) -> list[np.ndarray]:
    """Inputs in single precision with the level in two of the bits that half precision leaves empty: one look-up for both."""
    out = []
    for own, level in zip(stretch, seen):
        both = own.astype(np.float32)
        for k in range(width):
            both.view(np.uint32)[k::width] |= level
        out.append(both)
    return out


def looked_up(tables: list[np.ndarray], at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs by order, and gates, from the tables of ``joined``."""
    x = np.empty((ORDERS, len(at[0])), np.float32)
    for k in range(ORDERS):
        tables[k].take(at[k], out=x[k], mode="clip")
    raw = x.view(np.uint32)
    gate = _gate([(raw[k] & np.uint32(3)).astype(np.uint8) for k in (1, 2, 3)])
    raw &= np.uint32(0xFFFFFFFC)
    return x.T, gate


def _gate(seen: list[np.ndarray]) -> np.ndarray:
    three = np.uint8(3)  # there are 27 gates, so one byte holds them
    return (seen[0] * three + seen[1]) * three + seen[2]


def _levels(n: np.ndarray) -> np.ndarray:
    return ((n > 0).astype(np.uint8) + (n > 3)).astype(np.uint8)


BUCKETS = 24
MARK = 1 << 26  # more than a chunk has bits


def mixed(x: np.ndarray, gate: np.ndarray, bits: np.ndarray, token: np.ndarray, depth: np.ndarray, starts: np.ndarray, n_tokens: int, first: np.ndarray, rate: float = RATE, shared: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability per document, and the weights afterwards (per document, or one if shared).

    All documents go on side by side, one chunk of tokens at a time. In a chunk the weights and the
    adaptive map are those after the chunk before it.
    """
    sizes = np.diff(np.append(starts, n_tokens))
    lanes = len(starts)
    lane_of_token = np.repeat(np.arange(lanes), sizes)
    chunk = (np.arange(n_tokens) - starts[lane_of_token]) // CHUNK
    lane, chunk_of = lane_of_token[token], chunk[token]
    if (np.diff(chunk_of) < 0).any():
        order = np.argsort(chunk_of, kind="stable")
        lane, chunk_of, x, gate, bits, depth = (v[order] for v in (lane, chunk_of, x, gate, bits, depth))
    x = np.ascontiguousarray(x.T)  # by order, so that each is read in one run
    y, depth = bits.astype(np.float32), np.minimum(depth, 7)
    edges = np.searchsorted(chunk_of, np.arange(chunk_of[-1] + 2 if len(chunk_of) else 1))
    sets = 1 if shared else lanes
    w = np.ascontiguousarray(np.repeat(first[None].astype(np.float32), sets, 0).reshape(sets * GATES, ORDERS).T)
    gates, cells = gate + (0 if shared else lane * GATES), (lane * 8 + depth) * BUCKETS
    marks = 1 + y.astype(np.float64) * MARK  # hits and ones in one sum
    centre = (1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS / 2 + 0.5) / 1.5))).astype(np.float32)
    apm = np.tile(centre, lanes * 8)
    total = np.zeros(lanes)
    for a, b in zip(edges[:-1], edges[1:]):
        if a == b:
            continue
        own, part = gates[a:b], x[:, a:b]
        logit = part[0] * w[0].take(own)
        for k in range(1, ORDERS):
            logit += part[k] * w[k].take(own)
        np.clip(logit, -15, 15, out=logit)
        p = 1 / (1 + np.exp(-logit))
        cell = cells[a:b] + np.clip(logit * np.float32(1.5) + np.float32(BUCKETS / 2), 0, BUCKETS - 1).astype(np.int64)
        refined = np.clip(0.75 * p + 0.25 * apm.take(cell), 1e-6, 1 - 1e-6)
        t = y[a:b]
        got = np.where(t > 0, refined, 1 - refined)
        total += np.bincount(lane[a:b], np.log10(got), lanes)
        err = (t - p) * rate
        for k in range(ORDERS):
            w[k] += np.bincount(own, err * part[k], sets * GATES)
        low = cell.min()
        cell -= low
        both = np.bincount(cell, marks[a:b])
        used = np.flatnonzero(both)
        ones, hits = np.divmod(both[used], MARK)
        used += low
        old = apm.take(used)
        apm[used] = old + (ones / hits - old) * (hits / (hits + 30))
    return total, w.T.reshape(sets, GATES, ORDERS)


def without_own(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per (slot, bit) the input and the level that a training bit gets there, its own occurrence taken out.

    A (slot, bit) that no training text has is never asked for.
    """
    zeros, ones = counts[:, 0].astype(np.int64), counts[:, 1].astype(np.int64)
    less = [np.maximum(c - 1, 0) for c in (zeros, ones)]
    stretch = np.stack([stretched(less[0], ones), stretched(zeros, less[1])], 1).astype(np.float16)
    return stretch.ravel(), _levels(np.maximum(zeros + ones - 1, 0))


def with_own(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per slot the input and the level that a scored bit gets there."""
    return stretched(counts[:, 0], counts[:, 1]).astype(np.float16), _levels(counts.sum(1, dtype=np.int64))


def tables_of(counts: np.ndarray, rule, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``rule`` of the counts of all orders, with ``width`` inputs a slot: some slots at a time, so that the driver holds little beside the tables."""
    orders, n = counts.shape[:2]
    stretch, seen = np.empty((orders, n * width), np.float16), np.empty((orders, n), np.uint8)
    for k in range(orders):
        for a in range(0, n, SLOTS_AT_ONCE):
            b = min(a + SLOTS_AT_ONCE, n)
            stretch[k, a * width : b * width], seen[k, a:b] = rule(counts[k, a:b])
    return stretch, seen


def tables_by_slice(coded: DataFrame, shape: Tree) -> list[tuple[np.ndarray, np.ndarray]]:
    """What ``tables_of`` makes by both rules of the counts, which the driver never holds but for a slice."""
    made = [(rule, width, np.zeros((ORDERS, width << shape.slot_bits), np.float16), np.zeros((ORDERS, 1 << shape.slot_bits), np.uint8)) for rule, width in ((without_own, 2), (with_own, 1))]
    for k, a, counts in slot_slices(coded, shape):
        for rule, width, stretch, seen in made:
            b = a + len(counts)
            stretch[k, a * width : b * width], seen[k, a:b] = rule(counts)
    return [m[2:] for m in made]


def inputs_without_own(stretch: np.ndarray, seen: np.ndarray, slots: list[np.ndarray], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and gates of training bits from the tables of ``without_own``."""
    return looked_up(joined(stretch, seen, 2), [s * np.uint32(2) + bits for s in slots])


def curvature(x: np.ndarray, gate: np.ndarray, bits: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` (gate, order, 1 + order) the gradient of the bits' log likelihood and its negated second derivative."""
    order = np.argsort(gate.astype(np.uint8), kind="stable")
    found = np.bincount(gate, minlength=GATES)
    edges = np.cumsum([0, *found])
    columns, y = x.T.take(order, 1, mode="clip"), bits.take(order, mode="clip")
    for g in np.flatnonzero(found):
        own = columns[:, edges[g] : edges[g + 1]].astype(float)  # sums in double, so that they hardly depend on how texts are dealt
        p = 1 / (1 + np.exp(-np.clip(weights[g] @ own, -15, 15)))
        rows = np.empty((1 + ORDERS, len(p)))
        np.subtract(y[edges[g] : edges[g + 1]], p, out=rows[0])
        np.multiply(own, p * (1 - p), out=rows[1:])
        total[g] += own @ rows.T


def _curvature(shape: Tree, stretch: np.ndarray, seen: np.ndarray, weights: np.ndarray):
    return _step(shape, lambda: (stretch, seen), weights)


def _step(shape: Tree, tables_of_all, weights: np.ndarray):
    """A task's training texts -> its sums for one step of all gates' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GATES, ORDERS, 1 + ORDERS))
        tables = joined(*tables_of_all(), 2)
        for batch in batches:
            held = batch.column("leaves").to_pylist()
            at = 0
            while at < len(held):
                part, size = [], 0
                while at < len(held) and size < TOKENS_AT_ONCE:
                    part.append(np.frombuffer(held[at], np.uint16).astype(np.int64))
                    size += len(part[-1])
                    at += 1
                starts = np.cumsum([0, *map(len, part)])[:-1]
                bits, _, slots, _ = expand(np.concatenate(part), starts, shape)
                x, gate = looked_up(tables, [s * np.uint32(2) + bits for s in slots])
                curvature(x, gate, bits, weights, total)
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total.ravel()[where])], names=["i", "v"])
        give_back()

    return run


def first_weights(coded: DataFrame, shape: Tree, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights that predict all training texts, in whole, each bit without its own occurrence in the counts.

    Every gate is a logistic regression. A step is one pass: tasks add up gradients and second derivatives,
    Spark adds up one row per task and entry, and the driver solves 27 systems of five unknowns. A weak
    pull towards the start keeps gates that saw few bits near it.
    """
    return fitted(coded, shape, *tables_of(counts, without_own, 2), steps)


def fitted(coded: DataFrame, shape: Tree, stretch: np.ndarray, seen: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """``first_weights`` from the tables of ``without_own``, which go to the tasks once for all steps."""
    start = np.full((GATES, ORDERS), START)
    weights = start
    learned = coded.where("learn").select("leaves")
    shared = coded.sparkSession.sparkContext.broadcast((stretch, seen))
    for _ in range(steps):
        total = np.zeros(GATES * ORDERS * (1 + ORDERS))
        for r in learned.mapInArrow(_step(shape, lambda: shared.value, weights), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r.i] = r.v
        total = total.reshape(GATES, ORDERS, 1 + ORDERS)
        gradient = total[:, :, 0] - PULL * (weights - start)
        weights = weights + np.linalg.solve(total[:, :, 1:] + PULL * np.eye(ORDERS), gradient[:, :, None])[:, :, 0]
    shared.destroy()
    return weights


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = joined(model.stretch, model.seen, 1)
        for batch in batches:
            held = [np.frombuffer(v, np.uint16).astype(np.int64) for v in batch.column("leaves").to_pylist()]
            out = np.zeros(len(held))
            # documents of like length go on together
            order = sorted(range(len(held)), key=lambda i: len(held[i]))
            at = 0
            while at < len(order):
                part, size = [], 0
                while at < len(order) and len(part) < LANES and size < 60_000:
                    part.append(order[at])
                    size += len(held[order[at]])
                    at += 1
                starts = np.cumsum([0, *(len(held[i]) for i in part)])[:-1]
                bits, token, slots, depth = expand(np.concatenate([held[i] for i in part]), starts, model.shape, by_chunk(starts, size))
                x, gate = looked_up(tables, slots)
                out[part], _ = mixed(x, gate, bits, token, depth, starts, size, model.weights)
            keep_ = [batch.column(c) for c in ("doc_id", "learn", "n_tokens", "n_known", "base", "shares", "spelling", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*keep_, pa.array(out)], names=["doc_id", "learn", "n_tokens", "n_known", "base", "shares", "spelling", "n_bytes", "bits"])
        give_back()

    return run


def scores(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text), see the query's columns below.

    Null texts are empty and have one token, the end. Rows with a null id count as id "". Repeated
    rows count, and are scored, each. Without training texts every count is zero. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    sized = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    blocks, blocks_path = keep(code_blocks(sized, tokens, carry="n_bytes"), "mixing-blocks")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = blocks.mapInArrow(_parts(buckets), PARTS)
    counted, counted_path = keep(parts.groupBy("bucket").applyInArrow(_counted, COUNTED), "mixing-counts")
    shape = tree(counted)
    given = counted.where("block is not null").select("block", "number", "leaf_words", "counts")
    coded, _ = keep(blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_code(shape), CODED), "mixing-leaves")
    discard(spark, blocks_path)
    discard(spark, counted_path)
    small = replace(shape, leaf_of={})
    apart, whole = tables_by_slice(coded, small)
    weights = fitted(coded, small, *apart)
    del apart
    give_back()
    model = Model(small, *whole, weights)
    columns = "doc_id long, learn boolean, n_tokens long, n_known long, base double, shares double, spelling double, n_bytes long, bits double"
    found = coded.mapInArrow(_score(model), columns)
    score = F.col("bits") + F.col("shares")
    return found.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(shape.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        score.alias("score"),
        F.try_divide(-(score + F.col("spelling")) * float(np.log2(10)), F.col("n_bytes")).alias("bits_per_byte"),
    )
