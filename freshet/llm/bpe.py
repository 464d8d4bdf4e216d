"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space; no merge, special token or normalisation of the tokenizer crosses
it. Blocks of documents (see ``blocks``) give their distinct words; these are dealt out by a hash of
the word, so each distinct word is encoded once in the whole job, and its ids go back to the blocks,
where they are put together by position. The number of word buckets follows
``spark.sql.shuffle.partitions``. Decoding replaces ids by pieces through the id-to-piece table, whose
size is the vocabulary's.

Null or blank texts give no ids and the empty text. Repeated rows are encoded each. A text of any
length is one document of a block; the ids of a block are bounded by its text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from freshet.llm.blocks import code_blocks, pack_words, unpack_words, widen
from freshet.llm.common import give_back, in_batches, texts, tokenizer_json

# fixed value: the characters of Unicode property White_Space
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[^{SPACE}]+")

PARTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("number", pa.large_binary()), ("words", pa.large_binary())])
IDS = pa.schema([("block", pa.int64()), ("number", pa.large_binary()), ("size", pa.large_binary()), ("ids", pa.large_binary())])


OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _parts(buckets: int):
    """A block's distinct words, cut into buckets by a hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                words = unpack_words(packed)
                cut = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int32, len(words))
                order = np.argsort(cut, kind="stable").astype(np.uint32)
                found, starts = np.unique(cut[order], return_index=True)
                runs = np.split(order, starts[1:]) if len(words) else []
                numbers = [pack(np.diff(r, prepend=np.uint32(0)).astype(np.uint32).tobytes()) for r in runs]
                held = [pack_words(map(words.__getitem__, r.tolist())) for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int32()), pa.array([block] * len(runs), pa.int64()), pa.array(numbers, pa.large_binary()), pa.array(held, pa.large_binary())],
                    schema=PARTS,
                )

    return run


def _encode_words(tokenizer: str):
    """Rows sorted by bucket -> ids of the words of each row; a bucket's words are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_str(tokenizer)
        bpe.no_truncation()
        bpe.no_padding()
        bucket, known = None, {}
        for batch in batches:
            for own, block, number, packed in zip(*(batch.column(c).to_pylist() for c in PARTS.names)):
                if own != bucket:
                    bucket, known = own, {}
                words = unpack_words(packed)
                fresh = [w for w in words if w not in known]
                for w, e in zip(fresh, bpe.encode_batch(fresh, add_special_tokens=False)):
                    known[w] = np.array(e.ids, np.uint32)
                ids = list(map(known.__getitem__, words))
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                row = [[block], [number], [pack(sizes.tobytes())], [pack(np.concatenate(ids).tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, IDS)], schema=IDS)
        give_back()

    return run


def pack(values: bytes) -> bytes:
    """32-bit numbers, bytes of one significance together, compressed."""
    import zstandard

    planes = np.frombuffer(values, np.uint8).reshape(-1, 4).T.tobytes() if values else b""
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[starts[w] : starts[w] + sizes[w]] of all w, one after the other."""
    n = sizes[which].astype(np.int64)
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[which].astype(np.int64), n)
    return flat[at]


def _documents(left: pa.Table, right: pa.Table) -> Iterator[tuple[int | None, int | None, np.ndarray]]:
    """(doc_id, what goes with it, ids) of the documents of one block: the ids of their words, put together by position."""
    if not left.num_rows:
        return
    row = {c: left.column(c)[0].as_py() for c in ("doc_id", "n_words", "codes", "carried")}
    codes = widen(row["codes"])
    total = int(codes.max()) + 1 if len(codes) else 0
    sizes = np.zeros(total, np.uint32)
    parts = []
    for number, size, ids in zip(*(right.column(c).to_pylist() for c in ("number", "size", "ids"))):
        numbers, own = np.cumsum(unpack(number)).astype(np.int64), unpack(size)
        sizes[numbers] = own
        parts.append((numbers, own, unpack(ids)))
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    flat = np.zeros(int(sizes.sum(dtype=np.int64)), np.int32)
    for numbers, own, ids in parts:
        ends = np.cumsum(own, dtype=np.int64)
        flat[np.repeat(starts[numbers] - (ends - own), own) + np.arange(len(ids))] = ids
    at = 0
    for key, more, n in zip(row["doc_id"], row["carried"] or [None] * len(row["doc_id"]), row["n_words"]):
        yield key, more, gather(flat, starts, sizes, codes[at : at + n].astype(np.int64))
        at += n


def _put_together(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = list(_documents(left, right))
    offsets = np.cumsum([0, *(len(ids) for *_, ids in rows)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *(ids for *_, ids in rows)])))
    made = pa.table([pa.array([key for key, *_ in rows], pa.int64()), ids], schema=OUT)
    del rows
    give_back()
    return made


def _blocks_and_words(docs: DataFrame, source: str, carry: str | None = None):
    """Blocks of documents, and the ids of the words of each block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(carry).cast("long").alias("carried")) if carry else texts(docs)
    blocks = code_blocks(rows, WORD.findall, carry="carried" if carry else None)
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = blocks.mapInArrow(_parts(buckets), "bucket int, block long, number binary, words binary")
    by_word = parts.repartition("bucket").sortWithinPartitions("bucket")
    back = by_word.mapInArrow(_encode_words(source), "block long, number binary, size binary, ids binary")
    return blocks.groupBy("block").cogroup(back.groupBy("block"))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text, as the tokenizer gives them without special tokens."""
    return _blocks_and_words(docs, tokenizer or tokenizer_json()).applyInArrow(_put_together, "doc_id long, ids array<int>")


def piece_table(tokenizer: str | None = None) -> list[str | None]:
    """The id-to-piece table; None for ids without a piece."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(tokenizer or tokenizer_json()).get_vocab(with_added_tokens=True)
    pieces = [None] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = piece
    return pieces


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, text): ids replaced by their pieces, a space between; unknown ids are left out.

    The id-to-piece table has one row per id of the vocabulary; every task looks ids up in a copy.
    """
    pieces = piece_table(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*pieces, None], dtype=object)  # the last one for ids out of range
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                found = known[np.where((flat >= 0) & (flat < len(pieces)), flat, len(pieces))]
                ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
                texts_ = (found[a:b].tolist() for a, b in zip([0, *ends], ends))
                out = [" ".join(t) if None not in t else " ".join(p for p in t if p is not None) for t in texts_]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(out, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, tokenizer: str | None = None, carry: str | None = None) -> DataFrame:
    """One row per document: number of ids, digest of the ids and of the text decoded from them.

    As ``decode(encode(docs))``, but a document's pieces are looked up, joined and digested where its ids are put
    together, one document after the other, so that neither texts nor lists of a whole block are held again. ``carry``
    names a column of whole numbers to come along; the ids then come along, too, packed (see ``unpacked``).
    """
    source = tokenizer or tokenizer_json()
    pieces = piece_table(source)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("carried", pa.int64()), ("packed", pa.binary())] if carry else []))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.array(pieces, dtype=object)

        def rows():
            for key, more, own in _documents(left, right):
                written, text = " ".join(map(str, own.tolist())), " ".join(known[own].tolist())
                row = key, len(own), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                packed = pack(own.astype(np.uint32).tobytes()) if carry else b""
                yield 256 + len(packed), (*row, more, packed) if carry else row

        made = pa.Table.from_batches(in_batches(rows(), schema), schema=schema)
        give_back()
        return made

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", carried long, packed binary" if carry else "")
    found = _blocks_and_words(docs, source, carry).applyInArrow(run, out)
    return found.withColumnRenamed("carried", carry) if carry else found


def unpacked(found: DataFrame) -> DataFrame:
    """The rows with their packed ids as ``ids array<int>``, in the same order."""
    rest = [f for f in found.schema.fields if f.name != "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [unpack(v.as_py()).astype(np.int32) for v in part.column("packed")]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(ids, pa.list_(pa.int32()))], names=[*(f.name for f in rest), "ids"])
        give_back()

    return found.select(*[f.name for f in rest], "packed").mapInArrow(run, StructType([*rest, StructField("ids", ArrayType(IntegerType()))]))
