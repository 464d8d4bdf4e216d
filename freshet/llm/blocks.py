"""Word-coded blocks of documents.

A block is a run of documents of one task with at most ``block_bytes`` of text (or one longer
document). It holds the block's distinct words once and, per document, the numbers of its words
in order. Tables of words can then be joined with (block, word) pairs, which are far fewer than
words, and what was found comes back to a block as a table no larger than the block.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import give_back

BLOCK_BYTES = 8 << 20
SCHEMA = "block long, doc_id array<long>, n_words array<int>, codes binary, words binary, carried array<long>"
FIELDS = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_id", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int32())),
        ("codes", pa.large_binary()),
        ("words", pa.large_binary()),
        ("carried", pa.list_(pa.int64())),
    ]
)


def narrow(codes: array, size: int) -> bytes:
    """Word numbers as 2 bytes each where the block has no more words than that, compressed."""
    import numpy as np
    import zstandard

    kind = np.uint16 if size <= 1 << 16 else np.uint32
    flat = np.frombuffer(codes, dtype=np.uint32).astype(kind)
    # bytes of one significance together compress better
    planes = flat.view(np.uint8).reshape(-1, kind().itemsize).T.tobytes() if len(flat) else b""
    return bytes([kind().itemsize]) + zstandard.ZstdCompressor(level=3).compress(planes)


def widen(packed: bytes):
    import numpy as np
    import zstandard

    width = packed[0]
    raw = zstandard.ZstdDecompressor().decompress(packed[1:])
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(np.uint16 if width == 2 else np.uint32).ravel()


def pack_words(words) -> bytes:
    """No word holds a white space, so a space joins them."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(" ".join(words).encode("utf-8", "surrogatepass"))


def unpack_words(packed: bytes) -> list[str]:
    import zstandard

    joined = zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")
    return joined.split(" ") if joined else []


def code_blocks(docs: DataFrame, split: Callable[[str], list[str]], block_bytes: int = BLOCK_BYTES, carry: str | None = None) -> DataFrame:
    """Blocks of (doc_id, text) rows, dealt out by block; ``split`` gives a text's words.

    ``carry`` names a column of whole numbers that goes with the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        block = (TaskContext.get().partitionId() << 24) - 1

        def out():
            row = [[block], [ids], [counts], [narrow(codes, len(number))], [pack_words(number)], [carried if carry else None]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, FIELDS)], schema=FIELDS)

        def numbers():
            """Each new word gets the next number when it is asked for."""
            found = defaultdict()
            found.default_factory = found.__len__
            return found

        ids, counts, codes, number, carried, size = [], [], array("I"), numbers(), [], 0
        for batch in batches:
            for key, text, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist() if carry else [None] * batch.num_rows):
                text = text.as_py()
                if ids and size + len(text) > block_bytes:
                    block += 1
                    yield out()
                    ids, counts, codes, number, carried, size = [], [], array("I"), numbers(), [], 0
                words = split(text)
                codes.frombytes(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)).tobytes())
                ids.append(key)
                carried.append(more)
                counts.append(len(words))
                size += len(text)
        if ids:
            block += 1
            yield out()
        number.clear()
        give_back()

    made = docs.select("doc_id", "text", *([carry] if carry else [])).mapInArrow(run, SCHEMA)
    # one exchange, which all that reads the blocks uses again
    return made.repartition(F.col("block"))
