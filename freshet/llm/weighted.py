"""Document fingerprints by consistent weighted sampling.

A text is a bag of its lower-cased words, weighted by their counts. For every word and sample k,
hashes of the word seed r and c ~ Gamma(2, 1) and b ~ Uniform(0, 1); the word of weight w has
t = floor(ln w / r + b), ln y = r (t - b) and ln a = ln c - ln y - r. Sample k is the word with the
least a, together with its t. Two texts agree in a sample with the probability of their generalised
Jaccard similarity, the sum of least weights over the sum of greatest.

The fingerprint is 16 bits of each of ``SAMPLES`` samples as hexadecimal digits; the likeness of
two is the share of equal samples. A text without words has a fingerprint of its own, all zeros,
which is like that of every other such text and in no sample like one with words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from freshet.llm.common import give_back, texts

SAMPLES = 64
SEED = 11
LIGHT, HEAVY = 80_000, 15_000  # words whose numbers a task keeps at a time
# fixed values: the white space that parts words, ASCII only
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 32-bit numbers, in place (the finaliser of MurmurHash3)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


class Store:
    """Rows of numbers for the words seen last; all are dropped when it is full."""

    def __init__(self, most: int, make):
        self.most, self.make = most, make
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held: list[np.ndarray] = []

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Where the words' rows are, made if need be; ``words`` are distinct."""
        if len(self.place) + len(words) > max(self.most, len(words)):
            self.clear()
        fresh = [w for w in words if w not in self.place]
        for at in range(0, len(fresh), 2048):
            part = fresh[at : at + 2048]
            made, n = self.make(part), len(self.place)
            if not self.held:
                self.held = [np.empty((0, *m.shape[1:]), m.dtype) for m in made]
            if n + len(part) > len(self.held[0]):
                size = max(min(2 * len(self.held[0]), self.most), n + len(part), 4096)
                for i, old in enumerate(self.held):
                    new = np.empty((size, *old.shape[1:]), old.dtype)
                    new[:n] = old[:n]
                    self.held[i] = new
            for array, m in zip(self.held, made):
                array[n : n + len(part)] = m
            self.place.update(zip(part, range(n, n + len(part))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


class Sampler:
    """The samples of texts. Numbers of words are kept: ln a of weight one, and those of heavier words."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        self.samples = samples
        lanes = np.arange(5 * samples, dtype=np.uint64) + np.uint64(seed << 20)
        self.lanes = _mix(lanes * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32).reshape(5, samples)
        self.light, self.heavy = Store(LIGHT, self._once), Store(HEAVY, self._numbers)

    def clear(self) -> None:
        self.light.clear()
        self.heavy.clear()

    def _numbers(self, words: list[bytes]) -> list[np.ndarray]:
        """r, b and ln c of every word and sample, and the words' hashes."""
        import xxhash

        tags = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
        low, high = tags.astype(np.uint32)[:, None], (tags >> np.uint64(32)).astype(np.uint32)[:, None]

        def uniform(lane: int) -> np.ndarray:
            x = _mix32(low ^ self.lanes[lane])
            x ^= high
            x = _mix32(x)
            x >>= np.uint32(8)
            u = x.astype(np.float32)
            u += np.float32(0.5)
            u *= np.float32(2.0**-24)
            return u

        def gamma(lane: int) -> np.ndarray:
            u = uniform(lane)
            u *= uniform(lane + 1)
            np.log(u, out=u)
            return np.negative(u, out=u)

        log_c = gamma(2)
        return [gamma(0), uniform(4), np.log(log_c, out=log_c), tags]

    def _once(self, words: list[bytes]) -> list[np.ndarray]:
        """ln a of weight one, for which t is floor(b) = 0."""
        r, b, log_c, tags = self._numbers(words)
        b -= 1
        b *= r
        b += log_c
        return [b, tags]

    def samples_of(self, text: str) -> np.ndarray:
        counts: dict[bytes, int] = {}
        for w in text.encode("utf-8", "surrogatepass").translate(LOWER).split():
            counts[w] = counts.get(w, 0) + 1
        if not counts:
            return np.zeros(self.samples, np.uint16)
        least = np.full(self.samples, np.inf, np.float32)
        best = np.zeros(self.samples, np.uint64)
        lanes = np.arange(self.samples)
        items = list(counts.items())
        for at in range(0, len(items), 4096):
            part = items[at : at + 4096]
            rows = self.light.rows([w for w, _ in part])
            log_a, tags = self.light.held[0].take(rows, 0), self.light.held[1].take(rows)
            steps = np.zeros(self.samples, np.int64)
            many = [i for i, (_, c) in enumerate(part) if c > 1]
            if many:
                own = self.heavy.rows([part[i][0] for i in many])
                r, b, log_c = (held.take(own, 0) for held in self.heavy.held[:3])
                t = np.floor(np.log(np.array([part[i][1] for i in many], np.float32))[:, None] / r + b)
                log_a[many] = log_c - r * (t - b) - r
            low = log_a.argmin(0)
            if many:
                at_many = np.full(len(part), -1)
                at_many[many] = np.arange(len(many))
                got = at_many[low]
                steps = np.where(got >= 0, t[got, lanes], 0).astype(np.int64)
            value = log_a[low, lanes]
            chosen = _mix(tags[low] ^ (steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            better = value < least
            least, best = np.where(better, value, least), np.where(better, chosen, best)
        return np.maximum((best >> np.uint64(48)).astype(np.uint16), 1)  # zero is for texts without words

    def hexadecimal(self, text: str) -> str:
        return self.samples_of(text).astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row; equal texts have equal ones; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            found = [sampler.hexadecimal(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])
        sampler.clear()
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    each = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.when(F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4)), 1).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda x, y: x + y) / F.lit(float(samples))


def followed(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): the text of the row with the next smaller doc_id; the last
    row's next is the first. Texts are zstd-compressed.

    Rows are dealt over ranges of doc_id, so no task sees them all; only each range's first row
    goes to the row before it. Ties are in a fixed order, that of the
    compressed texts; null ids come last; a single row is
    its own next.
    """
    import zstandard

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            held = [press.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            key = batch.column(0)
            # the number of cuts above the id: ranges are in descending order of it, null ids come last
            place = len(cuts) - np.searchsorted(cuts, key.fill_null(0).to_numpy(), side="right")
            place = np.where(key.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, place)
            yield pa.RecordBatch.from_arrays([key, pa.array(held, pa.binary()), pa.array(place.astype(np.int32))], names=["doc_id", "text", "range"])

    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first().c if parts > 1 else None
    cuts = np.unique(np.array(found or [], np.int64))  # as many as partitions, a setting
    # the compressed texts are shuffled once; all that follows reads that exchange
    # (a range is never null; a filter on it below the exchange would make a second exchange)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("range", T.IntegerType(), False)])
    rows = texts(docs).mapInArrow(squeeze, schema).repartition("range")
    around = Window.orderBy("range")  # one row per range
    ranges = rows.select("range").distinct().withColumn("n_range", F.coalesce(F.lead("range").over(around), F.min("range").over(Window.partitionBy())))
    inner = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), F.asc("text"))
    led = rows.withColumns({"next_text": F.lead("text").over(inner), "first": F.row_number().over(inner) == 1})
    heads = led.where("first").select(F.col("range").alias("n_range"), F.col("text").alias("head"))
    tails = led.where("next_text is null").select("doc_id", "text", "range").join(ranges, "range").join(heads, "n_range")
    return led.where("next_text is not null").select("doc_id", "text", "next_text").union(tails.select("doc_id", "text", F.col("head").alias("next_text")))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        sampler, loose = Sampler(samples), zstandard.ZstdDecompressor()
        read = lambda v: loose.decompress(v.as_py()).decode("utf-8", "surrogatepass")
        last: tuple[bytes, str] | None = None
        for batch in batches:
            rows = []
            for held, next_held in zip(batch.column("text"), batch.column("next_text")):
                text, following = read(held), read(next_held)
                new = edited(text, following)
                # rows of a range follow each other, so the next text's fingerprint is mostly at hand
                own = last[1] if last and last[0] == text else sampler.hexadecimal(text)
                after = own if following == text else sampler.hexadecimal(following)
                last = (following, after)
                changed = own if new == text else sampler.hexadecimal(new)
                a, b, c = (np.frombuffer(bytes.fromhex(h), np.uint16) for h in (own, changed, after))
                sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(text), sha, own, changed, float((a == b).mean()), float((a == c).mean())))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=NAMES)
        sampler.clear()
        give_back()

    return followed(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
