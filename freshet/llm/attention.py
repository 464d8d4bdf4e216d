"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes cut at white space. Every passage is encoded
as shares of character classes and words, and hashed function-like features are left out, so the
encoding is short and the same in every language. A gated attention network scores passages,
a_i ~ exp(w . (tanh(V h_i) * sigmoid(U h_i))), the document is the attention-weighted mean of its
encoded passages, and a logistic layer on it gives the probability of label 1. Attention weights
are learned from document labels alone.

The network has under a thousand weights. It is fitted on the driver with a bounded sample of
labelled documents (``sample`` of each label, those with the smallest hashes), every passage of which
counts; scoring reads every passage of every text, too.

Null and empty texts are one empty passage and get a score like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import fold, give_back, texts

PASSAGE = 400
SAMPLE = 800
HIDDEN = 12
FOLDS = 5
THRESHOLD = 0.3

# --- encoding --------------------------------------------------------------------

CLASSES = ("lower", "upper", "digit", "space", "comma", "stop", "quote", "shout", "mark", "bar", "line", "wide", "other")


def _classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for name, signs in (("space", " \t\r"), ("comma", ",;:"), ("stop", ".?"), ("quote", "'\"()-"), ("shout", "!"), ("mark", "#$%&*@^~=+_<>\\/[]{}`"), ("bar", "|"), ("line", "\n")):
        table[[ord(c) for c in signs]] = CLASSES.index(name)
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[128:] = CLASSES.index("wide")
    return table


TABLE = _classes()
WIDTH = len(CLASSES) + 8


def passages(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of passages: each ends at the first white space from ``PASSAGE`` bytes on."""
    out, at, n = [], 0, len(raw)
    while n - at > PASSAGE + PASSAGE // 2:
        ends = [e for e in (raw.find(b" ", at + PASSAGE, at + 2 * PASSAGE), raw.find(b"\n", at + PASSAGE, at + 2 * PASSAGE)) if e >= 0]
        end = min(ends) + 1 if ends else min(n, at + 2 * PASSAGE)
        out.append((at, end))
        at = end
    out.append((at, n))
    return out


def encode(text: str) -> np.ndarray:
    """One row of features per passage."""
    raw = text.encode("utf-8", "surrogatepass")
    cuts = passages(raw)
    out = np.zeros((len(cuts), WIDTH), np.float32)
    kinds = TABLE[np.frombuffer(raw, np.uint8)]
    for i, (a, b) in enumerate(cuts):
        size = max(1, b - a)
        counts = np.bincount(kinds[a:b], minlength=len(CLASSES))
        share = counts / size
        words = raw[a:b].split()
        n = max(1, len(words))
        distinct = len(set(words))
        twice = sum(map(bytes.__eq__, words, words[1:]))
        letters = max(1, counts[0] + counts[1] + counts[11])
        out[i, : len(CLASSES)] = np.sqrt(share)
        out[i, len(CLASSES) :] = (
            distinct / n,
            twice / n,
            min(1.0, (b - a) / n / 16),
            counts[1] / letters,
            len(set(map(len, words))) / n,
            min(1.0, n / 64),
            min(2.0, (counts[7] + counts[8] + counts[9]) / n),
            min(2.0, (counts[4] + counts[5]) / n * 4),
        )
    return out


# --- network ---------------------------------------------------------------------


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    encode_w: np.ndarray
    encode_b: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    gate_w: np.ndarray
    out_w: np.ndarray
    out_b: np.ndarray

    LEARNED = ("encode_w", "encode_b", "gate_v", "gate_u", "gate_w", "out_w", "out_b")

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """rows: passages of all documents, one after the other; starts: where each begins."""
        x = (rows - self.mean) / self.scale
        h = np.tanh(x @ self.encode_w + self.encode_b)
        t, s = np.tanh(h @ self.gate_v), 1 / (1 + np.exp(-(h @ self.gate_u)))
        e = (t * s) @ self.gate_w
        sizes = np.diff(np.append(starts, len(rows)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.out_w + self.out_b, -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "owner": owner}

    def gradient(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        f = self.forward(rows, starts)
        d_logit = (f["p"] - labels) * weights
        d_z = d_logit[:, None] * self.out_w
        per = d_z[f["owner"]]
        d_a = (per * f["h"]).sum(1)
        d_e = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, starts)[f["owner"]])
        d_ts = d_e[:, None] * self.gate_w
        d_t, d_s = d_ts * f["s"] * (1 - f["t"] ** 2), d_ts * f["t"] * f["s"] * (1 - f["s"])
        d_h = f["a"][:, None] * per + d_t @ self.gate_v.T + d_s @ self.gate_u.T
        d_x = d_h * (1 - f["h"] ** 2)
        return {
            "encode_w": f["x"].T @ d_x + decay * self.encode_w,
            "encode_b": d_x.sum(0),
            "gate_v": f["h"].T @ d_t + decay * self.gate_v,
            "gate_u": f["h"].T @ d_s + decay * self.gate_u,
            "gate_w": (f["t"] * f["s"]).T @ d_e + decay * self.gate_w,
            "out_w": f["z"].T @ d_logit + decay * self.out_w,
            "out_b": np.array([d_logit.sum()]),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 3e-4, seed: int = 3) -> Network:
    """Adam on all bags at once; ``weights`` undo unequal sampling of the labels."""
    rng = np.random.default_rng(seed)
    rows, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1]
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    net = Network(rows.mean(0), rows.std(0) + 0.02, draw(WIDTH, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, HIDDEN), draw(HIDDEN, HIDDEN), draw(HIDDEN), draw(HIDDEN), np.zeros(1))
    share = weights / weights.sum()
    first = {k: np.zeros_like(getattr(net, k)) for k in net.LEARNED}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.LEARNED}
    for step in range(1, steps + 1):
        slope = net.gradient(rows, starts, labels, share, decay)
        for k in net.LEARNED:
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.99 * second[k] + 0.01 * slope[k] ** 2
            change = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            setattr(net, k, getattr(net, k) - change)
    return net


# --- tables ----------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Network | None:
    """A network from the labelled rows outside fold 0; None if there is no labelled row.

    Only (doc_id, quality) of the labels and the texts are read. Rows with a null id or a label
    other than 0 and 1 are left out; of a document labelled twice the smaller label counts, of texts with one id the
    one whose encoding is the smallest.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id"), folds) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return None
    chosen = None
    for label in sorted(counts):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * sample ids
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("l_id"), "quality"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                rows.append(encode(text.as_py()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], names=["doc_id", "quality", "bag"])

    own = texts(docs).where("doc_id is not null")
    found = own.join(ids, F.col("doc_id") == F.col("l_id")).select("doc_id", "quality", "text").mapInArrow(bags, "doc_id long, quality int, bag binary")
    # a row per sampled id, also where ids repeat
    rows = sorted(found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("bag").alias("bag")).collect(), key=lambda r: r.doc_id)
    if not rows:
        return None
    quality = np.array([r.quality for r in rows], float)
    had = {k: max(1, int((quality == k).sum())) for k in counts}
    weights = np.array([counts[r.quality] / had[r.quality] for r in rows])
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH).astype(float) for r in rows], quality, weights)


def score(docs: DataFrame, network: Network | None, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; without a network every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[float] = []
            for at in range(0, batch.num_rows, 64):
                bags = [encode(t.as_py()) for t in batch.column("text").slice(at, 64)]
                if network is None:
                    out += [0.5] * len(bags)
                else:
                    starts = np.cumsum([0, *map(len, bags)])[:-1]
                    out += network.forward(np.concatenate(bags), starts)["p"].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])
        give_back()

    rows = texts(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == 0)
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is at least the threshold."""

    @F.pandas_udf("double")
    def value(column):
        bags = [encode(t or "") for t in column]
        out = np.full(len(bags), 0.5)
        if network is not None:
            for at in range(0, len(bags), 64):
                part = bags[at : at + 64]
                out[at : at + len(part)] = network.forward(np.concatenate(part), np.cumsum([0, *map(len, part)])[:-1])["p"]
        return type(column)(out)

    return docs.where(value(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)
