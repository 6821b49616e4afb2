"""Document quality by attention-based multiple-instance learning.

A text is cut into passages of ``PASSAGE_WORDS`` words (white space between them), all of
them.  Each passage is encoded by the shares of byte-class pairs, the share of distinct
words, word length and size.  Gated attention, tanh(V h) * sigmoid(U h), learned from document
labels alone, weighs the passages; the weighted representation gives the score.

The fit uses ``TRAINING_DOCS`` labelled documents (order of a hash of doc_id) and of each at most
``TRAINING_PASSAGES`` evenly spaced passages, so the driver holds a bounded matrix; scoring reads
every passage.  Null and empty texts are one passage without words and get a score.  Several
labels of one document are averaged; null labels are left out.  Without training rows of both
kinds the score is their mean label (0.5 without any).  Columns other than doc_id and text of
the documents, doc_id and quality of the labels, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsync.llm.common import WordHashes, give_back, mixed, releasing, rows_of, small_batches, texts

PASSAGE_WORDS = 100
TRAINING_DOCS, TRAINING_PASSAGES = 4000, 32
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 12, 40, 128, 0.01, 1e-4
THRESHOLD = 0.3
_hashes = WordHashes()


def release() -> None:
    """Forget the words met."""
    _hashes.clear()
    give_back()


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _classes() -> tuple[np.ndarray, int]:
    """Byte classes: letters by case, digits, white space, some marks each on its own, other marks, beyond ASCII."""
    table = np.full(256, 9, np.int64)
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = 0, 1, 2
    table[[9, 11, 12, 13, 32]], table[10], table[ord(".")], table[ord(",")], table[ord("!")], table[ord("|")] = 3, 4, 5, 6, 7, 8
    table[128:] = 10
    return table, 11


CLASS, KINDS = _classes()
FEATURES = KINDS * KINDS + 4


def passages(text: str) -> np.ndarray:
    """One row of features a passage."""
    data = text.encode()
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    raw = np.frombuffer(data, np.uint8)
    kind = CLASS[raw]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = ~blank
    starts[1:] &= blank[:-1]
    count = -(-len(words) // PASSAGE_WORDS)
    where = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE_WORDS
    pairs = np.bincount(where[:-1] * KINDS ** 2 + kind[:-1] * KINDS + kind[1:], minlength=count * KINDS ** 2).reshape(count, -1)
    hashes = _hashes.of(words)
    of = np.arange(len(words)) // PASSAGE_WORDS
    size = np.bincount(of, minlength=count)
    _, first = np.unique(mixed(hashes + of.astype(np.uint64)), return_index=True)
    distinct = np.bincount(of[first], minlength=count)
    length = np.bincount(of, np.fromiter(map(len, words), np.int64, len(words)), count)
    out = np.empty((count, FEATURES), np.float32)
    out[:, :-4] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    out[:, -4], out[:, -3] = distinct / size, np.minimum(length / size, 50) / 10
    out[:, -2], out[:, -1] = np.log1p(size) / 5, np.log1p(len(words)) / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Gated attention over passages, then a logistic score."""

    def __init__(self, constant: float = 0.5, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.constant: float | None = constant
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"V": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "U": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)),
                  "w": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "c": np.zeros(FEATURES), "b": np.zeros(1)}

    def _forward(self, h: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple:
        t, s = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        energy = (t * s) @ self.p["w"]
        weight = np.exp(energy - np.repeat(np.maximum.reduceat(energy, begins), sizes))
        weight /= np.repeat(np.add.reduceat(weight, begins), sizes)
        z = np.add.reduceat(h * weight[:, None], begins, axis=0)
        return t, s, weight, z, _sigmoid(z @ self.p["c"] + self.p["b"])

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        sizes = np.array([len(b) for b in bags])
        h = (np.concatenate(bags) - self.mean) / self.scale
        return self._forward(h, np.cumsum(sizes) - sizes, sizes)[-1]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Attention:
        """Adam on the logistic loss of the documents' labels."""
        if not len(labels):
            return self
        if labels.min() == labels.max():
            self.constant = float(labels[0])
            return self
        self.constant = None
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 0.01
        rng, step = np.random.default_rng(seed), 0
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for start in range(0, len(order), BATCH):
                some = order[start:start + BATCH]
                sizes = np.array([len(bags[i]) for i in some])
                h = (np.concatenate([bags[i] for i in some]) - self.mean) / self.scale
                begins = np.cumsum(sizes) - sizes
                t, s, a, z, y = self._forward(h, begins, sizes)
                wrong = (y - labels[some]) / len(some)
                to_z = np.repeat(wrong[:, None] * self.p["c"], sizes, axis=0)
                to_a = (h * to_z).sum(axis=1)
                to_e = a * (to_a - np.repeat(np.add.reduceat(a * to_a, begins), sizes))
                gate = to_e[:, None] * self.p["w"]
                grads = {"c": z.T @ wrong, "b": wrong.sum(keepdims=True), "w": (t * s).T @ to_e,
                         "V": h.T @ (gate * s * (1 - t * t)), "U": h.T @ (gate * t * s * (1 - s))}
                step += 1
                for k, g in grads.items():
                    m, v = moment[k]
                    g = g + DECAY * self.p[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] = self.p[k] - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame) -> Attention:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = (labels.where("quality is not null and doc_id is not null").where(~held_out())
             .groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCS)
    sample = texts(docs).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, labels_, bodies in rows_of(batches, "doc_id", "label", "text"):
            bags = []
            for text in bodies:
                found = passages(text)
                even = np.unique(np.linspace(0, len(found) - 1, min(len(found), TRAINING_PASSAGES)).astype(int))
                bags.append(found[even].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels_, pa.float64()), pa.array(bags, pa.binary())],
                                             names=["doc_id", "label", "bag"])

    rows = sample.mapInArrow(releasing(run, release), "doc_id bigint, label double, bag binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows.column("bag").to_pylist()]
    return Attention().fit(bags, rows.column("label").to_numpy())


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for keys, bodies in rows_of(batches, "doc_id", "text"):
            for some, part in small_batches(keys, bodies, 1 << 20):
                found = np.round(fitted.scores([passages(text) for text in part]), 6)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found, pa.float64())], names=["doc_id", "score"])

    found = texts(docs).mapInArrow(releasing(run, release), "doc_id bigint, score double")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
