"""Language identification by bit-sliced Bloom filters of character n-grams.

Each place of the filter is a mask with one bit a language.  A language holds an n-gram
when the n-gram's rate in its texts is at least ``HELD`` of the highest rate among the
languages and it occurs in ``SUPPORT`` training texts or more.  Looking an n-gram up is the
AND of a few masks: all languages that hold it, at once.  Over a text's n-grams the bits are
counted by language and corrected for false positives by each bit's share of set places;
the language with the largest corrected count is the answer, its share of the sum of the
two best the score.

N-grams are runs of ``SIZES`` characters over the lower-cased text with all that is not a
letter as one space.  A text without a letter (or null) is ``und`` with score 0.  A text with
letters none of whose n-grams is known gets the most frequent language, also with score 0.
Ties go to the name that sorts first.  Without training rows everything is ``und``.  Only
text and lang are read, and doc_id for the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from twinsync.llm.common import mixed, rows_of, small_batches, texts
from twinsync.session import cut

SIZES = (3, 5)
PLACES_LOG2, PROBES = 21, 3
HELD, SUPPORT = 0.2, 3
#: Training texts over all languages, and of each one at least (or all it has), as expected: those with the least hash of doc_id.
TRAINING_TEXTS, LEAST_TEXTS = 20_000, 1_000
#: Languages beyond this number (one bit each) are an error, not a guess.
MOST_LANGUAGES = 63
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def training_row() -> Column:
    """The documents to learn from: CRC-32 of doc_id as text, modulo 3, is not 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def lettered(text: str) -> bool:
    """Whether a text has a letter; combining marks alone are none."""
    return _LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """64-bit hashes of all character n-grams of a text, with repeats; empty without a letter."""
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not plain:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for size in SIZES:
            n = len(codes) - size + 1
            if n > 0:
                total = np.full(n, size, np.uint64)
                for i in range(size):
                    total = total * np.uint64(0x100000001B3) + codes[i:i + n]
                out.append(mixed(total))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def places(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << PLACES_LOG2) - 1)
    return [((hashes >> np.uint64(shift)) & mask).astype(np.int64) for shift in (0, PLACES_LOG2, 64 - PLACES_LOG2)][:PROBES]


def _counted(docs: DataFrame) -> DataFrame:
    """lang, gram, occurrences, texts: summed by task, then by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64()), ("texts", pa.int64())])
        for langs, bodies in rows_of(batches, "lang", "text"):
            for some, part in small_batches(langs, bodies):
                by: dict[str, list[tuple]] = {}
                for lang, text in zip(some, part, strict=True):
                    by.setdefault(lang, []).append(np.unique(grams(text), return_counts=True))
                for lang, found in by.items():
                    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                    count = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)),
                                                      pa.array(count), pa.array(np.bincount(at, minlength=len(keys)))], schema=layout)

    return (docs.mapInArrow(run, "lang string, gram bigint, n bigint, texts bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")))


class Filters:
    """Languages and their masks by place."""

    def __init__(self, languages: list[str], masks: np.ndarray, usual: str = "und"):
        self.languages, self.masks, self.usual = languages, masks, usual
        bits = np.arange(len(languages), dtype=np.uint64)
        full = np.array([((masks >> b) & np.uint64(1)).mean() for b in bits]) if languages else np.zeros(0)
        self.bits, self.false = bits, full ** PROBES

    def judge(self, text: str) -> tuple[str, float]:
        if not self.languages or not lettered(text):
            return "und", 0.0
        hashes = grams(text)
        first, *rest = places(hashes)
        held = self.masks[first]
        for place in rest:
            held = held & self.masks[place]
        kinds, many = np.unique(held, return_counts=True)
        counts = (((kinds[None, :] >> self.bits[:, None]) & np.uint64(1)) * many).sum(axis=1)
        true = np.maximum(0.0, (counts - len(hashes) * self.false) / (1 - np.minimum(self.false, 0.999)))
        best = int(true.argmax())
        if true[best] <= 0:
            return self.usual, 0.0
        second = np.delete(true, best).max(initial=0.0)
        return self.languages[best], float(round(true[best] / (true[best] + second), 6))


def learn(docs: DataFrame) -> Filters:
    """Filters from the training rows with a language; their size does not depend on the corpus."""
    rows = docs.where(F.col("lang").isNotNull() & training_row() & F.col("text").isNotNull())
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts_of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(texts_of) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; a mask holds {MOST_LANGUAGES}")
    if not texts_of:
        return Filters([], np.zeros(1 << PLACES_LOG2, np.uint64))
    part = TRAINING_TEXTS / sum(texts_of.values())
    parts = F.create_map(*[F.lit(x) for lang, n in texts_of.items() for x in (lang, float(max(part, LEAST_TEXTS / n)))])
    place = F.xxhash64("doc_id") / F.lit(2.0 ** 64) + 0.5  # of a document among all, by hash
    counted = cut(_counted(rows.where(place <= parts[F.col("lang")]).select("lang", "text")))
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    masks = np.zeros(1 << PLACES_LOG2, np.uint64)
    if not languages:
        return Filters([], masks)
    total = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(max(1, v))))])
    bit = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(1 << i))])
    rated = counted.withColumn("rate", F.col("n") / total[F.col("lang")])
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    held = (rated.join(top, "gram").where((F.col("rate") >= HELD * F.col("top")) & (F.col("texts") >= SUPPORT))
            .groupBy("gram").agg(F.bit_or(bit[F.col("lang")]).alias("mask")))
    mask = F.lit((1 << PLACES_LOG2) - 1)
    spots = F.array(*[F.shiftrightunsigned("gram", s).bitwiseAND(mask) for s in (0, PLACES_LOG2, 64 - PLACES_LOG2)][:PROBES])
    slices = held.select(F.explode(spots).alias("place"), "mask").groupBy("place").agg(F.bit_or("mask").alias("mask"))
    found = slices.toArrow()  # as many rows as the filter has places, at most
    masks[found.column("place").to_numpy()] = found.column("mask").to_numpy().astype(np.uint64)
    return Filters(languages, masks, min(languages, key=lambda lang: (-texts_of[lang], lang)))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for keys, bodies in rows_of(batches, "doc_id", "text"):
            judged = [model.judge(text) for text in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([j[0] for j in judged], pa.string()),
                                              pa.array([j[1] for j in judged], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = texts(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(~training_row(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def told(text: Column, filters: Filters) -> Column:
    """Whether a text has a language, as ``identify`` tells it within its row; without filters, whether it has a letter."""
    sent = SparkSession.active().sparkContext.broadcast(filters)

    @arrow_udf("boolean")
    def judged(bodies: pa.Array) -> pa.Array:
        model = sent.value
        return pa.array([model.judge(body)[0] != "und" if model.languages else lettered(body) for body in bodies.to_pylist()], pa.bool_())

    return judged(F.coalesce(text.cast("string"), F.lit("")))
