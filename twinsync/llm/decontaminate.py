"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs between ASCII white space, case-folded and stripped of marks at both ends.
One pass over the corpus finds the documents that share a run of four words with a test
item.  Every such run is a seed, however many other documents hold it, so what is found in
a document depends on that document and the item alone.  Where the words around a hit hold
too few of the item's words for any alignment to reach ``THRESHOLD``, it is left at that;
elsewhere the item is aligned with them, and the best local alignment, as a share of the
item's words, is the score.  Copies with words swapped, added or left out still align.

Items longer than ``SEGMENT`` words are judged by segment, in as few even ones as that
length allows; the best one counts.  Items are
taken in blocks, so what every executor holds stays bounded however large the benchmark is.
Null and empty texts, and items of fewer than ``MIN_WORDS`` words (too short to tell a leak
from chance), match nothing.  Columns other than the key and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsync.llm.common import WordHashes, give_back, gram_hashes, releasing, rows_of, texts
from twinsync.session import cut

SEED_WORDS = 4
MIN_WORDS = 5
SEGMENT = 256
#: Words of test items that one block may hold; a block is sent to all executors (32 bytes a word).
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Least share of an item's words that an alignment must carry.
THRESHOLD = 0.5
FOUND = "doc_id bigint, digest binary, item_id bigint, score double, ends_at_word bigint"


class PlainWords(WordHashes):
    """Hashes of words without case and marks at their ends; 0 for a word of marks only."""

    def hashed(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace").casefold()
        a, b = 0, len(text)
        while a < b and not text[a].isalnum():
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        return xxhash.xxh3_64_intdigest(text[a:b].encode()) or 1 if a < b else 0


_hashes = PlainWords()


def release() -> None:
    """Forget the words met."""
    _hashes.clear()
    give_back()


def word_hashes(text: str) -> np.ndarray:
    found = _hashes.of(text.encode().split())
    return found[found != 0]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score and the place in ``passage`` where it ends (Smith-Waterman, linear gaps)."""
    n = len(passage)
    steps = GAP * np.arange(n + 1)
    above = np.zeros(n + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.zeros(n + 1)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0.0) - steps) + steps, 0.0)  # gaps along the row
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
        above = row
    return best, end


def segments(items: DataFrame) -> DataFrame:
    """item_id, seg and the word hashes of every segment of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in rows_of(batches, "item_id", "text"):
            out: list[tuple] = []
            for key, text in zip(keys, bodies, strict=True):
                words = word_hashes(text).view(np.int64)
                parts = max(1, -(-len(words) // SEGMENT))
                out += [(key, i, p.tolist()) for i, p in enumerate(np.array_split(words, parts)) if len(p) >= MIN_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                list(zip(*out, strict=True)) or [[], [], []], [pa.int64(), pa.int32(), pa.list_(pa.int64())], strict=True)],
                names=["item_id", "seg", "words"])

    return texts(items, "item_id").mapInArrow(releasing(run, release), "item_id bigint, seg int, words array<bigint>")


def sharing(docs: DataFrame, grams: np.ndarray) -> DataFrame:
    """Documents with a run of words from ``grams`` (sorted): doc_id, digest of the text, words, places and runs of the hits."""
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for keys, bodies in rows_of(batches, "doc_id", "text"):
            out: list[tuple] = []
            for key, text in zip(keys, bodies, strict=True):
                words = word_hashes(text)
                runs = gram_hashes(words, SEED_WORDS)
                at = np.searchsorted(known, runs)
                hit = np.nonzero(known[np.minimum(at, len(known) - 1)] == runs)[0]
                if len(hit):
                    out.append((key, hashlib.sha256(text.encode()).digest(), words.view(np.int64), hit, runs[hit].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True), [pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3], strict=True)],
                    names=["doc_id", "digest", "words", "places", "runs"])

    return texts(docs).mapInArrow(releasing(run, release), "doc_id bigint, digest binary, words array<bigint>, places array<bigint>, runs array<bigint>")


def windows(item: np.ndarray, body: np.ndarray, begins: set[int]) -> list[tuple[int, int]]:
    """The parts of ``body`` to align with: around each hit, if enough of the item's words are there; overlapping ones as one."""
    slack = len(item) // 2 + 2
    found: list[tuple[int, int]] = []
    for begin in sorted(begins):
        a, b = max(0, begin - slack), begin + len(item) + 2 * slack
        if round(np.isin(item, body[a:b]).sum() / len(item), 4) < THRESHOLD:
            continue  # an alignment scores a word of the item once at most
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


def _scores(shared: DataFrame, seeds: tuple[np.ndarray, ...], parts: list) -> DataFrame:
    sent = shared.sparkSession.sparkContext.broadcast((seeds, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, which, own), items = sent.value
        for columns in rows_of(batches, "doc_id", "digest", "words", "places", "runs"):
            out: list[tuple] = []
            for key, digest, words, places, runs in zip(*columns, strict=True):
                starts: dict[int, set[int]] = {}
                firsts, ends = (np.searchsorted(known, np.array(runs, np.int64), side).tolist() for side in ("left", "right"))
                for place, i, j in zip(places, firsts, ends, strict=True):
                    for part, at in zip(which[i:j].tolist(), own[i:j].tolist(), strict=True):
                        starts.setdefault(part, set()).add(place - at)
                body = np.array(words, np.int64)
                best: dict[int, tuple] = {}
                for part, begins in starts.items():
                    name, item = items[part]
                    for a, b in windows(item, body, begins):
                        score, end = align(item, body[a:b])
                        share = round(score / len(item), 4)
                        if share >= THRESHOLD and share > best.get(name, (0,))[0]:
                            best[name] = (share, a + end)
                out += [(key, digest, item, *found) for item, found in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True), [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.int64()], strict=True)],
                    names=["doc_id", "digest", "item_id", "score", "ends_at_word"])

    return shared.mapInArrow(releasing(run, release), FOUND)


def copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What was found, row by row of ``docs``: doc_id, digest (SHA-256 of the text), item_id, score, ends_at_word."""
    items = cut(segments(benchmark))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = total // BLOCK_WORDS + 1
    found = None

    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "seg"), F.lit(blocks)) == block)
        parts = [(r.item_id, np.array(r.words, np.int64)) for r in own.collect()]  # of one block, so bounded
        if not parts:
            continue
        listed = [gram_hashes(p.view(np.uint64), SEED_WORDS).view(np.int64) for _, p in parts]
        runs = np.concatenate(listed)
        which = np.repeat(np.arange(len(parts), dtype=np.int32), [len(r) for r in listed])
        places = np.concatenate([np.arange(len(r), dtype=np.int32) for r in listed])
        order = np.argsort(runs, kind="stable")
        shared = sharing(docs, np.unique(runs.view(np.uint64)))
        scored = _scores(shared, (runs[order], which[order], places[order]), parts)
        found = scored if found is None else found.unionByName(scored)
    return docs.sparkSession.createDataFrame([], FOUND) if found is None else found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item it holds a copy of: doc_id, item_id, score, ends_at_word."""
    return copies(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max_by("ends_at_word", "score").alias("ends_at_word"))
