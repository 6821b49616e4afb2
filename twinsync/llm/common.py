"""What the operators share: reading their columns, joins that hold under hot keys, word and chunk helpers."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync.session import configure

#: A key is hot when it holds more than this share of the rows, so there are fewer than ``1 / HOT_SHARE`` hot keys.
HOT_SHARE = 0.001


def prepared(spark: SparkSession) -> SparkSession:
    """Session options the operators rely on; small Arrow batches bound a Python worker's memory."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and text only, so further columns and their names do not matter; a null text counts as empty."""
    return docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def lookup_join(rows: DataFrame, entries: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join with one entry a key, where a key may hold most of the rows.

    ``weight`` in ``entries`` is the number of rows of the key.  Entries of hot keys are
    broadcast: their weights sum to the number of rows at most, so there are fewer than
    ``1 / HOT_SHARE`` of them at any size.  All other keys meet in a shuffle.
    """
    total = entries.agg(F.sum(weight)).first()[0] or 0
    hot = entries.where(F.col(weight) > total * HOT_SHARE)
    rest = entries.where(F.col(weight) <= total * HOT_SHARE)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], release: Callable[[], None]) -> Callable:
    """``run``, and ``release`` when its task ends: a worker lives on, what a stage remembered must not."""
    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return run_and_release


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


class WordHashes(dict):
    """64-bit hashes of words; a bounded cache, so it changes nothing but speed."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.hashed(word)
        return value

    def hashed(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by position; none when there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(count, np.uint64)
        for i in range(n):
            total = mixed(total + words[i:i + count])
    return total


#: White space next to a space: there a space need not begin a pre-token.
_ADJACENT = re.compile(r"\s | \s")
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


class Pieces:
    """Ids of texts, piece by piece: a piece that was met before is looked up.

    A text is split at every space between two characters that are not white space.  The
    public pattern's matches never cross such a place, as a match holds a space only at its
    start or in a run of white space; so the pieces' ids, one after the other, are the
    text's.  What is remembered is bounded (two generations of ``LIMIT`` pieces) and
    changes nothing but speed.
    """

    LIMIT = 800_000

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list[bytes]]):
        self.matches, self.encode_words = regex.compile(pattern).findall, encode_words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.edges: dict[str, bytes] = {}  # short first and last pieces

    def forget(self) -> None:
        self.known, self.older, self.edges = {}, {}, {}

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of the encoder's number type."""
        return list(map(b"".join, self.by_piece(batch)))

    def by_piece(self, batch: list[str]) -> Iterator[list[bytes]]:
        """The same, piece by piece."""
        firsts, split, lasts = self._split(batch)
        edge = self._meet(firsts, split, lasts)
        look = self.known.__getitem__
        for f, parts, e in zip(firsts, split, lasts, strict=True):
            yield [edge[f], *map(look, parts), edge[e]]

    def sizes(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of every text (two at least), then characters and bytes of ids of all pieces, text after text."""
        firsts, split, lasts = self._split(batch)
        edge = self._meet(firsts, split, lasts)
        inner = list(chain.from_iterable(split))
        n = np.fromiter(map(len, split), np.int64, len(split)) + 2
        ends = np.cumsum(n)
        places = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        places[ends - n] = places[ends - 1] = False
        out = [n]
        for within, first, last in (
                (np.fromiter(map(len, inner), np.int64, len(inner)) + 1, map(len, firsts), map(len, lasts)),
                (np.fromiter(map(len, map(self.known.__getitem__, inner)), np.int64, len(inner)),
                 (len(edge[f]) for f in firsts), (len(edge[e]) for e in lasts))):
            values = np.empty(len(places), np.int64)
            values[places] = within
            values[ends - n] = np.fromiter(first, np.int64, len(n))
            values[ends - 1] = np.fromiter(last, np.int64, len(n))
            out.append(values)
        return tuple(out)

    @staticmethod
    def _split(batch: list[str]) -> tuple[list[str], list[list[str]], list[str]]:
        """First pieces, words between spaces, last pieces; the outer ones may begin or end in white space."""
        split = [_BOUNDARY.split(t) if _ADJACENT.search(t) else t.split(" ") for t in batch]
        firsts = [parts.pop(0) for parts in split]
        return firsts, split, [" " + parts.pop() if parts else "" for parts in split]

    def _meet(self, firsts: list[str], split: list[list[str]], lasts: list[str]) -> dict[str, bytes]:
        """Make the words between spaces known; ids of the outer pieces."""
        if len(self.known) > self.LIMIT:
            self.known, self.older = {}, self.known
        if len(self.edges) > self.LIMIT // 4:
            self.edges = {}
        known, older, edges = self.known, self.older, self.edges
        new = list(set().union(*split).difference(known))
        if older:
            again = [word for word in new if word in older]
            known.update(zip(again, map(older.__getitem__, again), strict=True))
            new = [word for word in new if word not in known]
        ends = {*firsts, *lasts}
        odd = [piece for piece in ends if piece not in edges]
        ids = self._learn(new, odd) if new or odd else []
        known.update(zip(new, ids, strict=False))
        edge = {piece: edges[piece] for piece in ends if piece in edges} | dict(zip(odd, ids[len(new):], strict=True))
        edges.update((piece, edge[piece]) for piece in odd if len(piece) <= 64)
        return edge

    def _learn(self, words: list[str], odd: list[str]) -> list[bytes]:
        """Ids of `` word`` for words between spaces, which stay apart when joined, then of the odd pieces."""
        flat = self.matches(" " + " ".join(words)) if words else []
        sizes = [len(word) + 1 for word in words]
        for piece in odd:
            matches = self.matches(piece)
            flat += matches
            sizes.append(len(piece))
        distinct = list(set(flat))
        ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
        found = list(map(ids.__getitem__, flat))
        data = b"".join(found)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))))
        place = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        ends = place[np.searchsorted(at, np.cumsum(sizes))].tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(c).to_pylist() for c in columns)


def small_batches(keys: list, bodies: list[str], chars: int = 1 << 22) -> Iterator[tuple[list, list[str]]]:
    """Parts of a batch with about so many characters; a longer text is a part of its own."""
    start = size = 0
    for i, text in enumerate(bodies):
        if size and size + len(text) > chars:
            yield keys[start:i], bodies[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(bodies):
        yield keys[start:], bodies[start:]
