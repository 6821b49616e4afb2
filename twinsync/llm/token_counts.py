"""Token counts that follow edits without counting whole documents again.

A document's pre-tokens lie in leaves of about ``LEAF_CHARS`` characters, each ending where
a space stands between two characters that are not white space: no pre-token crosses such a
place, so a leaf can be encoded alone.  A segment tree over the leaves holds sums of
characters and tokens.  An edit takes the leaves it touches plus those whose boundary it
could undo, encodes that stretch anew and updates the sums on the paths to the root.

``build`` gives the leaves to keep (two small numbers each), ``apply`` brings documents,
kept leaves and edits together by doc_id and gives the counts before and after with the new
leaves.  The edits of many documents are done in rounds, the first of each, then the second
of each, so the stretches of a round are encoded together; a document's own edits stay in
order of ``seq``.  Leaves of another text than the document's are built again.

An edit replaces ``length`` characters from ``start`` by ``replacement``; what lies outside the
text is cut off, nulls count as 0 and empty.  Null texts are empty, with no tokens.  Edits of
unknown documents change nothing; rows with one doc_id all get its edits; rows with a null
doc_id get none.  Edits with the same seq apply in the order of start, length, replacement.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsync.llm.bpe import Encoder, encoder, release, vocabulary_name
from twinsync.llm.common import releasing, rows_of, small_batches, texts

LEAF_CHARS = 256
#: A leaf may grow to so many times its size before the leaves are cut anew.
GROWN = 8
#: About so many characters of documents, or of their edits, wait in a task for the next rounds.
ROUND_CHARS = 1 << 22
_NONE = np.zeros(1, np.int64)
STATE = "doc_id bigint, text_hash bigint, leaf_chars array<int>, leaf_tokens array<int>"
_INT = pa.list_(pa.int32())


def leaves(code: Encoder, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Characters and tokens of every leaf of each text; a leaf begins at the piece that holds a multiple of ``LEAF_CHARS``."""
    if not batch:
        return []
    n, chars, tokens = code.pieces.sizes(batch)
    first = np.cumsum(n) - n
    ends = np.cumsum(chars)
    starts = ends - chars
    before = np.repeat(starts[first], n)  # characters of the texts before
    begins = -(-(starts - before) // LEAF_CHARS) * LEAF_CHARS < ends - before
    begins[first] = True
    at = np.flatnonzero(begins)
    cuts = np.searchsorted(at, first)[1:]
    sums = (np.add.reduceat(chars, at), np.add.reduceat(tokens, at) // code.kind.itemsize)
    return list(zip(*(np.split(values, cuts) for values in sums), strict=True))


class TokenTree:
    """Segment trees of characters and tokens over a text's leaves."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.recounted = text, 0
        self.fill(chars, tokens)

    def fill(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = max(1, len(chars))
        self.width = 1 << (self.n - 1).bit_length()
        self.sums = []
        for values in (chars, tokens):
            tree = np.zeros(2 * self.width, np.int64)
            tree[self.width:self.width + len(values)] = values
            level = self.width
            while level > 1:
                tree[level // 2:level] = tree[level:2 * level:2] + tree[level + 1:2 * level:2]
                level //= 2
            self.sums.append(tree.tolist())

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, start, chars = 1, 0, self.sums[0]
        while node < self.width:
            node *= 2
            if place >= start + chars[node]:
                start += chars[node]
                node += 1
        return min(node - self.width, self.n - 1), start

    def _write(self, leaf: int, chars: int, tokens: int) -> None:
        for tree, value in zip(self.sums, (chars, tokens), strict=True):
            node = leaf + self.width
            change = value - tree[node]
            while node and change:
                tree[node] += change
                node >>= 1

    def touch(self, start: int, length: int, replacement: str) -> str:
        """Edit the text; the stretch whose leaves ``settle`` has to get before the next edit."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(start + max(length, 0), size)
        low, begin = self.leaf(max(0, start - 2))  # a leaf's first two characters and the one before hold its boundary
        high, at = self.leaf(min(end + 1, max(0, size - 1))) if size else (0, 0)
        stop = at + self.sums[0][high + self.width]
        if size and start - 2 <= 0:
            low, begin = 0, 0
        if stop >= size or high == self.n - 1:
            high, stop = self.n - 1, size
        stretch = self.text[begin:start] + replacement + self.text[end:stop]
        self.text = self.text[:start] + replacement + self.text[end:]
        self.recounted += len(stretch)
        self.low, self.high = low, high
        return stretch

    def settle(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        low, high = self.low, self.high
        room = high - low + 1
        if len(chars) > room:
            rest = int(chars[room - 1:].sum())
            if rest > GROWN * LEAF_CHARS:
                kept = [np.array(t[self.width:self.width + self.n]) for t in self.sums]
                self.fill(*(np.concatenate((old[:low], new, old[high + 1:])) for old, new in zip(kept, (chars, tokens), strict=True)))
                return
            chars = np.append(chars[:room - 1], rest)
            tokens = np.append(tokens[:room - 1], tokens[room - 1:].sum())
        for i in range(room):
            some = i < len(chars)
            self._write(low + i, int(chars[i]) if some else 0, int(tokens[i]) if some else 0)

    def leaves(self) -> tuple[list[int], list[int]]:
        chars, tokens = (tree[self.width:self.width + self.n] for tree in self.sums)
        some = [i for i in range(self.n) if chars[i]] or [0]
        return [chars[i] for i in some], [tokens[i] for i in some]


def in_rounds(code: Encoder, work: list[tuple[list[TokenTree], list[tuple[int, int, str]]]]) -> None:
    """Every document's edits in their order: the first of all documents together, then the second of all, and so on."""
    turn = 0
    while work:
        trees, stretches, size = [], [], 0
        for own, edits in work:
            for tree in own:
                trees.append(tree)
                stretches.append(tree.touch(*edits[turn]))
                size += len(stretches[-1])
                if size > ROUND_CHARS:
                    _settle(code, trees, stretches)
                    trees, stretches, size = [], [], 0
        _settle(code, trees, stretches)
        turn += 1
        work = [(own, edits) for own, edits in work if turn < len(edits)]


def _settle(code: Encoder, trees: list[TokenTree], stretches: list[str]) -> None:
    for tree, found in zip(trees, leaves(code, stretches), strict=True):
        tree.settle(*found)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


class _Open:
    """A document whose edits are still read: its rows' trees, and what has not been done yet."""

    def __init__(self, key: int | None):
        self.key, self.made = key, 0
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.trees: list[TokenTree] = []
        self.bare: list[TokenTree] = []
        self.before: list[int] = []
        self.edits: list[tuple[int, int, str]] = []


def _lists(column: pa.ListArray) -> Callable[[int], np.ndarray]:
    """Row i of a list column as an array of its own."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return lambda i: values[offsets[i]:offsets[i + 1]].astype(np.int64)


def build(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The leaves of every document, to be kept."""
    sent, name = docs.sparkSession.sparkContext.broadcast(ranks), vocabulary_name(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(name, sent.value, pattern)
        for keys, bodies in rows_of(batches, "doc_id", "text"):
            for some, part in small_batches(keys, bodies):
                found = leaves(code, part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([_hash(t) for t in part], pa.int64()),
                     pa.array([c for c, _ in found], _INT), pa.array([t for _, t in found], _INT)],
                    names=["doc_id", "text_hash", "leaf_chars", "leaf_tokens"])

    return texts(docs).mapInArrow(releasing(run, release), STATE)


def apply(docs: DataFrame, state: DataFrame, edits: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, tokens_before, n_tokens, n_chars, n_edits, recounted_chars, text and leaves after the edits."""
    spark = docs.sparkSession
    sent, name = spark.sparkContext.broadcast(ranks), vocabulary_name(ranks, pattern)
    none, numbers = F.lit(None).cast("bigint"), F.lit(None).cast("array<int>")
    body = texts(docs).select("doc_id", F.lit(1).alias("kind"), none.alias("seq"), none.alias("start"), none.alias("length"), "text",
                              numbers.alias("chars"), numbers.alias("tokens"))
    kept = state.where("doc_id is not null").select("doc_id", F.lit(0), F.col("text_hash"), none, none, F.lit(None).cast("string"),
                                                    "leaf_chars", "leaf_tokens")
    zero = F.lit(0)
    change = edits.where("doc_id is not null").select(
        "doc_id", F.lit(2), F.col("seq").cast("bigint"), F.coalesce(F.col("start").cast("bigint"), zero),
        F.coalesce(F.col("length").cast("bigint"), zero), F.coalesce("replacement", F.lit("")), numbers, numbers)
    order = ["doc_id", "kind", "seq", "start", "length", "text"]
    # Rows without a doc_id are documents of their own, so they need not meet in one task.
    spread = F.coalesce("doc_id", F.xxhash64("text"))
    rows = body.union(kept).union(change).repartition(spread).sortWithinPartitions(*order)
    layout = pa.schema([(c, pa.int64()) for c in ("doc_id", "tokens_before", "n_tokens", "n_chars", "n_edits", "recounted_chars")]
                       + [("text", pa.string()), ("leaf_chars", _INT), ("leaf_tokens", _INT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(name, sent.value, pattern)

        open_docs: list[_Open] = []
        size = waiting = 0

        def rounds() -> None:
            """Leaves of texts without kept ones, then all edits that wait."""
            unknown = [tree for doc in open_docs for tree in doc.bare]
            for part in small_batches(unknown, [tree.text for tree in unknown], ROUND_CHARS):
                for tree, found in zip(part[0], leaves(code, part[1]), strict=True):
                    tree.fill(*found)
            for doc in open_docs:
                doc.bare = []
                doc.before += [tree.tokens for tree in doc.trees[len(doc.before):]]
            in_rounds(code, [(doc.trees, doc.edits) for doc in open_docs if doc.edits and doc.trees])
            for doc in open_docs:
                doc.edits = []

        def done(docs: list[_Open]) -> pa.RecordBatch:
            out = [(doc.key, before, tree.tokens, len(tree.text), doc.made, tree.recounted, tree.text, *tree.leaves())
                   for doc in docs for tree, before in zip(doc.trees, doc.before, strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * len(layout)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, layout, strict=True)], schema=layout)

        for batch in batches:
            kept = [_lists(batch.column(c)) for c in ("chars", "tokens")]
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "kind", "seq", "start", "length", "text"))
            for i, (key, kind, seq, start, length, text) in enumerate(zip(*columns, strict=True)):
                if not open_docs or key is None or key != open_docs[-1].key:
                    if size > ROUND_CHARS:
                        rounds()
                        yield done(open_docs)
                        open_docs, size, waiting = [], 0, 0
                    open_docs.append(_Open(key))
                doc = open_docs[-1]
                if kind == 0:
                    doc.known[seq] = kept[0](i), kept[1](i)
                elif kind == 1:
                    found = doc.known.get(_hash(text))
                    tree = TokenTree(text, *(found or (_NONE, _NONE)))
                    doc.trees.append(tree)
                    if found is None:
                        doc.bare.append(tree)
                    size += len(text) + 200
                else:
                    doc.made += 1
                    doc.edits.append((start, length, text))
                    waiting += len(text) + 200
                    if waiting > ROUND_CHARS:
                        rounds()
                        waiting = 0
        rounds()
        yield done(open_docs)

    return rows.mapInArrow(releasing(run, release), "doc_id bigint, tokens_before bigint, n_tokens bigint, n_chars bigint, n_edits bigint, "
                                                    "recounted_chars bigint, text string, leaf_chars array<int>, leaf_tokens array<int>")
