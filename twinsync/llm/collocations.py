"""Phrase collocations: phrases that occur far more often than their parts would make them.

Weighted acyclic automata over words, one per shard of text and prefix range:

1. Shards.  A task counts the phrases of up to ``longest`` words of some megabytes of text at a
   time and builds count transducers from the sorted phrases: a path spells a phrase, the
   weight of its last arc is the count, and states with equal futures are one state.
2. Union.  The transducers are cut at the bounds of prefix ranges, which all shards share.  A
   range's transducers meet in one partition, in order of their first phrase, and their
   weights are summed; what lies before the next one's first phrase is complete.  A phrase that
   is rarer than the least count can be neither a candidate nor a part of one and goes here.
3. Composition.  Every range writes the parts of its candidates as a transducer, whose weights are
   the largest counts of a candidate that holds the part, and sends it, cut, to the ranges that own
   the parts.  Composed with those ranges' counts it gives the parts' counts, which go
   back, and tells which candidates lie inside a longer one that is nearly as frequent.

Bounds of ranges come from a sample of documents and only balance the work.  Everything is kept
apart by ``lang``; a null lang is ``und``.  A null text is empty.  Repeated rows count each time.  An
empty table gives no rows; other columns are ignored.  Equal scores and counts are ordered by the
phrase's UTF-8 bytes.  One text and a bounded part of a range have to fit into a task's memory.
"""

from __future__ import annotations

import bisect
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsync.llm.common import mixed
from twinsync.session import cut

#: Bytes of text that a shard's counts are made from.
SHARD_BYTES = 16 << 20
#: Characters of text a prefix range stands for, unless there would be more than ``MOST_RANGES``.
RANGE_CHARS = 8 << 20
MOST_RANGES = 16_384
#: Documents sampled, about, for the bounds of ranges; bytes between the phrases taken from them; most phrases taken.
SAMPLED, APART, MOST_SAMPLED = 20_000, 1_000, 500_000
#: Longest phrases in one written transducer, and phrases that a union holds before it gives out what is complete.
PIECE, HELD = 1 << 17, 3_000_000

# The ends of pieces; letters that are lowered.  No UTF-8 text holds the byte 0xFF.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)

_COUNTS, _PARTS, _ANSWERS, _DROPPED, _TOTAL = range(5)
_BLOBS = "range int, lang string, kind int, origin int, low array<binary>, blob binary, n bigint"
_FOUND = "lang string, phrase binary, a bigint, l bigint, r bigint, score bigint"


# Sets of phrases with weights ---------------------------------------------------------


def _keys(ids: np.ndarray, size: int) -> np.ndarray:
    """Numbers in the order of the rows of word numbers; equal rows have equal ones."""
    bits = max(1, size.bit_length())
    key = ids[:, 0].astype(np.int64)
    for c in range(1, ids.shape[1]):
        if bits * (c + 1) > 62:
            key = np.unique(key, return_inverse=True)[1]  # ranks, so that 32 more bits fit
            key = key << 31 | ids[:, c]
        else:
            key = key << bits | ids[:, c]
    return key


def _combined(ids: np.ndarray, weights: np.ndarray, size: int, how: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, each once, with their weights combined."""
    if not len(ids):
        return ids, weights
    key = _keys(ids, size)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return ids[order[starts]], how.reduceat(weights[order], starts)


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every stretch, one after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)


def _dump(arrays: list[np.ndarray], words: list[bytes]) -> bytes:
    out = [struct.pack("<I", len(arrays))]
    for x in arrays:
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
        out += [struct.pack("<BQ", x.itemsize, len(x)), x.tobytes()]
    return zstandard.compress(b"".join(out) + b"\n".join(words), 1)


def _load(blob: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    data = zstandard.decompress(blob)
    (count,), at, arrays = struct.unpack_from("<I", data), 4, []
    for _ in range(count):
        size, n = struct.unpack_from("<BQ", data, at)
        arrays.append(np.frombuffer(data, f"<u{size}", n, at + 9).astype(np.int64))
        at += 9 + size * n
    return arrays, data[at:].split(b"\n")


class Transducer:
    """Phrases with weights above 0; written as an acyclic automaton, worked on as sorted rows.

    ``words`` are sorted; ``levels[n - 1]`` has the phrases of ``n`` words, as rows of word numbers in
    order, and their weights.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    def __len__(self) -> int:
        return sum(len(ids) for ids, _ in self.levels)

    # The automaton ------------------------------------------------------------------

    def to_bytes(self) -> bytes:
        """Arcs of all states, from the root; states are numbered by level and shared where equal."""
        size, depth = len(self.words), len(self.levels)
        nodes: list[tuple[np.ndarray, np.ndarray]] = [self.levels[-1]]
        for ids, weights in self.levels[-2::-1]:  # every prefix is a node; one that is no phrase weighs 0
            above = nodes[-1][0][:, :-1]
            nodes.append(_combined(np.concatenate((ids, above)), np.concatenate((weights, np.zeros(len(above), np.int64))), size))
        nodes.reverse()
        arrays: list[np.ndarray] = []
        target = np.zeros(len(nodes[-1][0]), np.int64)  # the last level's arcs all lead to the final state
        for n in range(depth - 1, -1, -1):
            ids, weights = nodes[n]
            if n:
                joint = _keys(np.concatenate((nodes[n - 1][0], ids[:, :-1])), size)
                owners, own = joint[:len(nodes[n - 1][0])], joint[len(nodes[n - 1][0]):]
                lengths = np.bincount(np.searchsorted(owners, own), minlength=len(owners))
            else:
                lengths = np.array([len(ids)])
            first, state = _register(lengths, ids[:, -1], weights, target)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
            kept = _stretches(starts[first], lengths[first])
            arrays[:0] = [lengths[first], ids[kept, -1], weights[kept], target[kept]]
            target = state
        return _dump(arrays, self.words)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        """All paths of the automaton."""
        arrays, words = _load(blob)
        ids, state, levels = np.zeros((1, 0), np.int32), np.zeros(1, np.int64), []
        for lengths, word, weight, target in zip(*[iter(arrays)] * 4, strict=True):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
            arcs = _stretches(starts[state], lengths[state])
            ids = np.concatenate((np.repeat(ids, lengths[state], axis=0), word[arcs][:, None].astype(np.int32)), axis=1)
            state = target[arcs]
            phrase = weight[arcs] > 0
            levels.append((ids[phrase], weight[arcs][phrase]))
        return cls(words, levels)

    # Operations ----------------------------------------------------------------------

    @classmethod
    def union(cls, parts: list[Transducer], depth: int, how: np.ufunc = np.add) -> Transducer:
        """Phrases of all parts, with weights combined."""
        words = sorted(set().union(*(p.words for p in parts)))
        place = {w: i for i, w in enumerate(words)}
        maps = [np.fromiter(map(place.__getitem__, p.words), np.int32, len(p.words)) for p in parts]
        levels = []
        for n in range(depth):
            some = [(m[p.levels[n][0]], p.levels[n][1]) for p, m in zip(parts, maps, strict=True) if len(p.levels[n][0])]
            ids = np.concatenate([x[0] for x in some]) if some else np.zeros((0, n + 1), np.int32)
            weights = np.concatenate([x[1] for x in some]) if some else np.zeros(0, np.int64)
            levels.append(_combined(ids, weights, len(words), how))
        return cls(words, levels)

    def where(self, keep: list[np.ndarray | slice]) -> Transducer:
        """The phrases that are kept, and no more words than they need."""
        levels = [(ids[k], weights[k]) for (ids, weights), k in zip(self.levels, keep, strict=True)]
        used = np.unique(np.concatenate([ids.ravel() for ids, _ in levels]))
        place = np.zeros(len(self.words), np.int32)
        place[used] = np.arange(len(used))
        return Transducer([self.words[i] for i in used.tolist()], [(place[ids], weights) for ids, weights in levels])

    def at_least(self, count: int) -> Transducer:
        return self.where([weights >= count for _, weights in self.levels])

    def cut(self, bounds: list[tuple[bytes, ...]]) -> list[Transducer]:
        """One transducer more than there are bounds: what lies before, between and after them."""
        places = [self._places(b) for b in bounds]
        ends = [[0] * len(self.levels), *places, [len(ids) for ids, _ in self.levels]]
        return [self.where([slice(a, b) for a, b in zip(low, high, strict=True)]) for low, high in zip(ends, ends[1:], strict=False)]

    def _places(self, bound: tuple[bytes, ...]) -> list[int]:
        """Per level the number of phrases before the bound."""
        numbers: list[int] = []
        for w in bound:
            numbers.append(bisect.bisect_left(self.words, w))
            if numbers[-1] == len(self.words) or self.words[numbers[-1]] != w:
                break  # phrases with this number are behind the bound whatever follows
        return [bisect.bisect_left(_Rows(ids), (*numbers,)) for ids, _ in self.levels]

    def middle(self, pieces: int) -> list[tuple[bytes, ...]]:
        """Bounds that cut the longest phrases evenly."""
        ids = self.levels[-1][0]
        at = [len(ids) * i // pieces for i in range(1, pieces)]
        return [tuple(self.words[w] for w in ids[i].tolist()) for i in at]

    def composed(self, other: Transducer, n: int, ids: np.ndarray) -> np.ndarray:
        """Weights here of another one's phrases of ``n`` words (rows ``ids`` of its word numbers); 0 if not held."""
        mine, weights = self.levels[n - 1]
        if not len(mine) or not len(ids):
            return np.zeros(len(ids), np.int64)
        place = {w: i for i, w in enumerate(self.words)}
        there = np.fromiter((place.get(w, -1) for w in other.words), np.int64, len(other.words))[ids]
        known = (there >= 0).all(axis=1)
        joint = _keys(np.concatenate((mine, there[known].astype(np.int32))), len(self.words))
        keys, asked = joint[:len(mine)], joint[len(mine):]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        out = np.zeros(len(ids), np.int64)
        out[known] = np.where(keys[at] == asked, weights[at], 0)
        return out


class _Rows:
    """Rows of an array as a sequence of tuples, for bisection."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int) -> tuple[int, ...]:
        return tuple(self.ids[i].tolist())


def _register(lengths: np.ndarray, word: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One state for all stretches of equal arcs: the stretch that stands for each, and every stretch's state."""
    with np.errstate(over="ignore"):
        arcs = mixed(mixed(mixed(word.astype(np.uint64)) + weight.astype(np.uint64)) + target.astype(np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(arcs, dtype=np.uint64)))
        ends = np.cumsum(lengths)
        signs = mixed(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64))
    _, first, state = np.unique(signs, return_index=True, return_inverse=True)
    starts = ends - lengths
    stand = first[state]
    same = lengths == lengths[stand]
    if same.all():
        there = _stretches(starts[stand], lengths)
        same = (word[there] == word) & (weight[there] == weight) & (target[there] == target)
    if not same.all():  # different stretches with one sign: share nothing
        return np.arange(len(lengths)), np.arange(len(lengths))
    return first, state


# Shards -----------------------------------------------------------------------------


def count_phrases(texts: list[bytes], longest: int) -> tuple[Transducer, int]:
    """The counts of all phrases of some texts, and the number of words."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[_BREAK]
    parts = []
    for text in texts:
        tokens = text.translate(_TABLE).replace(_BREAK, b" \xff ").split()
        parts.append(np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)))
        parts.append(np.zeros(1, np.int32))
    words = sorted(number)  # the break comes last
    place = np.empty(len(words), np.int32)
    place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    ids, end = place[np.concatenate(parts)], len(words) - 1
    levels, size = [], len(words)
    for n in range(1, longest + 1):
        inside = np.ones(max(0, len(ids) - n + 1), bool)
        for i in range(n):
            inside &= ids[i:len(ids) - n + 1 + i] != end
        at = np.flatnonzero(inside)
        if n * size.bit_length() <= 62:
            bits, key = size.bit_length(), np.zeros(len(at), np.int64)
            for i in range(n):
                key = key << bits | ids[at + i]
            key, counts = np.unique(key, return_counts=True)
            rows = np.stack([(key >> bits * (n - 1 - i) & (1 << bits) - 1).astype(np.int32) for i in range(n)], axis=1)
            levels.append((rows, counts))
        else:
            levels.append(_combined(np.stack([ids[at + i] for i in range(n)], axis=1), np.ones(len(at), np.int64), size))
    return Transducer(words[:-1], levels), int(levels[0][1].sum())


class Ranges:
    """Prefix ranges: numbered in order, several for a large lang; small ones share the ranges behind."""

    def __init__(self, bounds: dict[str, list[tuple[bytes, ...]]], shared: int):
        self.bounds, self.shared, self.first, n = bounds, max(1, shared), {}, 0
        for lang in sorted(bounds):
            self.first[lang] = n
            n += len(bounds[lang]) + 1
        self.large = n

    def __len__(self) -> int:
        return self.large + self.shared

    def split(self, lang: str, counts: Transducer) -> Iterator[tuple[int, Transducer]]:
        if lang not in self.bounds:
            yield self.large + xxhash.xxh3_64_intdigest(lang.encode()) % self.shared, counts
            return
        for i, part in enumerate(counts.cut(self.bounds[lang])):
            yield self.first[lang] + i, part


def _blob(range_: int, lang: str, kind: int, blob: bytes | None, origin: int = -1, low: tuple = (), n: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "range": pa.array([range_], pa.int32()), "lang": [lang], "kind": pa.array([kind], pa.int32()), "origin": pa.array([origin], pa.int32()),
        "low": pa.array([list(low)], pa.list_(pa.binary())), "blob": pa.array([blob], pa.binary()), "n": pa.array([n], pa.int64())})


def _shards(rows: DataFrame, ranges: Ranges, longest: int) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = defaultdict(list)
        size = 0

        def shards() -> Iterator[pa.RecordBatch]:
            for lang, texts in waiting.items():
                counts, n = count_phrases(texts, longest)
                yield _blob(n % len(ranges), lang, _TOTAL, None, n=n)
                for number, part in ranges.split(lang, counts):
                    pieces = 1 + len(part.levels[-1][0]) // PIECE
                    bounds = part.middle(pieces)
                    for low, piece in zip([(), *bounds], part.cut(bounds), strict=True):
                        if len(piece):
                            yield _blob(number, lang, _COUNTS, piece.to_bytes(), low=low)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                waiting[lang].append(text)
                size += len(text)
                if size >= SHARD_BYTES:
                    yield from shards()
                    waiting.clear()
                    size = 0
        yield from shards()

    return rows.mapInArrow(counted, _BLOBS)


def _united(pieces: DataFrame, depth: int, least: int) -> DataFrame:
    """Sums of a range's transducers, which come in order of their first phrase; only frequent phrases stay."""
    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = (None, None), [], 0

        def done(counts: Transducer) -> Iterator[pa.RecordBatch]:
            frequent = counts.at_least(least)
            if len(frequent):
                yield _blob(at[0], at[1], _COUNTS, frequent.to_bytes())

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == _TOTAL:
                    yield _blob(row["range"], row["lang"], _TOTAL, None, n=row["n"])
                    continue
                here, low = (row["range"], row["lang"]), tuple(row["low"])
                if here != at:
                    if held:
                        yield from done(Transducer.union(held, depth))
                    at, held, size = here, [], 0
                elif size > HELD and low:
                    complete, rest = Transducer.union(held, depth).cut([low])
                    yield from done(complete)
                    held, size = [rest], len(rest)
                held.append(Transducer.from_bytes(row["blob"]))
                size += len(held[-1])
        if held:
            yield from done(Transducer.union(held, depth))

    return pieces.mapInArrow(united, _BLOBS)


def _asked(counts: DataFrame, ranges: Ranges, longest: int) -> DataFrame:
    """The parts of every range's candidates, sent to the ranges that own them."""
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] != _COUNTS:
                    continue
                own = Transducer.from_bytes(row["blob"])
                parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(longest)]
                for n in range(2, longest + 1):
                    ids, weights = own.levels[n - 1]
                    for i in range(n):
                        for j in range(i + 1, n + 1):
                            if j - i < n and (i == 0 or j == n or j - i > 1):
                                parts[j - i - 1].append((ids[:, i:j], weights))
                levels = []
                for m, some in enumerate(parts, 1):
                    ids = np.concatenate([x[0] for x in some]) if some else np.zeros((0, m), np.int32)
                    weights = np.concatenate([x[1] for x in some]) if some else np.zeros(0, np.int64)
                    levels.append(_combined(ids, weights, len(own.words), np.maximum))
                for number, part in ranges.split(row["lang"], Transducer(own.words, levels)):
                    if len(part):
                        yield _blob(number, row["lang"], _PARTS, part.to_bytes(), origin=row["range"])

    return counts.mapInArrow(asked, _BLOBS)


def _by_lang(table: pa.Table) -> dict[str, dict[int, list[dict]]]:
    out: dict[str, dict[int, list[dict]]] = defaultdict(lambda: defaultdict(list))
    for row in table.to_pylist():
        out[row["lang"]][row["kind"]].append(row)
    return out


def _answered(rows: DataFrame, longest: int, share: int) -> DataFrame:
    """Counts of the parts, for the ranges that asked; candidates of the own range that longer ones stand for."""
    def answered(table: pa.Table) -> pa.Table:
        out = []
        for lang, kinds in _by_lang(table).items():
            own = Transducer.union([Transducer.from_bytes(r["blob"]) for r in kinds[_COUNTS]], longest)
            inside = [np.zeros(len(ids), np.int64) for ids, _ in own.levels]
            for row in kinds[_PARTS]:
                parts = Transducer.from_bytes(row["blob"])
                found = [(ids, own.composed(parts, n, ids)) for n, (ids, _) in enumerate(parts.levels, 1)]
                out.append(_blob(row["origin"], lang, _ANSWERS, Transducer(parts.words, found).to_bytes()))
                for n in range(2, longest):
                    inside[n - 1] = np.maximum(inside[n - 1], parts.composed(own, n, own.levels[n - 1][0]))
            gone = [(most > 0) & (100 * most >= share * weights) for most, (_, weights) in zip(inside, own.levels, strict=True)]
            dropped = own.where(gone)
            if len(dropped):
                out.append(_blob(int(table.column("range")[0].as_py()), lang, _DROPPED, dropped.to_bytes()))
        empty = pa.schema([(f.name, f.type) for f in _blob(0, "", 0, None).schema])
        return pa.Table.from_batches(out, schema=empty)

    return rows.groupBy("range").applyInArrow(answered, _BLOBS)


def scores(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``floor(1000000 a a / (left right))``, exact; in Python's numbers where 64 bits do not hold the products."""
    if len(a) and (int(a.max()) > 3_000_000 or int(left.max()) * int(right.max()) >= 2**63):
        a, left, right = a.astype(object), left.astype(object), right.astype(object)
    return 1_000_000 * a * a // (left * right)


def _scored(rows: DataFrame, longest: int, first: int) -> DataFrame:
    """The best candidates of every range and lang, each cut where it scores lowest."""
    def scored(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for lang, kinds in _by_lang(table).items():
            own, answers, dropped = (
                Transducer.union([Transducer.from_bytes(r["blob"]) for r in kinds[k]], longest, np.maximum) for k in (_COUNTS, _ANSWERS, _DROPPED))
            best: list[tuple] = []
            for n in range(2, longest + 1):
                ids, a = own.levels[n - 1]
                kept = dropped.composed(own, n, ids) == 0
                ids, a = ids[kept], a[kept]
                if not len(ids):
                    continue
                lowest = None
                for k in range(1, n):
                    left, right = answers.composed(own, k, ids[:, :k]), answers.composed(own, n - k, ids[:, k:])
                    score = scores(a, left, right)
                    if lowest is None:
                        lowest = [score, left, right]
                        continue
                    lower = score < lowest[0]
                    lowest = [np.where(lower, x, y) for x, y in zip((score, left, right), lowest, strict=True)]
                best += [(-int(s), -int(c), b" ".join(own.words[w] for w in row), int(x), int(y)) for row, c, s, x, y in zip(
                    ids.tolist(), a.tolist(), *(v.tolist() for v in lowest), strict=True)]
            out += [(lang, p, -c, x, y, -s) for s, c, p, x, y in sorted(best)[:first]]
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds_ = (pa.string(), pa.binary(), *[pa.int64()] * 4)
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("lang", "phrase", "a", "l", "r", "score"), columns, kinds_, strict=True)})

    return rows.groupBy("range").applyInArrow(scored, _FOUND)


# The whole --------------------------------------------------------------------------


def make_ranges(rows: DataFrame, longest: int) -> Ranges:
    """Prefix ranges for a corpus (``lang, text`` as bytes), about even by a sample of its documents."""
    sizes = cut(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows")))
    total = sizes.agg(F.sum("chars"), F.sum("rows")).first()
    chars = max(RANGE_CHARS, -(-(total[0] or 0) // MOST_RANGES))
    large = {r["lang"]: -(-r["chars"] // chars) for r in sizes.where(F.col("chars") > chars).collect()}  # MOST_RANGES at most

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, taken = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang in large:
                    tokens = text.translate(_TABLE).replace(_BREAK, b" \xff ").split()
                    for i in range(0, len(tokens), max(1, len(tokens) * APART // max(1, len(text)))):
                        some = tokens[i:i + longest]
                        some = some[:some.index(_BREAK)] if _BREAK in some else some
                        if some:
                            langs.append(lang)
                            taken.append(some)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "phrase": pa.array(taken, pa.list_(pa.binary()))})

    found: dict[str, set[tuple[bytes, ...]]] = {lang: set() for lang in large}
    if large:
        sample = rows.sample(min(1.0, SAMPLED / total[1]), seed=7).mapInArrow(phrases, "lang string, phrase array<binary>")
        for r in sample.limit(MOST_SAMPLED).collect():
            found[r["lang"]].add(tuple(map(bytes, r["phrase"])))
    bounds = {}
    for lang, n in large.items():
        ordered = sorted(found[lang])
        bounds[lang] = sorted({ordered[len(ordered) * i // n] for i in range(1, n)} - {()}) if ordered else []
    rest = (total[0] or 0) - sum(r * chars for r in large.values())
    return Ranges(bounds, -(-max(1, rest) // chars))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, first: int = 2000) -> DataFrame:
    """The ``first`` phrases of every lang by score: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times, unless they lie
    inside a longer one with ``share`` percent of their count.  ``l`` and ``r`` are the counts of
    the two parts at the cut that scores lowest (the first of them, among equals), ``n`` all words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    ranges = make_ranges(rows, longest)

    def together(blobs: DataFrame) -> DataFrame:
        return blobs.repartitionById(len(ranges), F.col("range")).sortWithinPartitions("range", "lang", "kind", "low")

    counts = cut(_united(together(_shards(rows, ranges, longest)), longest, least))
    held = counts.where(F.col("kind") == _COUNTS)
    answers = cut(_answered(held.unionByName(_asked(held, ranges, longest)), longest, share))
    best = _scored(held.unionByName(answers), longest, first)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    words = counts.where(F.col("kind") == _TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
