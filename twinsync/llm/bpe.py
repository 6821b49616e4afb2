"""Byte-level BPE by public ranks, with a segment tree over byte positions.

Every position of a pre-token holds the rank of the pair of the token that starts there
and its right neighbour.  A segment tree over the positions keeps the least rank and, for
equal ranks, the leftmost position.  A merge takes the root, joins the two tokens, and
writes three positions anew (the merged one, the one it swallowed and its left neighbour),
each along one path to the root.  Pre-tokens of like length share a matrix, so one step
of all of them is a few array operations; a long one is merged alone in the same way.

Null texts count as empty; an empty text has no ids, and the ids decode to its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinsync.llm.common import Pieces, give_back, releasing, rows_of, small_batches, texts

#: Longer pre-tokens, and those of a call with few of them, are merged one at a time, in plain lists.
TOGETHER_BYTES, TOGETHER_WORDS = 64, 64
_NEVER = np.int64(1) << 62


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a public rank file on the driver (some 50,000 lines)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merger:
    """Ranks, and the pairs that make each token, in arrays for lookups of many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        bits = max(4, (4 * max(1, len(pairs))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = self._hashed(np.fromiter(pairs.keys(), np.int64, len(pairs)),
                                              np.fromiter(pairs.values(), np.int64, len(pairs)), 1 << bits)

    def _slots(self, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _hashed(self, keys: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing; a pair that finds its place taken goes to the next one."""
        table, found = np.full(size + 64, -1, np.int64), np.full(size + 64, _NEVER, np.int64)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[table[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            table[slot[put]], found[slot[put]] = keys[put], values[put]
            left = left[table[slot[left]] != keys[left]]
            slot[left] += 1
            if len(left) and slot[left].max() >= len(table):
                table, found = np.append(table, np.full(64, -1)), np.append(found, np.full(64, _NEVER))
        return np.append(table, -1), np.append(found, _NEVER)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined tokens, or more than any rank."""
        pair = left << 32 | right
        slot = self._slots(pair)
        out = np.full(len(pair), _NEVER, np.int64)
        open_ = np.arange(len(pair))
        while len(open_):
            seen = self.keys[slot[open_]]
            hit = seen == pair[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
            slot[open_] += 1
        return out

    def encode(self, words: list[bytes], kind: np.dtype) -> list[bytes]:
        """Ids of each pre-token, as numbers of ``kind``; a pre-token that is a token itself is that token."""
        size = kind.itemsize
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(size, "little")
            elif len(word) > TOGETHER_BYTES or len(words) < TOGETHER_WORDS:
                out[i] = np.array(self._alone(word), kind).tobytes()
            elif word:
                by_width.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
        for width, which in by_width.items():
            for start in range(0, len(which), 8192):
                part = which[start:start + 8192]
                flat, counts = self._together([words[i] for i in part], width)
                data, ends = flat.astype(kind).tobytes(), (np.cumsum(counts) * size).tolist()
                for i, a, b in zip(part, [0, *ends], ends, strict=False):
                    out[i] = data[a:b]
        return out

    def _together(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge pre-tokens of ``width`` bytes at most: row = pre-token, tree[:, 1] its root.  Ids, and how many each has."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.single[raw]
        ids[np.arange(width) >= lengths[:, None]] = -1
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), _NEVER, np.int64)
        rows, at = np.nonzero(ids[:, 1:] >= 0)
        rank = self.rank_of(ids[rows, at], ids[rows, at + 1])
        tree[rows, width + at] = np.where(rank < _NEVER, rank << 8 | at, _NEVER)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        live = np.nonzero(tree[:, 1] < _NEVER)[0]
        while len(live):
            best = tree[live, 1]
            at, gone = best & 255, after[live, best & 255]
            ids[live, at] = best >> 8
            ids[live, gone] = -1
            beyond = after[live, gone]
            after[live, at] = beyond
            inside = beyond < width
            before[live[inside], beyond[inside]] = at[inside]
            self._write(tree, live, gone, np.full(len(live), _NEVER), width)
            right = np.where(inside, ids[live, np.minimum(beyond, width - 1)], -1)
            self._write(tree, live, at, self._key(ids[live, at], right, at), width)
            prior = before[live, at]
            some = prior >= 0
            mine, prior = live[some], prior[some]
            self._write(tree, mine, prior, self._key(ids[mine, prior], ids[mine, at[some]], prior), width)
            live = live[tree[live, 1] < _NEVER]
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(left), _NEVER, np.int64)
        some = np.nonzero(right >= 0)[0]
        rank = self.rank_of(left[some], right[some])
        out[some] = np.where(rank < _NEVER, rank << 8 | at[some], _NEVER)
        return out

    @staticmethod
    def _write(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        """Point update: a leaf of each row, then its path to the root."""
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width //= 2

    def _alone(self, word: bytes) -> list[int]:
        """The same for one long pre-token, n log n."""
        n = len(word)
        if not n:
            return []
        width = 1 << (n - 1).bit_length()
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, never = self.pairs.get, (1 << 62, 0)
        tree = [never] * (2 * width)
        for i in range(n - 1):
            rank = get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = (rank, i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def write(at: int, value: tuple[int, int]) -> None:
            node = at + width
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] is not never and tree[1] != never:
            rank, at = tree[1]
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone], after[at] = rank, -1, beyond
            write(gone, never)
            if beyond < n:
                before[beyond] = at
                joined = get(rank << 32 | ids[beyond])
                write(at, never if joined is None else (joined, at))
            else:
                write(at, never)
            prior = before[at]
            if prior >= 0:
                joined = get(ids[prior] << 32 | rank)
                write(prior, never if joined is None else (joined, prior))
        return [x for x in ids if x >= 0]


class Encoder:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        merger = Merger(ranks)
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        self.pieces = Pieces(pattern, lambda words: merger.encode([w.encode() for w in words], self.kind))
        count = max(ranks.values()) + 1
        self.bytes_of, self.decimal = [b""] * count, [str(i) for i in range(count)]
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, batch: list[str]) -> Iterator[list[int]]:
        for ids in self.pieces.encode(batch):
            yield np.frombuffer(ids, self.kind).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def told(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def encoder(name: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    if name not in _encoders:
        _encoders[name] = Encoder(ranks, pattern)
    return _encoders[name]


def release() -> None:
    """Forget the pieces that encoders have met; their vocabularies stay."""
    for code in _encoders.values():
        code.pieces.forget()
    give_back()


def vocabulary_name(ranks: dict[bytes, int], pattern: str) -> str:
    return hashlib.md5(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes, and ids on request."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file, whatever the data's size
    name = vocabulary_name(ranks, pattern)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(name, shared.value, pattern)
        fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        layout = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
        for keys, bodies in rows_of(batches, "doc_id", "text"):
            for some_keys, some in small_batches(keys, bodies):
                out = []
                for ids in code.encode(some):
                    told = hashlib.sha256(code.told(ids).encode()).hexdigest()
                    out.append((len(ids), told, hashlib.sha256(code.decode(ids)).hexdigest(), *[ids] * with_ids))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some_keys, pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(layout)[1:], strict=True)]],
                    schema=layout)

    return texts(docs).mapInArrow(releasing(run, release), schema)
