"""Token ids in binary shards with a minimal perfect hash index per shard.

A shard has two files.  ``.ids``: the raw ids of its documents one after the other, little
endian, two bytes each if every id of the vocabulary fits, else four; every document ends
with the end id.  ``.mph``: a minimal perfect hash over the documents' keys (levels of bit
sets: a key takes the first level where it is alone in its place, its slot is the rank of
that bit), and by slot the stored fingerprint, offset and length, so that a key is found in
constant time and a key that is not there is told by its fingerprint.

Shards are cut by ranges of doc_id and hold documents in ascending order (null first, equal
ids by a hash of the text).  Files are written under another name and moved when complete,
and a manifest names those that count and the bytes of an id: a task that runs twice changes nothing.  Null texts
count as empty and hold the end id alone.  Rows with the same doc_id share a slot and are
all found.  An empty table gives no shards.
"""

from __future__ import annotations

import bisect
import io
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync.llm.common import Pieces, mixed, rows_of, small_batches, texts

_MANIFEST = "shard int, file string, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint, id_bytes int"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys to 0..n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.counts = [np.concatenate(([0], np.cumsum(np.bitwise_count(bits)))).astype(np.int64) for bits in levels]
        self.starts = np.concatenate(([0], np.cumsum([c[-1] for c in self.counts]))).astype(np.int64)

    @staticmethod
    def _places(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            words = (2 * len(keys)) // 64 + 1
            place = cls._places(keys, len(levels), words)
            alone = np.bincount(place, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots; any slot or -1 for keys that are not in the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            place = self._places(keys[open_], level, len(bits))
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.starts[level] + self.counts[level][word[hit]] + below
            open_ = open_[~hit]
        return out


def key_hashes(keys: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and fingerprint of keys; the hash is a bijection, so different keys never meet (null is taken for a rare number)."""
    numbers = np.where(valid, keys, np.int64(-(1 << 63) + 1)).astype(np.int64).view(np.uint64)
    return mixed(numbers), mixed(numbers ^ np.uint64(0xD6E8FEB86659FD93))


def index_bytes(keys: np.ndarray, valid: np.ndarray, sizes: np.ndarray) -> bytes:
    """The ``.mph`` file: documents in shard order in, entries by slot out."""
    hashes, prints = key_hashes(keys, valid)
    distinct = np.unique(hashes)
    perfect = PerfectHash.of(distinct)
    slot = perfect.slots(hashes)
    order = np.argsort(slot, kind="stable")
    offsets = np.cumsum(sizes) - sizes
    out = io.BytesIO()
    np.savez(out, keys=keys, valid=valid, first=np.searchsorted(slot[order], np.arange(len(distinct) + 1)),
             fingerprint=prints[order], offset=offsets[order], length=sizes[order], ordinal=order,
             **{f"level{i}": bits for i, bits in enumerate(perfect.levels)})
    return out.getvalue()


class ShardIndex:
    """An opened ``.mph`` file."""

    def __init__(self, data: bytes):
        self.at = dict(np.load(io.BytesIO(data)))
        self.perfect = PerfectHash([self.at[f"level{i}"] for i in range(sum(k.startswith("level") for k in self.at))])

    def find(self, key_hash: int, fingerprint: int) -> list[tuple[int, int, int]]:
        """(ordinal, offset, length) of the documents with this key: one probe a level, then its entries."""
        slot = int(self.perfect.slots(np.array([key_hash], np.uint64))[0])
        if slot < 0:
            return []
        a, b = int(self.at["first"][slot]), int(self.at["first"][slot + 1])
        return [(int(self.at["ordinal"][i]), int(self.at["offset"][i]), int(self.at["length"][i]))
                for i in range(a, b) if int(self.at["fingerprint"][i]) == fingerprint]

    def spans(self, hashes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of every document in shard order, each found by its key."""
        place = self.at["first"][self.perfect.slots(hashes)]
        # Rows of one key stand together, in shard order, in the entries of its slot as in the shard.
        place = place + np.arange(len(hashes)) - self.at["ordinal"][place]
        if (self.at["fingerprint"][place] != prints).any():
            raise ValueError("an index does not belong to its keys")
        return self.at["offset"][place], self.at["length"][place]


_pack = [struct.Struct(f"<{n}I").pack for n in range(24)]


class LibraryEncoder:
    """The tokenizers library, asked once for every piece of text a worker meets (up to a bound).

    A file of plain byte-level BPE has its public pattern split the pieces and the library's
    model encode the matches, which is what the library does inside; for any other file, and
    for a text that holds a special token's string, the library gets the whole text.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        split = json.loads(self.library.to_str())["pre_tokenizer"] or {}
        self.plain = (self.library.normalizer is None and split.get("type") == "ByteLevel" and split["use_regex"]
                      and not split["add_prefix_space"])
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        own = [c for c in letters if ord(c) < 256]  # these bytes are their own letters, the others follow in order
        self.letters = {ord(c): c for c in own} | dict(zip(
            [b for b in range(256) if chr(b) not in own], [c for c in letters if ord(c) >= 256], strict=True))
        self.pieces = Pieces(pattern, self._words)

    def _words(self, words: list[str]) -> list[bytes]:
        one, letters, space = self.library.model.tokenize, self.letters, self.letters[32]
        out = []
        for w in words:
            bare = w[1:] if w[0] == " " else w
            if bare.isalnum() and bare.isascii():
                mapped = w if bare is w else space + bare
            else:
                mapped = w.encode().decode("latin-1").translate(letters)
            tokens = one(mapped)
            out.append(_pack[len(tokens)](*[t.id for t in tokens]) if len(tokens) < len(_pack) else
                       array("I", [t.id for t in tokens]).tobytes())
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        whole = {i for i, t in enumerate(batch) if not self.plain or any(s in t for s in self.special)}
        rest = iter(self.pieces.encode([t for i, t in enumerate(batch) if i not in whole]))
        return [np.frombuffer(self._whole(t) if i in whole else next(rest), "<u4") for i, t in enumerate(batch)]


_made: dict[str, LibraryEncoder] = {}


def library_encoder(path: str, pattern: str) -> Callable[[], LibraryEncoder]:
    """One encoder a worker and file."""
    def get() -> LibraryEncoder:
        if path not in _made:
            _made[path] = LibraryEncoder(path, pattern)
        return _made[path]
    return get


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else folder.removeprefix("file:"))


def write_shards(docs: DataFrame, folder: str, make_encoder: Callable[[], LibraryEncoder], end_id: int, shards: int) -> DataFrame:
    """Encode, sort and write; returns the manifest, one row per shard."""
    tie = F.xxhash64("text")
    rows = (texts(docs).withColumn("tie", tie).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
            .select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        code = make_encoder()
        store, base = _filesystem(folder)
        store.create_dir(base)
        name = f"shard-{task.partitionId():06d}"
        draft = f"{base}/.{name}-{task.taskAttemptId()}"
        end = np.array([end_id], code.kind).tobytes()
        columns, sizes, stream = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            stream = stream or store.open_output_stream(f"{draft}.ids")
            for _, bodies in small_batches([None] * batch.num_rows, batch.column("text").to_pylist()):
                for ids in code.encode(bodies):
                    stream.write(ids.astype(code.kind).tobytes() + end)
                    sizes.append(len(ids) + 1)
            columns.append([batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)])
        if stream is None:
            return
        stream.close()
        keys, valid = (np.concatenate(c) for c in zip(*columns, strict=True))
        with store.open_output_stream(f"{draft}.mph") as index:
            index.write(index_bytes(keys, valid, np.array(sizes, np.int64)))
        for kind in ("ids", "mph"):
            store.move(f"{draft}.{kind}", f"{base}/{name}.{kind}")
        row = {"shard": task.partitionId(), "file": name, "first_id": int(keys[0]) if valid[0] else None,
               "last_id": int(keys[-1]) if valid[-1] else None, "n_docs": len(keys), "n_ids": int(sum(sizes)),
               "id_bytes": code.kind.itemsize}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("shard", pa.int32()), ("file", pa.string()), *[(c, pa.int64()) for c in ("first_id", "last_id", "n_docs", "n_ids")], ("id_bytes", pa.int32())]))

    rows.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _open(folder: str, name: str) -> tuple[ShardIndex, pa.NativeFile]:
    store, base = _filesystem(folder)
    with store.open_input_stream(f"{base}/{name}.mph") as f:
        index = ShardIndex(f.read())
    return index, store.open_input_file(f"{base}/{name}.ids")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of every shard through its index: doc_id, start, n_tokens, unsigned CRC-32 of the ids as uint32.

    The manifest, one row per shard, is the only thing the driver sees.
    """
    shards = sorted(manifest(spark, folder).collect(), key=lambda s: s.shard)
    base, total = [], 0
    for shard in shards:
        base.append((shard.file, total, shard.id_bytes))
        total += shard.n_ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    plan = spark.createDataFrame(base, "file string, base bigint, width int").repartition(max(1, len(base)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, bases, widths in rows_of(batches, "file", "base", "width"):
            for name, before, width in zip(files, bases, widths, strict=True):
                index, payload = _open(folder, name)
                at, wide = index.at, np.dtype(f"<u{width}")
                offsets, lengths = index.spans(*key_hashes(at["keys"], at["valid"]))
                for start in range(0, len(offsets), 4096):
                    offset, length = offsets[start:start + 4096], lengths[start:start + 4096]
                    sums = [zlib.crc32(np.frombuffer(payload.read_at(int(n) * wide.itemsize, int(o) * wide.itemsize), wide).astype("<u4"))
                            for o, n in zip(offset, length, strict=True)]
                    part = slice(start, start + len(offset))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at["keys"][part], pa.int64(), mask=~at["valid"][part]), pa.array(offset + before, pa.int64()),
                         pa.array(length, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(run, schema)


def fetch(keys: DataFrame, folder: str) -> DataFrame:
    """Keyed access: doc_id and ids of the documents with the given doc_ids; keys that are not there give no row."""
    spark = keys.sparkSession
    shards = sorted((-(1 << 63) if s.first_id is None else s.first_id, s.last_id, s.file, s.id_bytes)
                    for s in manifest(spark, folder).collect() if s.last_id is not None)
    asked = keys.select("doc_id").where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, tuple] = {}
        firsts = [s[0] for s in shards]
        for (ids,) in rows_of(batches, "doc_id"):
            found: list[tuple[int, list[int]]] = []
            hashes, prints = key_hashes(np.array(ids, np.int64), np.ones(len(ids), bool))
            for key, h, p in sorted(zip(ids, hashes.tolist(), prints.tolist(), strict=True)):
                last = bisect.bisect_right(firsts, key) - 1
                while last >= 0 and shards[last][1] >= key:  # rows of one key may span shards
                    name, wide = shards[last][2], np.dtype(f"<u{shards[last][3]}")
                    if name not in opened:
                        if len(opened) >= 4:
                            opened.pop(next(iter(opened)))
                        opened[name] = _open(folder, name)
                    index, payload = opened[name]
                    for _, offset, length in index.find(h, p):
                        data = payload.read_at(length * wide.itemsize, offset * wide.itemsize)
                        found.append((key, np.frombuffer(data, wide).tolist()))
                    last -= 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))],
                                                 names=["doc_id", "ids"])

    return asked.mapInArrow(run, "doc_id bigint, ids array<bigint>")


def new_folder(scratch: str) -> str:
    return f"{scratch}/shards-{uuid.uuid4().hex}"
