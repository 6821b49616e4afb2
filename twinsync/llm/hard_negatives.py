"""Hard negatives for anchors, by inner products of many candidates at a time.

Kronecker-packed products: the j-th components of up to ``FIELDS`` candidates, made
non-negative by a bias, lie side by side as the fields of one wide integer.  One
multiplication by an anchor's (biased) j-th component multiplies all of them, and the sum over
j leaves every candidate's inner product in a field of its own, as a field is wide enough for
the largest sum that can occur.  Taking the biases' share out again gives the exact scores.

Candidates are packed once and written.  Anchors are taken in blocks of bounded size: a block
is sent to all tasks, each of which scores its candidates and keeps the first few an anchor;
those meet in a shuffle by anchor.  The positives are found first, the negatives in a second
pass that knows the positives' scores.

Rows with a null id, label or vector, or with a null or non-finite component, take no part (a
component that stops being finite when it is scaled counts as such).  Of rows that share an id one
takes part: the least by label, then by vector.  Vectors of different length are compared as if
zeros followed the shorter one.  A score that needs more than 64 bits ranks exactly and is
returned as null.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsync.functions.keys import number_rows
from twinsync.session import cut, scratch_dir

#: Candidates in one packed integer.
FIELDS = 1024
#: Bytes of anchors that are sent to every task at a time.
BLOCK_BYTES = 8 << 20
#: Components are scaled by this before they are floored.
SCALE = 256.0

_PACKED = "ids binary, labels binary, width int, bias string, planes array<binary>"
_FOUND = "anchor_id bigint, positive_id bigint, place int, other_id bigint, score string"


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, vector`` (doubles) of the rows that take part, one an id."""
    named = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                        F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x * SCALE) < float("inf"), F.lit(False)))  # NaN is above infinity
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = named.where("vec_id is not null and label is not null and vector is not null").where(finite).repartition(parts, "vec_id")
    return one.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def integers(vectors: list, dims: int) -> np.ndarray:
    """Floored components, one row a vector: 64-bit numbers, or Python's where those are too small."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    out = np.floor(out * SCALE)
    if np.abs(out).max(initial=0) < 2.0**53:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out.tolist()], object)


def field_bytes(dims: int, anchor_bias: int, bias: int) -> int:
    """Bytes of a field that no sum of biased products outgrows."""
    need = (max(dims, 1) * (2 * anchor_bias + 1) * (2 * bias + 1)).bit_length()
    return 4 if need <= 32 else 8 * -(-need // 64)


def fields(value: int, n: int, width: int) -> np.ndarray:
    """The fields of a packed integer; up to 64 bits as unsigned numbers, else as Python's."""
    data = value.to_bytes(n * width, "little")
    if width == 4:
        return np.frombuffer(data, "<u4").astype(np.uint64)
    if width == 8:
        return np.frombuffer(data, "<u8")
    return np.array([int.from_bytes(data[i:i + width], "little") for i in range(0, len(data), width)], object)


def _planes(block: np.ndarray, bias: int, width: int) -> list[bytes]:
    if block.dtype != object and width <= 8:
        return [(plane + bias).astype(f"<u{width}").tobytes() for plane in block.T]
    return [b"".join((int(x) + bias).to_bytes(width, "little") for x in plane) for plane in block.T]


def pack(rows: DataFrame, dims: int, anchor_bias: int) -> DataFrame:
    """Candidates as packed integers, ``FIELDS`` rows in each; written once for all passes."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: list[tuple]) -> pa.RecordBatch:
            ids, labels, vectors = zip(*part, strict=True)
            numbers = integers(list(vectors), dims)
            bias = max(1, int(np.abs(numbers).max(initial=0)))
            width = field_bytes(dims, anchor_bias, bias)
            return pa.RecordBatch.from_pydict({
                "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "labels": pa.array([np.array(labels, "<i8").tobytes()], pa.binary()),
                "width": pa.array([width], pa.int32()), "bias": [str(bias)],
                "planes": pa.array([_planes(numbers, bias, width)], pa.list_(pa.binary()))})

        waiting: list[tuple] = []
        for batch in batches:
            waiting += zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector")), strict=True)
            while len(waiting) >= FIELDS:
                yield block(waiting[:FIELDS])
                del waiting[:FIELDS]
        if waiting:
            yield block(waiting)

    return cut(rows.mapInArrow(packed, _PACKED))


class Packed:
    """One row of the packed table, ready to be multiplied."""

    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.width, self.bias = row["width"], int(row["bias"])
        self.planes = [int.from_bytes(p, "little") for p in row["planes"]]
        self.sums = fields(sum(self.planes), len(self.ids), self.width)

    def scores(self, anchor: list[int], anchor_bias: int) -> np.ndarray:
        """Exact inner products of all candidates with an anchor's components."""
        total = sum(map(mul, [a + anchor_bias for a in anchor], self.planes))
        found = fields(total, len(self.ids), self.width)
        if self.width > 8:
            return found - anchor_bias * self.sums - self.bias * sum(anchor)
        with np.errstate(over="ignore"):  # modulo 2**64, where the result fits
            found = found - np.uint64(anchor_bias) * self.sums - np.uint64(self.bias * sum(anchor) % 2**64)
        return found.view(np.int64)


class _First:
    """The first ``k`` of what was offered: higher scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.ids) == self.k:
            good = scores >= self.scores[-1]
            scores, ids = scores[good], ids[good]
        if not len(ids):
            return
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        by_id = np.argsort(ids, kind="stable")
        order = by_id[np.argsort(-scores[by_id], kind="stable")][:self.k]
        self.scores, self.ids = scores[order], ids[order]


def _pass(packed: DataFrame, anchors: list[tuple], anchor_bias: int, dims: int, k: int, low: int, high: int) -> DataFrame:
    """For every anchor of a block, and positive if it has them, the first ``k`` candidates of each task.

    ``anchors``: id, label, vector, and the positives with their scores, or None.  Without
    positives the candidates are the anchor's other rows of its label; with them, the rows of other
    labels with ``low * positive <= 100 * score <= high * positive``.
    """
    spark = packed.sparkSession
    sent = spark.sparkContext.broadcast(anchors)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = [[int(x) for x in row] for row in integers([a[2] for a in sent.value], dims)]
        best: dict[tuple[int, int | None], _First] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Packed(row)
                for (anchor, label, _, positives), vector in zip(sent.value, vectors, strict=True):
                    scores = block.scores(vector, anchor_bias)
                    same = block.labels == label
                    if positives is None:
                        same &= block.ids != anchor
                        best.setdefault((anchor, None), _First(k)).offer(scores[same], block.ids[same])
                        continue
                    scores, ids = scores[~same], block.ids[~same]
                    for positive, own in positives:
                        # As whole numbers: low * own <= 100 * s <= high * own.
                        fits = (scores >= -(-low * own // 100)) & (scores <= high * own // 100)
                        if fits.any():
                            best.setdefault((anchor, positive), _First(k)).offer(scores[fits], ids[fits])
        for start in range(0, len(best), 1000):
            part = list(best.items())[start:start + 1000]
            flat = [(a, p, i, int(o), str(s)) for (a, p), f in part for i, (o, s) in enumerate(zip(f.ids, f.scores, strict=True))]
            yield pa.RecordBatch.from_pydict({
                "anchor_id": pa.array([x[0] for x in flat], pa.int64()), "positive_id": pa.array([x[1] for x in flat], pa.int64()),
                "place": pa.array([x[2] for x in flat], pa.int32()), "other_id": pa.array([x[3] for x in flat], pa.int64()),
                "score": pa.array([x[4] for x in flat], pa.string())})

    return packed.mapInArrow(scored, _FOUND)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` over all tasks, with their rank from 1."""
    negative, size = F.col("score").startswith("-"), F.length("score")  # whole numbers of any size, as texts
    order = Window.partitionBy(*by).orderBy(
        F.when(negative, -size).otherwise(size).desc(), F.when(~negative, F.col("score")).desc(), F.when(negative, F.col("score")), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, label: Column | None = None, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """The first ``negatives`` hard negatives of each of the first ``positives`` of every anchor.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``.  Positives are their other rows
    of the same label, negatives rows of another label that score from ``low`` to ``high`` percent of
    the positive's score; both in order of score, then id.
    """
    spark = rows.sparkSession
    all_rows = cut(usable(rows, F.col("label") if label is None else label))
    anchors = all_rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    dims = all_rows.agg(F.max(F.size("vector"))).first()[0]
    peak = anchors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))), F.count("*")).first()
    if not peak[1]:
        return _result(spark.createDataFrame([], _FOUND + ", rank int, positive_score string"))
    anchor_bias = int(np.floor(peak[0] * SCALE)) + 1
    packed = pack(all_rows, dims, anchor_bias)
    block_rows = max(1, BLOCK_BYTES // (8 * max(dims, 1) + 64 * positives))
    folder = f"{scratch_dir(spark)}/negatives-{uuid.uuid4().hex}"
    blocks = -(-peak[1] // block_rows)
    numbered = cut(number_rows(anchors, F.col("vec_id").cast("string"), "_n", 0).withColumn("block", F.floor(F.col("_n") / block_rows)))
    for b in range(blocks):
        block = [(r["vec_id"], r["label"], r["vector"]) for r in numbered.where(F.col("block") == b).collect()]  # block_rows at most
        first = _ranked(_pass(packed, [(*a, None) for a in block], anchor_bias, dims, positives, low, high), ["anchor_id"], positives)
        own: dict[int, list] = {}
        for r in first.collect():  # positives * block_rows at most
            own.setdefault(r["anchor_id"], []).append((r["other_id"], int(r["score"])))
        sought = [(*a, own[a[0]]) for a in block if a[0] in own]
        found = _ranked(_pass(packed, sought, anchor_bias, dims, negatives, low, high), ["anchor_id", "positive_id"], negatives)
        scores = [(a, p, str(s)) for a, listed in own.items() for p, s in listed]
        scores = spark.createDataFrame(scores, "anchor_id bigint, positive_id bigint, positive_score string")
        found.join(scores, ["anchor_id", "positive_id"]).write.mode("overwrite").parquet(f"{folder}/block={b}")
    return _result(spark.read.schema(_FOUND + ", rank int, positive_score string").parquet(folder))


def _result(found: DataFrame) -> DataFrame:
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"),
                        F.expr("try_cast(positive_score as bigint)").alias("positive_score"),
                        F.expr("try_cast(score as bigint)").alias("negative_score"))
