"""Near-duplicate groups: circulant MinHash for candidates, exact Jaccard on full shingle sets.

A text is lower-cased (A-Z) and cut into words at ASCII white space; its set holds the
distinct runs of five words, or with fewer words the whole sequence.  Shingles are 64-bit
hashes of word hashes.  Two documents are linked when 100 * intersection >= percent * union.

Signature: a first permutation of 32-bit numbers spreads the shingles, and one second
permutation, shifted round by k places, gives coordinate k as the minimum over the set.
Bands of equal coordinates give candidate groups.  Groups are not expanded into pairs: all
members are compared with their group's first document; who is still apart is written as its
difference from that document's set and grouped anew by the rarest elements of it (a filter that
loses no linked pair).  There a few hubs at a time are compared with the members of other
components whose differences leave room for a link, until every lead has been compared with, or
is connected to, every other member of its group.  Only linked pairs decide.

Null and empty texts have an empty set and are linked with nothing.  Rows with one doc_id
are one document (linked if any of their texts is); a null doc_id is linked with nothing and
kept.  Columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsync.llm.common import WordHashes, give_back, gram_hashes, lookup_join, mixed, releasing, rows_of, texts
from twinsync.session import cut

WORDS = 5
#: How often a pair at the least similarity may share no band: 24 bands of 6 at 0.85, 29 of 5 at 0.80.
MISSED = 1.2e-5
#: Coordinates of a signature; only similarities that need more bands of one get more.
COORDINATES = 150
#: Up to so many document ids may be sent to all executors (8 bytes each); beyond it they are joined by a shuffle.
SENT_IDS = 2_000_000
#: Rows of one reference that meet one copy of its set.
PART = 2000
_BLOCK = 512

_hashes = WordHashes()


def release() -> None:
    """Forget the words met."""
    _hashes.clear()
    give_back()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; empty for a text without words."""
    words = _hashes.of(text.encode().lower().split())
    if 0 < len(words) < WORDS:
        return gram_hashes(np.append(words, np.uint64(len(words))), len(words) + 1)
    return np.unique(gram_hashes(words, WORDS))


def _shuffled(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection on 32-bit numbers, in place."""
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def layout(percent: int) -> tuple[int, int]:
    """Bands and coordinates a band: the longest bands that miss a pair at ``percent`` as seldom as stated."""
    if not 0 < percent <= 100:
        raise ValueError(f"{percent} is not a percentage above 0")
    found = None
    for rows in range(1, COORDINATES + 1):
        meets = (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log1p(-meets)) if meets < 1 else 1
        if found and bands * rows > COORDINATES:
            break
        found = bands, rows
    return found


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k: the least of the second permutation, shifted by k, over the spread set."""
    spread = mixed(hashes).astype(np.uint32)  # the first permutation
    shift = np.arange(size, dtype=np.uint32) * np.uint32(0x9E3779B1)  # one permutation, turned k equal steps
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(spread), _BLOCK):
        np.minimum(least, _shuffled(spread[start:start + _BLOCK, None] + shift).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band, distinct between bands."""
    grid = least.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for column in grid.T:
        key = mixed(key + column + np.uint64(0x9E3779B97F4A7C15))
    return key


def sketches(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null when empty), band keys."""
    n_bands, n_rows = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in rows_of(batches, "doc_id", "text"):
            counts, digests, bands = [], [], []
            for text in bodies:
                found = shingles(text)
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(signature(found, n_bands * n_rows), n_bands).view(np.int64) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return texts(docs).mapInArrow(releasing(run, release), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, size and set of the documents named by ``ids``."""
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    wanted = texts(docs).join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in rows_of(batches, "doc_id", "text"):
            sets = [shingles(text).view(np.int64) for text in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=["id", "size", "set"])

    return wanted.mapInArrow(releasing(run, release), "id bigint, size bigint, set array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked.  Sizes alone rule many out before any set moves."""
    sizes = sets.select("id", "size")
    near = (pairs.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("_a")), "a")
            .join(sizes.select(F.col("id").alias("b"), F.col("size").alias("_b")), "b")
            .where(F.least("_a", "_b") * 100 >= F.greatest("_a", "_b") * percent).select("a", "b"))
    both = (near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("_b")), "b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return (both.select("a", "b", common.alias("common"), (F.size("_a") + F.size("_b")).alias("total"))
            .where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id connected with it, for every id in ``edges`` (a, b).

    Each round every node takes its smallest neighbour's neighbour as its new name, and the
    edges are renamed; rounds needed grow with the logarithm of the longest chain.
    """
    names = None
    while True:
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.isEmpty():
            return names if names is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = edges.union(edges.select("b", "a"))
        parent = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        jumped = cut(parent.join(parent.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", "top"))
        if names is None:
            names = jumped.select("id", F.col("top").alias("component"))
        else:
            names = names.join(jumped.select(F.col("id").alias("component"), "top"), "component", "left").select(
                "id", F.coalesce("top", "component").alias("component"))
        names = cut(names)
        edges = (edges.join(jumped.select(F.col("id").alias("a"), F.col("top").alias("x")), "a")
                 .join(jumped.select(F.col("id").alias("b"), F.col("top").alias("y")), "b")
                 .select(F.col("x").alias("a"), F.col("y").alias("b")))


def differences(live: DataFrame, sets: DataFrame) -> DataFrame:
    """ref, id, size and the symmetric difference of the sets of ``id`` and ``ref``, for every row of ``live`` (ref, id).

    A reference may have most of the rows: its set comes once for about ``PART`` of them.
    """
    parts = cut(live.groupBy("ref").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART)))
    rows = lookup_join(live, parts, "ref", "n").withColumn("_part", F.pmod(F.xxhash64("id"), "parts")).select("ref", "_part", "id")
    refs = (parts.join(sets.select(F.col("id").alias("ref"), F.col("set").alias("_ref")), "ref")
            .select("ref", "_ref", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("_part")))
    both = rows.join(sets, "id").join(refs, ["ref", "_part"])
    return both.select("ref", "id", "size", F.concat(F.array_except("set", "_ref"), F.array_except("_ref", "set")).alias("difference"))


def rare_groups(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """band, ref, id, size, apart, place, lead: each live document under the rarest elements of its difference from ``ref``.

    For differences X and Y of two sets from a third, the sets differ by the elements in one of X and Y alone; they are
    linked when these are (100 - percent) / (100 + percent) of the sum of the sets' sizes or less, which is at most
    ``L = size * (100 - percent) / percent`` for either size.  If one of them is not linked with the reference, X and Y have
    elements in common, and in one order of rarity the smaller one's first ``L / 2 + 1`` and the larger one's first ``L + 1``
    have the first of these.  The former are marked as leads: every linked pair has a lead in some group.  ``apart`` is the
    size of the difference and ``place`` the element's in its order, from 1: what comes after bounds what is shared.
    """
    spread = cut(differences(live, sets).select("ref", "id", "size", F.size("difference").alias("apart"), F.explode("difference").alias("element"))
                 .withColumn("band", F.xxhash64("ref", "element")))
    counts = cut(spread.groupBy("band").agg(F.count("*").alias("n")))
    order = Window.partitionBy("ref", "id").orderBy("n", "band")
    ranked = lookup_join(spread, counts, "band", "n").withColumn("place", F.row_number().over(order))
    most = f"size * {100 - percent} div"
    return ranked.where(f"n > 1 and place <= {most} {percent} + 1").select(
        "band", "ref", "id", "size", "apart", "place", F.expr(f"place <= {most} {2 * percent} + 1").alias("lead"))


def _unsettled(members: DataFrame, names: DataFrame) -> DataFrame:
    """Members, with their components, of the bands that hold a lead and more than one component."""
    # Written, as it is read twice: the members may be the rows of an anti-join or of a whole new grouping.
    named = cut(members.join(names, "id", "left").select(*members.columns, F.coalesce("component", "id").alias("component")))
    apart = (named.groupBy("band").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.max("lead").alias("_lead"))
             .where("_a < _b and _lead").select("band"))
    return named.join(apart, "band", "left_semi")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = cut(sketches(docs, percent))
    some = rows.where("digest is not null and doc_id is not null")
    classes = cut(some.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")))
    banded = classes.select("id", "size", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("_last")).where("hub < _last").drop("_last")
    members = cut(banded.join(shared, "band"))

    copies = some.join(classes.select("digest", "id"), "digest").where("doc_id <> id").select("doc_id", "id").distinct() \
        if _repeated_ids(some) else None
    tested = cut(members.where("id <> hub").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("id").alias("b"), F.col("hub").alias("a")))
    sets = cut(shingle_sets(docs, members.select("id").distinct()))
    links = cut(verified(tested, sets, percent))
    if copies is not None:
        links = cut(links.union(copies.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))))
    names = components(links)
    hubs, rare = 1, False
    members = members.select("band", F.col("hub").alias("ref"), "id", "size", F.lit(0).alias("apart"), F.lit(0).alias("place"),
                             F.lit(True).alias("lead"))
    while True:
        members = cut(_unsettled(members, names))
        if hubs > 1 and not rare:
            members, rare = cut(_unsettled(rare_groups(members.select("ref", "id").distinct(), sets, percent), names)), True
        if members.isEmpty():
            break
        # Hubs of a band: its first leads, taking turns between its components.
        turn = Window.partitionBy("band", "component").orderBy("id")
        order = Window.partitionBy("band").orderBy("_turn", "hub")
        firsts = members.where("lead").select("band", "ref", "component", "size", "apart", "place", F.col("id").alias("hub"),
                                              F.row_number().over(turn).alias("_turn"))
        chosen = cut(firsts.where(F.col("_turn") <= hubs).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= hubs).drop("_n", "_turn"))
        # Bands of one reference with the same hubs are one band from here on, so a pair that shares many bands is made once.
        joint = cut(chosen.groupBy("band", "ref").agg(F.sort_array(F.collect_list("hub")).alias("hubs"))
                    .select("band", F.xxhash64("ref", "hubs").alias("joint")))
        least = F.min("place").alias("place"), F.max("lead").alias("lead")
        gathered = members.join(joint, "band").groupBy("joint", "id", "component", "size", "apart").agg(*least)
        against = chosen.join(joint, "band").groupBy("joint", "hub", "component", "size", "apart").agg(F.min("place").alias("place")).select(
            "joint", "hub", *(F.col(c).alias(f"_{c}") for c in ("component", "size", "apart", "place")))
        alike = (F.least("size", "_size") * 100 >= F.greatest("size", "_size") * percent) & (F.col("lead") | (F.col("_apart") <= F.col("apart")))
        # At the first element that two differences share, they share it and what comes after it at most.
        share = F.least(F.col("apart") - F.col("place"), F.col("_apart") - F.col("_place")) + 1
        alike &= (F.col("apart") + F.col("_apart") - 2 * share) * (100 + percent) <= (F.col("size") + F.col("_size")) * (100 - percent)
        pairs = (gathered.join(against, "joint").where((F.col("component") != F.col("_component")) & alike)
                 .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"))
        found = cut(verified(pairs, sets, percent))
        tested = tested.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            names = components(links)
        members = members.join(chosen.select("band", F.col("hub").alias("id")), ["band", "id"], "left_anti").drop("component")
        hubs *= 4

    named = classes.drop("bands").join(names, "id", "left").select(
        "digest", "copies", F.coalesce("component", "id").alias("component_id"))
    result = lookup_join(some.drop("bands"), named, "digest", "copies")
    rest = rows.where("digest is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return result.select(columns).unionByName(rest.select(columns)).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _repeated_ids(rows: DataFrame) -> bool:
    """Whether one doc_id has several sets; then its sets belong together."""
    return not rows.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").isEmpty()
