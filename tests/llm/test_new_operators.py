"""Line cleaning, collocations and hard negatives against brute force, and their edge cases."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinsync.llm import collocations, common, exact_dedup, hard_negatives, line_cleaning

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


# Line cleaning ------------------------------------------------------------------------


def _measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


ODD_TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e a b c d e", "a b c d e f a b c d e x y z " * 3, "x " * 40, "über ñandú 語 𝒳 |#$ <b>\r\nsame line\r\nsame line\r\n",
    "é b c d e f g h i j k\x0bl m\x0cn.", "a b c d e b c d e a b c d e f.", "w " * 4 + "end.\n" + "w " * 4 + "end.\n\n\n",
    " ".join(f"w{i % 700}" for i in range(5000)), " ".join(f"v{i}" for i in range(20000)),
]


def test_counts_equal_brute_force(spark):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD_TEXTS)], "doc_id bigint, text string, _words string, kept int")
    found = {r["doc_id"]: r for r in line_cleaning.clean(rows).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(ODD_TEXTS):
        assert tuple(found[i][n] for n in names) == _measured(t), (i, t and t[:60])
        assert not (found[i]["base_failed"] and found[i]["kept"])


def test_windows_with_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(line_cleaning.F, "xxhash64", lambda *columns: F.lit(7).cast("bigint"))
    texts = ["a b c d e f g h", "a b c d e x a b c d e", "p q r s t " * 2 + "a b c d e f p q r s t"]
    found = {r["doc_id"]: r["n_repeat_words"] for r in line_cleaning.measure(_docs(spark, list(enumerate(texts)))).collect()}
    assert found == {i: _measured(t)[4] for i, t in enumerate(texts)}


PROSE = "The river was high that year and nobody in the valley could remember it any higher."


@pytest.mark.parametrize(("text", "kept", "failed"), [
    (PROSE, True, 0),
    (f"Home | About | Contact us\n{PROSE}\nAll rights reserved.", True, 2),
    ("Home | News | Sports | Opinion | Weather\nLocal | World | Travel | Food | Contact", False, 2),
    (" ".join(f"SHOUT{i}!!" for i in range(30)), False, 1),
    (" ".join(f"word{i}$$$" for i in range(30)) + "\n" + PROSE, False, 1),
    ("\n".join(f"heading without an end number {i}" for i in range(6)), False, 6),
    (f'{PROSE} She asked, "Why?"\n\nHe did not say (it was late).\nWait!', True, 0),
    (f"By signing in you accept that this long line, which mentions the privacy policy as one of many matters, is still read as prose because it goes on "
     f"for far longer than any notice at the foot of a page ever would. {PROSE}", True, 0),
])
def test_lines_decide(spark, text, kept, failed):
    row = line_cleaning.clean(_docs(spark, [(1, text)])).first()
    assert (row["kept"], row["n_failed_lines"]) == (kept, failed)
    if failed:
        assert len(row["cleaned"].split("\n")) == max(1, len(text.split("\n")) - failed)


def test_line_cleaning_of_nothing_and_repeats(spark):
    assert line_cleaning.clean(_docs(spark, [])).count() == 0
    rows = line_cleaning.clean(_docs(spark, [(1, PROSE), (1, PROSE), (None, PROSE)])).collect()
    assert len(rows) == 3 and all(r["kept"] for r in rows)


def test_line_cleaning_is_native_and_does_not_shuffle(spark):
    plan = line_cleaning.clean(_docs(spark, [(1, PROSE)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Hard negatives ----------------------------------------------------------------------


def _mined(rows, every=100, p=5, k=10, low=30, high=90):
    good = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None
                               and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        good.setdefault(i, ([math.floor(256 * x) for x in v], label))
    out = set()
    for a, (va, la) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, label) for i, (v, label) in good.items() if i != a)
        for s, i, _ in [x for x in scored if x[2] == la][:p]:
            hits = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= high * -s][:k]
            out |= {(a, i, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hits, 1)}
    return out


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, rank string")


def _found(frame):
    return {tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIELDS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2000)  # several blocks of anchors
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 0.5).round(1).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    rows += [(1000, None, 1), (1100, [1.0, None], 1), (1200, [float("nan")] * 6, 1), (1300, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1400, [1.0] * 6, None)]
    rows += [(20, rows[20][1], rows[20][2])] * 3 + [(21, [9.0] * 6, 2), (2000, [], 1), (2001, [0.5, 0.5], 1), (2010, [1.0] * 9, 0)]
    found = _found(hard_negatives.mine(_vectors(spark, rows), every=10))
    assert found == _mined(rows, every=10) and len(found) > 100


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e7, 2.0**40])
def test_products_are_exact_at_any_size(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=5) * scale + scale).tolist(), i % 2) for i in range(60)]
    want = _mined(rows, every=30)
    fit = lambda s: s if -2**63 <= s < 2**63 else None
    assert _found(hard_negatives.mine(_vectors(spark, rows), every=30)) == {(*x[:4], fit(x[4]), fit(x[5])) for x in want}


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(100, 130)] + [(i, [0.5, 0.5], 1) for i in range(40)]
    found = _found(hard_negatives.mine(_vectors(spark, rows)))
    assert found == _mined(rows)
    assert {x[1] for x in found if x[0] == 100} == {101, 102, 103, 104, 105}


def test_no_anchors_or_rows(spark):
    assert _found(hard_negatives.mine(_vectors(spark, []))) == set()
    assert _found(hard_negatives.mine(_vectors(spark, [(1, [1.0], 0), (2, [1.0], 1)]))) == set()
    assert _found(hard_negatives.mine(_vectors(spark, [(100, [1.0], 0), (2, [1.0], 1)]))) == set()


# Collocations -----------------------------------------------------------------------

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _phrases(rows, longest=3, least=10, share=50, first=2000):
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        for text in (r[2] or "" for r in rows if (r[1] or "und") == lang):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(_LOWER)):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q[i:j] for q, a in good.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                  if j - i < len(q) and 100 * a >= share * f[q[i:j]]}
        scored = []
        for p, a in good.items():
            if p not in inside:
                s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:first], 1)]
    return set(out)


def _mined_phrases(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, lang string, text string, range int").repartition(3)
    return {tuple(r) for r in collocations.collocations(frame, **options).collect()}


def _corpus():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        words = [f"w{int(x)}" for x in rng.zipf(1.4, 120) % 60]
        text = "The " + " ".join(words) + (" New York City." if i % 2 else " new  york\tCITY, of New York;") + " the end of the line\nof the end"
        rows.append((i, ["en", "de", None][i % 3], text))
    return [*rows, *[(500 + i, "en", "the hot phrase comes again and again") for i in range(60)], (900, "fr", None), (901, None, ""),
            (902, "en", " ".join(f"u{i} the" for i in range(3000))), (903, "xx", "Ünï cödé ñ " * 30), (904, "yy", "a\x01b a b " * 30)]


def test_collocations_equal_brute_force(spark):
    rows = _corpus()
    found = _mined_phrases(spark, rows)
    assert found == _phrases(rows) and len(found) > 50
    assert _mined_phrases(spark, rows, first=7) == _phrases(rows, first=7)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_of_many_shards_and_ranges(spark, monkeypatch, longest):
    for name, value in (("SHARD_BYTES", 3000), ("RANGE_CHARS", 4000), ("PIECE", 40), ("HELD", 300), ("APART", 50)):
        monkeypatch.setattr(collocations, name, value)
    rows = _corpus()
    assert _mined_phrases(spark, rows, longest=longest, least=5) == _phrases(rows, longest, 5)


def test_collocations_of_nothing(spark):
    assert _mined_phrases(spark, []) == set()
    assert _mined_phrases(spark, [(1, None, None), (2, "en", "a b")]) == set()


def test_scores_are_exact_beyond_64_bits():
    a, left, right = (np.array(x) for x in ([5_000_000_011, 7], [5_000_000_029, 9], [6_000_000_001, 11]))
    want = [1000000 * int(x) * int(x) // (int(y) * int(z)) for x, y, z in zip(a, left, right, strict=True)]
    assert collocations.scores(a, left, right).tolist() == want


def test_transducers_share_equal_states_and_keep_all_paths(monkeypatch):
    text = " . ".join(f"{a} {b} {c}" for a in "abcdefghij" for b in "klmnopqr" for c in "stuvwxyz").encode()
    counts, n = collocations.count_phrases([text], 3)
    small = len(counts.to_bytes())
    again = collocations.Transducer.from_bytes(counts.to_bytes())
    assert n == 3 * 640 and again.words == counts.words
    assert all(np.array_equal(x, y) for p, q in zip(counts.levels, again.levels, strict=True) for x, y in zip(p, q, strict=True))
    arrays, _ = collocations._load(counts.to_bytes())
    assert len(arrays[4]) == 3  # after a first word: all the same; after a second one; after a last one
    monkeypatch.setattr(collocations, "mixed", lambda x: x * np.uint64(0))  # all signs equal: different states must stay apart
    again = collocations.Transducer.from_bytes(counts.to_bytes())
    assert all(np.array_equal(x, y) for p, q in zip(counts.levels, again.levels, strict=True) for x, y in zip(p, q, strict=True))
    assert small <= len(counts.to_bytes())


def test_keys_hold_rows_that_do_not_fit_into_one_number():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5, (500, 4)).astype(np.int32) * 400_000_000
    order = np.argsort(collocations._keys(ids, 2**31 - 1), kind="stable")
    assert ids[order].tolist() == sorted(ids.tolist())


# Exact dedup's index -----------------------------------------------------------------


def test_an_index_keeps_its_number_of_buckets(spark, tmp_path):
    docs = _docs(spark, [(i, f"text {i}") for i in range(50)])
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    assert exact_dedup.deduplicate(docs, index).where("kept").count() == 50
    spark.sql(f"DROP TABLE {index.name}")  # as in a new session
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 7)
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    more = _docs(spark, [(100 + i, f"text {i}") for i in range(60)])
    assert exact_dedup.deduplicate(more, again).where("kept").count() == 10 and again.rows().count() == 60


# Pipeline stages ----------------------------------------------------------------------


def test_near_dedup_stage_judges_each_text_whatever_its_id_and_names(spark, data):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (5, base + " end"), (5, "a clean text with the id of a copy"), (None, base + " last"), (None, "a clean text without an id"), (7, "")]
    schema = "doc_id bigint, text string, _id int, _digest string, _row string, _n int, _found string"
    frame = spark.createDataFrame([(*r, 1, "d", "r", 2, "f") for r in rows], schema)
    found = corpus_pipeline.near(spark, frame, data)
    assert found.columns == frame.columns
    left = [r.text for r in found.collect()]
    assert sorted(left)[:3] == ["", "a clean text with the id of a copy", "a clean text without an id"] and len(left) == 4
    exact = corpus_pipeline.exact(spark, frame.unionByName(frame), data)
    assert exact.columns == frame.columns and exact.count() == 6
    unique = frame.where("doc_id in (1, 7) or text = 'a clean text with the id of a copy'")
    assert corpus_pipeline.near(spark, unique, data).count() == 3
    assert corpus_pipeline.clean(spark, frame, data).columns == frame.columns


def test_workers_forget_what_a_stage_remembered():
    from twinsync.llm import bpe, minhash

    minhash._hashes.of([b"a", b"b"])
    code = bpe.encoder("test", {bytes([b]): b for b in range(256)}, r"\S+|\s+")
    list(code.encode(["some words and more words"]))
    assert minhash._hashes and code.pieces.known
    run = common.releasing(common.releasing(iter, minhash.release), bpe.release)
    assert list(run([1, 2])) == [1, 2] and not minhash._hashes and not code.pieces.known
    assert [next(code.encode(["some"]))] == [[115, 111, 109, 101]]
    del bpe._encoders["test"]


def test_workers_forget_the_pieces_of_token_counts(spark):
    import base64

    import public_tokenizers as public
    import pyarrow as pa

    from twinsync.llm import token_counts

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        code = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    def kept(batches):
        from twinsync.llm import bpe

        for _ in batches:
            pass
        pieces = [e.pieces for e in bpe._encoders.values()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(p.known) + len(p.older) + len(p.edges) for p in pieces)], pa.int64())], names=["n"])

    docs = spark.createDataFrame([(i, f"some words of document{i} and more") for i in range(64)], "doc_id long, text string").repartition(8)
    edits = docs.selectExpr("doc_id", "1L as seq", "5L as start", "0L as length", "'new ' as replacement")
    state = token_counts.build(docs, code, public.PATTERN)
    for ran in (state, token_counts.apply(docs, state.limit(0), edits, code, public.PATTERN)):
        assert ran.count() == 64
        assert spark.range(0, 64, 1, 8).mapInArrow(kept, "n bigint").where("n > 0").isEmpty()


def test_members_of_a_round_are_made_once(spark):
    from twinsync.llm import minhash
    from twinsync.session import cut

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(band, i, i % 3 == 0) for band in range(4) for i in range(50)]
    members = spark.createDataFrame(rows, "band long, id long, lead boolean").mapInArrow(counted, "band long, id long, lead boolean")
    names = cut(spark.createDataFrame([(i, 0) for i in range(0, 50, 2)], "id long, component long"))
    left = minhash._unsettled(members, names).collect()
    assert {(r.band, r.id, r.lead, r.component) for r in left} == {(b, i, lead, 0 if i % 2 == 0 else i) for b, i, lead in rows}
    assert made.value == len(rows)
