"""The operators' registered queries and, where SQL can express them, their twins.

The public tokenizer files are found through the ``public_tokenizers`` package; every
operator takes their path or ranks as a parameter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync.llm import (bpe, chat, collocations, common, decontaminate, exact_dedup, hard_negatives, langid, line_cleaning, minhash,
                          quality, token_counts, token_shards, url_rules)
from twinsync.session import cut, scratch_dir

#: The end id that the contract of the binary output appends to every document.
END_ID = 2
#: Share of similarity, in percent, that links near-duplicates in the contract.
SIMILAR = 85


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, judged against a new digest index that takes all of them in."""
    docs = common.table(spark, folder, "documents")
    judged = exact_dedup.deduplicate(docs, exact_dedup.fresh_index(spark))
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written to binary shards and read back through their indexes."""
    docs = common.table(spark, folder, "documents")
    path = token_shards.new_folder(scratch_dir(spark))
    code = token_shards.library_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    token_shards.write_shards(docs, path, code, END_ID, shards)
    return token_shards.read_shards(spark, path)


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, folder, "documents"), SIMILAR)


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a test item, with the item and the alignment's score."""
    return decontaminate.contaminated(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return langid.identify(docs, langid.learn(docs))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(common.table(spark, folder, "pages"))


def op7_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from every participant's side; masks as starts and lengths."""
    found = chat.rotate(common.table(spark, folder, "conversations"))
    span = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["length"].cast("string")))
    return found.withColumn("mask", F.concat_ws(",", span))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return quality.score(docs, quality.learn(docs, common.table(spark, folder, "labels")))


def ranks(spark: SparkSession) -> dict[bytes, int]:
    return bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(common.table(spark, folder, "documents"), ranks(spark), public_tokenizers.PATTERN)


def made_edits(docs: DataFrame) -> DataFrame:
    """Three edits for every document, from its own text: a cut, a replacement and an insertion."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda seq, start, length, text: F.struct(
        F.lit(seq).alias("seq"), start.cast("bigint").alias("start"), F.lit(length).alias("length"), text.alias("replacement"))
    own = F.substring(F.coalesce("text", F.lit("")), 1, 12)
    return docs.select("doc_id", F.inline(F.array(
        edit(1, n - 9, 9, F.lit("")), edit(2, F.floor(n / 3), 7, F.lit("  re-written,\n")), edit(3, F.floor(n / 2), 0, own))))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document before and after edits, from kept leaves."""
    docs = common.table(spark, folder, "documents")
    code = ranks(spark)
    state = cut(token_counts.build(docs, code, public_tokenizers.PATTERN))
    found = token_counts.apply(docs, state, made_edits(docs), code, public_tokenizers.PATTERN)
    return found.select("doc_id", "tokens_before", "n_tokens", "n_chars", "n_edits", "recounted_chars")


def op11_line_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document; what lines it lost tells whether it stays."""
    return line_cleaning.clean(common.table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of every language."""
    return collocations.collocations(common.table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth vector as an anchor, against all; every seventh has the label after its own."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(common.table(spark, folder, "embeddings"), label)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def line_sql() -> str:
    """The rules of ``line_cleaning`` over lists; repeated windows by their words."""
    rules, quoted = line_cleaning, lambda x: "'" + x.replace("'", "''") + "'"
    word_list = lambda x: f"list_filter(string_split_regex({x}, {quoted(rules.BLANK)}), lambda w: w <> '')"
    count = lambda mark: f"len(list_filter(ws, lambda w: regexp_matches(w, {quoted(mark)})))"
    chars = lambda x: f"length(regexp_replace({x}, {quoted(rules.BLANK)}, '', 'g'))"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {word_list("coalesce(text, '')")} AS ws FROM documents),
        w AS (SELECT doc_id, ws[i:i + 4] AS win, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
        r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) t(k) GROUP BY doc_id),
        l AS (SELECT doc_id, line, {word_list("line")} AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
        f AS (SELECT doc_id, line, {chars("line")} AS chars, len(ws) AS n,
                     NOT regexp_matches(line, {quoted(rules.SENTENCE_END)}) OR 2 * {count(rules.MARKED_WORD)} > len(ws)
                     OR ({count(rules.SEPARATOR_WORD)} >= 2 AND len(ws) <= {count(rules.SEPARATOR_WORD)} + {rules.WORDS_BETWEEN} * ({count(rules.SEPARATOR_WORD)} + 1))
                     OR (length(line) <= {rules.SHORT_LINE} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         {quoted("|".join(rules.NOTICES))})) AS failed
              FROM l WHERE len(ws) > 0),
        s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines,
                     coalesce(sum(chars) FILTER (failed), 0) AS lost_chars FROM f GROUP BY doc_id),
        c AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({chars("text")} AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                     coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
              FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN s USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= {rules.MAX_LOST} * word_chars AS kept
        FROM c"""


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_token_shards, op3_near_duplicates, op4_decontaminate, op5_language, op6_url_filter,
                                   op7_chat_rotation, op8_quality, op9_bpe, op10_token_counts, op11_line_cleaning, op12_collocations, op13_hard_negatives, pipeline)}

ORACLES = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_chat_rotation": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, md5(text)) - 1 AS place,
                     count(*) OVER (PARTITION BY conv_id) AS total FROM t),
        p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        r AS (SELECT n.conv_id, perspective, place // 64 AS page, (total + 63) // 64 AS pages, place,
                     '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                                            ELSE 'user name=' || speaker END || chr(10) AS prefix,
                     n.text || '<|im_end|>' AS body, speaker = perspective AS own
              FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
        s AS (SELECT *, coalesce(sum(length(prefix) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, page ORDER BY place
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(prefix) AS begin FROM r)
        SELECT conv_id, perspective, CAST(page AS INTEGER) AS page, CAST(pages AS INTEGER) AS pages, CAST(count(*) AS INTEGER) AS n_turns,
               string_agg(prefix || body || chr(10), '' ORDER BY place) AS text,
               coalesce(string_agg(CASE WHEN own THEN CAST(begin AS BIGINT) || ':' || length(body) END, ',' ORDER BY place), '') AS mask
        FROM s GROUP BY conv_id, perspective, page, pages""",
    "op11_line_cleaning": line_sql(),
    "op12_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\\x20\\x09]'), lambda w: w <> '') AS ws
                   FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
        g AS (SELECT lang, ws[i:i + k - 1] AS ph FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 4) t(k))),
        f AS (SELECT lang, ph, len(ph) AS k, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
        cuts AS (SELECT lang, ph, a, j, ph[1:j] AS ph_l, ph[j + 1:k] AS ph_r FROM c, range(1, 3) t(j) WHERE j < k),
        parts AS (SELECT cuts.*, x.a AS l, y.a AS r, (1000000 * CAST(cuts.a AS HUGEINT) * cuts.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
                  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ph = ph_l JOIN f y ON y.lang = cuts.lang AND y.ph = ph_r),
        best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
        longer AS (SELECT lang, ph[1:2] AS ph, a FROM c WHERE k = 3 UNION ALL SELECT lang, ph[2:3], a FROM c WHERE k = 3),
        inside AS (SELECT c.lang, c.ph FROM c JOIN (SELECT lang, ph, max(a) AS most FROM longer GROUP BY ALL) m
                   ON m.lang = c.lang AND m.ph = c.ph WHERE 100 * most >= 50 * c.a),
        kept AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM best ANTI JOIN inside USING (lang, ph))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT vec_id, label, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM v),
        s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, CAST(sum(a.x * o.x) AS BIGINT) AS score
              FROM p a JOIN p o ON a.j = o.j AND a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
        pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT s.anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY s.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM s JOIN pos ON s.anchor_id = pos.anchor_id
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY s.anchor_id, positive_id ORDER BY score DESC, other_id) <= 10""",
}
