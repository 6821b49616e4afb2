"""From raw documents to encoded training text, in five stages.

Every stage is written as Parquet in the shared scratch folder and read again by the next.
All but the last return the columns of ``documents``, whole texts, unchanged.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync.functions.keys import number_rows
from twinsync.llm import bpe, decontaminate, exact_dedup, langid, minhash
from twinsync.llm.common import prepared, table
from twinsync.session import cut, scratch_dir


#: Least similarity, in percent, that links two documents in the stage: op3's value, to which the tests hold the stage.
SIMILAR = 85


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; those without one go.  If none can be learned, those without a letter go."""
    prepared(spark)
    return docs.where(langid.told(F.col("text"), langid.learn(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    prepared(spark)
    return exact_dedup.keep_first_copies(docs, exact_dedup.deduplicate(docs, exact_dedup.fresh_index(spark)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; every text is judged on its own.

    Where a doc_id names several texts, or none does, rows are told apart by numbers of their own and the
    one with the smallest number stays, else the one with the smallest doc_id.
    """
    prepared(spark)
    row = F.struct(*docs.columns).alias("_document")  # its own names meet no others
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        rows = docs.select(F.col("doc_id").alias("_n"), row)
    else:
        name = F.concat_ws("|", F.col("_document.doc_id").cast("string"), F.sha2(F.coalesce(F.col("_document.text"), F.lit("")), 256))
        rows = cut(number_rows(docs.select(row), name, "_n"))  # exact dedup has left each doc_id and text once
    judged = minhash.near_duplicates(rows.select(F.col("_n").alias("doc_id"), F.col("_document.text").alias("text")), SIMILAR)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_n"))
    return rows.join(gone, "_n", "left_anti").select("_document.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; a text goes alone, whatever else has its doc_id."""
    prepared(spark)
    found = decontaminate.copies(docs, table(spark, sf_dir, "benchmark"))
    keys = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_found")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(F.col("doc_id").alias("_doc"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.struct(*docs.columns).alias("_document"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_found"))
    return marked.join(keys, same, "left_anti").select("_document.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    prepared(spark)
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("encode", encode)]
#: Learned filters, MinHash and alignment are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
