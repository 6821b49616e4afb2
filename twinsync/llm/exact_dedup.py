"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

Only DataFrame operations.  Texts are equal when their UTF-8 bytes are (SHA-256).  Null
texts count as empty.  A repeated row, one with the same doc_id and text, is the same
document: it is returned once and counted in ``group_size``.  A null doc_id loses to any
other; an empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync.llm.common import lookup_join, texts
from twinsync.session import cut, scratch_dir

#: Every text goes into one bucket by hash; more buckets, smaller sort-merge tasks.
SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"


class DigestIndex:
    """A Parquet table of known digests, clustered so that lookups need no shuffle of the index.

    It outlives the session: opening it again at the same path gives the same rows.  The number of
    buckets is kept beside it, as files of one number read as another would hide known digests;
    opening it with another one raises ValueError.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.buckets = spark, buckets
        layout = f"{path.rstrip('/')}-buckets"
        folder = spark._jvm.org.apache.hadoop.fs.Path(layout)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            made = spark.read.parquet(layout).first()[0]
            if made != buckets:
                raise ValueError(f"the index has {made} buckets, not {buckets}")
        else:
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(layout)
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, entries: DataFrame, batch: str) -> None:
        """Add the digests that are not there yet under a batch: one sorted file a bucket."""
        entries = entries.hint("merge").join(self.rows(), "digest", "left_anti")
        entries = entries.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        entries.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest of its text, number of its rows."""
    return (texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
            .groupBy("doc_id", "digest").agg(F.count("*").alias("copies")))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Judge a batch of documents and add its new texts to the index.

    Within a batch the row with the largest doc_id stays; a text known from an earlier
    batch stays with the row that the index names.  Without a name every call is a batch of
    its own; a call under a name that is there already belongs to that batch, so the same
    documents again give the same answer and further texts are added.  Returns doc_id,
    digest, keep_id, group_size (rows with the text: in this call, and in the batch that
    brought it) and kept.
    """
    batch = batch or uuid.uuid4().hex
    documents = cut(digests(docs))
    groups = cut(documents.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"),
                                                 F.count("*").alias("members")))
    index.append(groups, batch)  # from here on the index holds every digest of the documents
    known = index.rows().select("digest", F.col("keep_id").alias("known_id"), F.col("group_size").alias("known"), "batch")
    here = F.col("batch") == batch
    entries = cut(groups.drop("keep_id").hint("merge").join(known, "digest").select(
        "digest", F.col("known_id").alias("keep_id"), "members", here.alias("new"),
        F.when(here, F.col("group_size")).otherwise(F.col("group_size") + F.col("known")).alias("group_size")))
    return lookup_join(documents, entries, "digest", "members").select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"))


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared scratch folder."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"{scratch_dir(spark)}/digests-{uuid.uuid4().hex}", buckets)


def keep_first_copies(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The documents that stay, whole rows; of repeated rows one."""
    keys = judged.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A row goes as one column, so its own names meet no others.
    marked = docs.select(F.col("doc_id").alias("_doc"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.struct(*docs.columns).alias("_row"))
    joined = marked.join(keys, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_kept")), "left_semi")
    return joined.dropDuplicates(["_doc", "_digest"]).select("_row.*")
