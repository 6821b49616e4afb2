"""Surrogate keys and dense integer keys, both free of coordination between tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 4  # hex digits of the hash that name a numbering bucket: 65,536 buckets


def surrogate_key(entity: str, *parts: str | Column) -> Column:
    """Key made from the entity name and the source key: the same input gives the same key on replay."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(entity), *texts))


def packed(key: str | Column) -> Column:
    """A text key as bytes, made keys in 16 instead of 32; equal for equal keys only.  Other texts take 17 bytes or more."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.when(text.rlike("^[0-9a-f]{32}$"), F.unhex(text)).otherwise(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("00" * 17))))


def unpacked(key: str | Column) -> Column:
    """The text of a packed key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.octet_length(key) == 16, F.lower(F.hex(key))).otherwise(
        F.decode(F.substring(key, F.lit(1), F.octet_length(key) - 17), "UTF-8"))


def number_rows(df: DataFrame, by: Column, name: str, start: Column | int = 1) -> DataFrame:
    """Dense numbers ``start, start + 1, ...`` in the order of ``md5(by)``.

    ``by`` must be unique.  Rows are numbered inside hash buckets, which no key can
    make hot, and shifted by the size of the buckets before; only the bucket sizes
    (at most 65,536 rows) pass through one task.
    """
    # Bytes sort as their hexadecimal digits do, and take half the room in the shuffle.
    hashed = df.withColumn("_hash", F.unhex(F.md5(by))).withColumn(
        "_bucket", F.conv(F.substring(F.hex("_hash"), 1, BUCKET_DIGITS), 16, 10).cast("int"))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_bucket").orderBy("_hash")
    base = F.lit(start) if isinstance(start, int) else start
    return (
        hashed.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(shifts), "_bucket")
        .withColumn(name, (base + F.col("_shift") + F.col("_row") - 1).cast("bigint"))
        .drop("_hash", "_bucket", "_row", "_shift")
    )


def allocate_after(df: DataFrame, by: Column, name: str, used: list[tuple[DataFrame, str]]) -> DataFrame:
    """Integer keys above every key in ``used``, as an auto-increment column would give."""
    highs = None
    for table, column in used:
        part = table.agg(F.max(column).alias("_high"))
        highs = part if highs is None else highs.unionByName(part)
    high = highs.agg(F.coalesce(F.max("_high"), F.lit(0)).cast("bigint").alias("_high"))
    return number_rows(df, by, name).withColumn(name, F.col(name) + high.scalar())
