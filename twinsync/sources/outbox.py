"""Outbox tables, the merged event timeline and its delimited export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync import spec

# Columns of the exported timeline, in order.
TIMELINE = [
    "SourceDatabase", "SourceTable", "EventId", "AggregateId", "AggregateType", "EventType",
    "Payload", "UniqueIdentifier", "CreatedAt",
]
_FIELDS = [
    "event_id", "aggregate_id", "aggregate_type", "event_type", "payload", "unique_identifier",
]


def entries(outbox: DataFrame, database: str, table: str) -> DataFrame:
    """Rows of one outbox table in the timeline's columns; ids become text, so both sides fit together."""
    return outbox.select(
        F.lit(database).alias("SourceDatabase"), F.lit(table).alias("SourceTable"),
        *[F.col(c).cast("string").alias(n) for c, n in zip(_FIELDS, TIMELINE[2:8])],
        F.col("created_at").cast("timestamp").alias("CreatedAt"),
    )


def side_entries(tables: dict[str, DataFrame], database: str) -> DataFrame:
    """All outbox tables of one side."""
    found = None
    for name, outbox in tables.items():
        part = entries(outbox, database, name)
        found = part if found is None else found.unionByName(part)
    return found


def read_side(spark: SparkSession, folder: str, source: str, reader=None) -> DataFrame:
    """Scan the outbox tables of the side that feeds ``source``, as Parquet folders or by ``reader(table)``."""
    read = reader or (lambda table: spark.read.parquet(f"{folder}/{table}"))
    database = "OLD" if source == spec.OLD_TO_NEW else "NEW"
    return side_entries({t: read(t) for t in spec.OUTBOX[source].values()}, database)


def append(captured: DataFrame, path: str) -> None:
    """Add captured changes to an outbox table; the identifier serves as the event id."""
    captured.withColumn("event_id", F.col("unique_identifier")).write.mode("append").parquet(path)


def jdbc_reader(spark: SparkSession, url: str, properties: dict[str, str], key: str, bounds: tuple[int, int, int]):
    """Reader for a database side: each table is read in key ranges, one per partition."""
    low, high, parts = bounds
    return lambda table: spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def timeline(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events of both sides in one order."""
    return old.unionByName(new).orderBy("CreatedAt", "SourceDatabase", "SourceTable", "EventId")


def export_timeline(events: DataFrame, path: str) -> None:
    """Pipe-delimited text with a header, in order across part files."""
    events.select(*TIMELINE).write.option("sep", "|").option("header", True).csv(path)
