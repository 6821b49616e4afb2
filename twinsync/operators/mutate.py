"""Direct changes to tables: inserts by subquery, added columns, targeted updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_key(rows: DataFrame, key: str) -> DataFrame:
    """One row: the greatest key plus one."""
    return rows.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias(key))


def insert_with_next_key(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Add one row whose key follows the greatest one; columns without a value are null."""
    made = next_key(rows, key).select(
        *[F.col(c) if c == key else values.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return rows.unionByName(made)


def id_of(rows: DataFrame, key: str, condition: Column) -> Column:
    """Scalar subquery: the least key of the rows that meet a condition."""
    return rows.where(condition).agg(F.min(key)).scalar()


def add_nullable_column(rows: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return rows.withColumn(name, F.lit(None).cast(kind))


def add_random_decimal(rows: DataFrame, name: str, scale: int, seed: int) -> DataFrame:
    """A decimal(12, scale) column filled with ``round(rand * 10^scale, scale)``."""
    value = F.round(F.rand(seed) * F.lit(float(10**scale)), scale)
    return rows.withColumn(name, value.cast(f"decimal(12,{scale})"))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Replace column values in the rows that meet a condition."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.select(*[
        F.when(hit, values[c].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in rows.columns
    ])


def update_through(rows: DataFrame, key: str, chosen: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Replace column values in the rows whose key is among ``chosen`` (such as addresses of some customers)."""
    marks = chosen.select(key).distinct().withColumn("_hit", F.lit(True))
    marked = rows.join(marks, key, "left")
    return marked.select(*[
        F.when(F.col("_hit"), values[c].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in rows.columns
    ])


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(~F.coalesce(condition, F.lit(False)))
