"""Tables of both databases as DataFrames, and the changes a batch makes to them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinsync import spec


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty: a join with it shuffles nothing."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    return spark.range(1).where(F.lit(False)).select(*columns)


class State:
    """Current tables of both sides by name; a table nobody set is opened on first use, or empty.

    ``used`` has, for old tables with a counter, what tells the greatest key given out so far
    (``counters``); without it keys are allocated behind those of the whole table.
    """

    def __init__(
        self, spark: SparkSession, tables: dict[str, DataFrame] | None = None,
        opener: Callable[[str], DataFrame] | None = None,
        used: dict[str, list[tuple[DataFrame, str]]] | None = None,
    ):
        self.spark = spark
        self.tables = dict(tables or {})
        self.opener = opener
        self.used = used or {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            empty = self.opener is None
            self.tables[name] = (
                empty_table(self.spark, spec.TABLE_SCHEMAS[name]) if empty else self.opener(name))
        return self.tables[name]

    def replace(self, **tables: DataFrame) -> State:
        return State(self.spark, {**self.tables, **tables}, self.opener, self.used)


@dataclass
class Changes:
    """What a batch does: per table the changed rows (``_deleted`` marks removals), and the fate of every event."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    outcomes: DataFrame | None = None


def merge_table(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Upsert by join; columns only one side has are kept."""
    kept = base.join(delta.select(key), key, "left_anti")
    return kept.unionByName(delta.where("not _deleted").drop("_deleted"), allowMissingColumns=True)


def merge(state: State, changes: Changes) -> State:
    """The state after a batch.  On a catalog with row-level writes this is one MERGE per table."""
    merged = {
        name: merge_table(state[name], delta, spec.TABLE_KEYS[name]) for name, delta in changes.tables.items()
    }
    return state.replace(**merged)
