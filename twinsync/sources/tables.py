"""State tables in a shared folder.

Each table is a Parquet snapshot plus the row changes of the batches since.  A batch
writes only the rows it changes.  Readers see the snapshot without the changed keys,
and the latest change of each of those; with few changes their keys are broadcast, so
a large snapshot is scanned but not shuffled.  A batch counts once its audit row is
written, after everything else; a batch that is run again overwrites its own folders.

On a catalog with row-level writes, ``commit`` is one MERGE per table instead.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsync import spec
from twinsync.operators.state import Changes, State, empty_table
from twinsync.session import together

_AUDIT = "batch bigint, kind string, at timestamp, events bigint, applied bigint, held bigint, dead bigint, run string, run_batch bigint"

_NO_SNAPSHOT = -2  # a start-up snapshot has batch -1


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # Folders ------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def exists(self, table: str) -> bool:
        """Has the table a snapshot or changes?"""
        return self._exists(f"{self.root}/{table}")

    # The audit is kept in one folder per snapshot, so that a batch reads the rows since
    # the last compaction only, however long the stream has run.

    def _snapshot(self) -> int | None:
        """Batch of the last complete snapshot."""
        path = f"{self.root}/audit"
        if not self._exists(path):
            return None
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        entries = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        epochs = sorted(int(e.getPath().getName().removeprefix("epoch=")) for e in entries)
        done = [e for e in epochs if e > _NO_SNAPSHOT and self._exists(f"{path}/epoch={e}/snapshot/_SUCCESS")]
        return done[-1] if done else None

    def _epoch(self, snapshot: int | None) -> str:
        return f"{self.root}/audit/epoch={_NO_SNAPSHOT if snapshot is None else snapshot}"

    def audit(self) -> DataFrame:
        """One row per committed batch and per snapshot."""
        path = f"{self.root}/audit"
        if not self._exists(path):
            return self.spark.createDataFrame([], _AUDIT)
        return self.spark.read.schema(_AUDIT).parquet(f"{path}/*/*")

    def _committed(self) -> tuple[int | None, list[int]]:
        """Last snapshot, and the committed batches after it (at most those between two compactions)."""
        snapshot = self._snapshot()
        path = self._epoch(snapshot)
        if not self._exists(path):
            return snapshot, []
        rows = self.spark.read.schema(_AUDIT).parquet(f"{path}/*").where("kind = 'batch'")
        return snapshot, sorted(r["batch"] for r in rows.select("batch").distinct().collect())

    def _runs(self) -> dict[str, int]:
        """The last committed batch of every run; a compaction carries them on."""
        path = self._epoch(self._snapshot())
        if not self._exists(path):
            return {}
        rows = self.spark.read.schema(_AUDIT).parquet(f"{path}/*").where("run_batch is not null")
        return {r["run"]: r["last"] for r in rows.groupBy("run").agg(F.max("run_batch").alias("last")).collect()}

    def number_of(self, run: str, batch: int) -> int | None:
        """The store's number for a run's batch; None when it is committed.  A run commits its batches in order."""
        if batch <= self._runs().get(run, -1):
            return None
        last = self.last_batch()
        return batch if last is None else max(batch, last + 1)

    # Reading ------------------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        snapshot, batches = self._committed()
        return self._read(table, snapshot, batches)

    def _read(self, table: str, snapshot: int | None, batches: list[int]) -> DataFrame:
        key = spec.TABLE_KEYS[table]
        base_path = f"{self.root}/{table}/snapshot={snapshot}"
        if snapshot is not None and self._exists(base_path):
            base = self.spark.read.parquet(base_path)
        else:
            base = empty_table(self.spark, spec.TABLE_SCHEMAS[table])
        paths = [p for b in batches if self._exists(p := f"{self.root}/{table}/batch={b}")]
        if not paths:
            return base
        changes = self.spark.read.option("mergeSchema", True).option(
            "basePath", f"{self.root}/{table}").parquet(*paths)
        columns = [c for c in changes.columns if c not in ("batch", "step")]
        latest = (
            changes.groupBy(key)
            .agg(F.max_by(F.struct(*[c for c in columns if c != key]), F.struct("batch", "step")).alias("row"))
            .select(key, "row.*")
        )
        kept = base.join(latest.select(key), key, "left_anti")
        return kept.unionByName(latest.where("not _deleted").drop("_deleted"), allowMissingColumns=True)

    def state(self) -> State:
        """All tables as of the last committed batch; each is opened when it is first used."""
        snapshot, batches = self._committed()
        return State(self.spark, opener=lambda table: self._read(table, snapshot, batches))

    def last_batch(self) -> int | None:
        snapshot, batches = self._committed()
        if batches:
            return batches[-1]
        return None if snapshot is None or snapshot < 0 else snapshot

    def batches_since_snapshot(self) -> int:
        return len(self._committed()[1])

    # Writing ------------------------------------------------------------------

    def discard(self, batch: int) -> None:
        """Remove what an unfinished run of a batch left behind."""
        for name in [*spec.TABLE_KEYS, "event_store", "held", "dead_letter", "outcomes"]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch={batch}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def write_step(self, changes: Changes, batch: int, step: int) -> Changes:
        """Write one step's changes and continue from the written tables."""
        def write(name: str) -> DataFrame:
            delta, path = changes.tables[name], f"{self.root}/{name}/batch={batch}/step={step}"
            delta.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(delta.schema).parquet(path)

        names = list(changes.tables)
        written = together(*[partial(write, name) for name in names])
        return Changes(dict(zip(names, written)), changes.outcomes)

    def write_rows(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        """Write a batch's part of an append-only or per-batch table (events, dead letters, held events)."""
        path = f"{self.root}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read_rows(self, name: str, batch: int) -> DataFrame | None:
        path = f"{self.root}/{name}/batch={batch}"
        return self.spark.read.parquet(path) if self._exists(path) else None

    def all_rows(self, name: str) -> DataFrame | None:
        """All committed parts of an append-only table."""
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return None
        committed = self.audit().where("kind = 'batch'").select("batch").distinct()
        return self.spark.read.option("mergeSchema", True).parquet(path).join(committed, "batch", "left_semi")

    def commit(
        self, batch: int, counts: dict[str, int] | None = None, kind: str = "batch", run: str = "", run_batch: int | None = None
    ) -> None:
        """The batch's audit row; written last."""
        counts = counts or {}
        row = self.spark.range(1).select(
            F.lit(batch).cast("bigint").alias("batch"), F.lit(kind).alias("kind"), F.current_timestamp().alias("at"),
            *[F.lit(counts.get(c, 0)).cast("bigint").alias(c) for c in ("events", "applied", "held", "dead")],
            F.lit(run).alias("run"), F.lit(run_batch).cast("bigint").alias("run_batch"),
        )
        path = f"{self._epoch(batch)}/snapshot" if kind == "snapshot" else f"{self._epoch(self._snapshot())}/batch-{batch}"
        row.coalesce(1).write.mode("overwrite").parquet(path)

    def snapshot(self, state: State, batch: int) -> None:
        """Write whole tables as the new snapshot (start-up, and compaction after many batches)."""
        together(*[
            partial(rows.write.mode("overwrite").parquet, f"{self.root}/{name}/snapshot={batch}")
            for name, rows in state.tables.items()
        ])
        for run, last in self._runs().items():
            path = f"{self._epoch(batch)}/run-{hashlib.md5(run.encode()).hexdigest()}"
            rows = self.spark.createDataFrame([(batch, "run", None, 0, 0, 0, 0, run, last)], _AUDIT)
            rows.coalesce(1).write.mode("overwrite").parquet(path)
        self.commit(batch, kind="snapshot")

    def compact(self) -> None:
        """Fold the changes so far into a new snapshot."""
        snapshot, batches = self._committed()
        if batches:
            self.snapshot(State(self.spark, {
                t: self._read(t, snapshot, batches) for t in spec.TABLE_KEYS if self.exists(t)
            }), batches[-1])
