"""The running synchronisation: both change streams into the state tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinsync import spec
from twinsync.operators.state import Changes
from twinsync.plans.batch import SNAPSHOT, run_batch
from twinsync.session import scratch_scope, together
from twinsync.sources.tables import TableStore


#: Reasons of dead letters that the arrival of a parent, or of the row itself, may mend.
WAITED = ("dead:dependency_timeout", "dead:parent_missing", "dead:mapping_missing")


class SchemaSync:
    """Applies micro-batches to a :class:`TableStore`; a batch that was committed is never applied twice.

    Batches are told apart by run and number: a stream that starts again from another
    checkpoint is another run, so its first batches are not taken for old ones.  Repeated
    deliveries, however late, are caught by the processed sets; no event is dropped for its age.
    """

    def __init__(
        self, spark: SparkSession, root: str, timeout_seconds: int = spec.DEPENDENCY_TIMEOUT_SECONDS,
        compact_every: int = 50,
    ):
        self.spark = spark
        self.store = TableStore(spark, root)
        self.timeout_seconds = timeout_seconds
        self.compact_every = compact_every

    @property
    def snapshot_finished(self) -> bool:
        """Has a committed batch, of this run or an earlier one, seen the last snapshot event?"""
        return not self.store.state()["sync_progress"].where(F.col("Milestone") == SNAPSHOT).isEmpty()

    def process(self, texts: DataFrame, batch: int, run: str = "") -> None:
        """One micro-batch of a run; the audit row comes last, so a batch that fails half-way is done again."""
        store = self.store
        number = store.number_of(run, batch)
        if number is None:
            return
        store.discard(number)
        with scratch_scope(self.spark):
            self._run(texts, number, run, batch)
        if store.batches_since_snapshot() >= self.compact_every:
            store.compact()

    def reoffer(self, reasons: tuple[str, ...] = WAITED) -> None:
        """Offer dead letters again, as a batch of their own: those whose parent came too late.

        What was applied in the meantime is caught by the processed sets, an update that a newer
        one has overtaken by its stamp; what still cannot be applied waits anew or becomes a dead letter again.
        """
        dead = self.store.all_rows("dead_letter")
        if dead is None:
            return
        texts = dead.where(F.col("reason").isin(*reasons)).select("value", "seq", F.col("source").alias("stream")).distinct()
        if not texts.isEmpty():
            self.process(texts, self.store.last_batch() + 1, "reoffer")

    def _run(self, texts: DataFrame, batch: int, run: str, run_batch_number: int) -> None:
        store = self.store
        previous = store.last_batch()
        held = None if previous is None else store.read_rows("held", previous)
        now = F.lit(self.spark.range(1).select(F.current_timestamp()).first()[0])

        def write(changes: Changes, step: int) -> Changes:
            return store.write_step(changes, batch, step)

        result = run_batch(store.state(), texts, held, now, self.timeout_seconds, write)
        rows = {"event_store": result.documents, "held": result.held, "dead_letter": result.dead}
        if result.outcomes is not None:
            rows["outcomes"] = result.outcomes
        written = dict(zip(rows, together(*[partial(store.write_rows, r, name, batch) for name, r in rows.items()])))
        counts = {"events": result.counts["events"], "held": written["held"].count(), "dead": written["dead_letter"].count()}
        if "outcomes" in written:
            counts["applied"] = written["outcomes"].where("outcome = 'applied'").count()
        store.commit(batch, counts, run=run, run_batch=run_batch_number)

    def start(
        self, stream: DataFrame, checkpoint: str, interval: str = spec.BATCH_INTERVAL, once: bool = False
    ) -> StreamingQuery:
        """Run on a stream with ``value, seq, stream``; ``once`` takes what is there and stops."""
        writer = stream.writeStream.foreachBatch(lambda texts, batch: self.process(texts, batch, checkpoint)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
