"""Session settings and the scratch area used to cut lineage.

Intermediate results that several later joins read are written once as Parquet
under the folder named by ``spark.checkpoint.dir``.  A written table survives the
loss of executors, carries real size statistics (so a join against a small one is
broadcast by the optimizer's own size check) and is pruned by column.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Rows in a file of the scratch area.
FILE_ROWS = 500_000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The optimizer takes a file's size for that of its rows, but keys and repeated texts take up to sixty times as much in
    # memory: ids of five million customers would be broadcast as one megabyte.  What only looks small is shuffled, and
    # broadcast where its true size, known by then, allows.
    "spark.sql.sources.fileCompressionFactor": "30",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the submitter makes the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("twinsync")
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "12g",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's checkpoint folder, or a private one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="twinsync-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/twinsync/{spark.sparkContext.applicationId}"


_scope = threading.local()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the scratch area and continue from the written table.

    Most of what is written is hashed ids and repeated texts, which Zstandard takes to half of what Snappy does.
    Millions of such rows would be one row group, so files are kept to what one task should read.
    """
    spark = df.sparkSession
    path = f"{getattr(_scope, 'folder', None) or scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*actions: Callable[[], T]) -> list[T]:
    """Run independent Spark actions side by side; small jobs then share the cluster instead of queueing."""
    folder = getattr(_scope, "folder", None)

    def run(action: Callable[[], T]) -> T:
        _scope.folder = folder
        return action()

    if not actions:
        return []
    with ThreadPoolExecutor(max_workers=min(8, len(actions))) as pool:
        return list(pool.map(run, actions))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside the scope are dropped at its end."""
    outer = getattr(_scope, "folder", None)
    _scope.folder = f"{scratch_dir(spark)}/scope-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scope.folder)
        _scope.folder = outer
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
