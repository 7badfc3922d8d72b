"""Session settings the operators rely on, and the shared scratch location."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Run-time settings only: they can be applied to a session somebody else built.
RUNTIME_CONF = {
    # a repeated JSON key keeps its last value instead of failing the document
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # parsing JSON costs far more than its bytes suggest: coalesce to small
    # partitions only (partitions of real size are far above this anyway)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # and to so many that the last wave of tasks does not leave most cores idle
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # AQE splits hot shuffle partitions of the remaining sort-merge joins
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # digests, ids and texts of a job that forks are written and read once or twice
    "spark.sql.parquet.compression.codec": "zstd",
    # state that outgrows the heap of one executor must spill to disk
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; sizes (partitions, memory) stay the cluster's."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: scratch folders of this driver that are still there, each with its file system and path
_scratch: dict[str, tuple] = {}


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder, removed when the driver ends.

    ``spark.checkpoint.dir`` names that folder.  Where it is unset, a temporary
    folder serves a session on one machine, whose tasks share its disk; on a
    cluster that is an error, since other machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="firmweave-")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _scratch[path] = file_system(spark, path)
    return path


def materialize(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a plan forks into several sinks: the work runs once and a lost
    executor costs a re-read of files, not a recomputation.  The frame may be used
    as long as the driver lives; where its uses end earlier, ``materialized``
    takes the files away.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a folder, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder."""
    files, target = file_system(spark, path)
    files.delete(target, True)
    _scratch.pop(path, None)


@atexit.register
def discard_all() -> None:
    """Remove what this driver's jobs have left in the shared folder."""
    while _scratch:
        _, (files, target) = _scratch.popitem()
        try:
            files.delete(target, True)
        except Exception:  # the gateway to the JVM is gone, and with it the way to the files
            return


@contextmanager
def materialized(df: DataFrame, purpose: str = "stage") -> Iterator[DataFrame]:
    """``df`` written to the shared folder for the length of a ``with`` block.

    All uses must be over when the block ends: its folder is then removed.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        discard(spark, path)
