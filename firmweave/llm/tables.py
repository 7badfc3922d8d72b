"""Reading the given tables, running Python on small batches, writing what is read twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from firmweave.session import materialize

__all__ = ["map_batches", "materialize", "read"]

BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: rows of whole texts that go to a Python worker at once
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows.

    Rows hold whole texts, and both the JVM and the worker hold a batch, so the
    usual ten thousand rows are too many.  The setting stays with the session,
    since it is read when the plan runs.
    """
    conf = df.sparkSession.conf
    rows = int(conf.get(BATCH_KEY, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)
