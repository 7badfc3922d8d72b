"""Exact running sums over a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from firmweave.llm.tables import materialize


def running(df: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``before``: the weight of all rows ahead in ``order`` (1 a row without ``weight``).

    Rows are dealt by range and sorted, each task sums up its own share as a stream, and
    the result is written: so a lost executor changes no place.  The tasks' totals, one
    number each, are added up on the driver.  Rows that tie in ``order`` are put in any
    order, and all of them go to one task: add columns until only equal rows tie.
    """
    schema = T.StructType([
        *df.schema.fields,
        T.StructField("_part", T.IntegerType()),
        T.StructField("_own", T.LongType()),
        T.StructField("_ahead", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = (
                pa.array([1] * batch.num_rows, pa.int64())
                if weight is None
                else pc.fill_null(batch.column(batch.schema.get_field_index(weight)).cast(pa.int64()), 0)
            )
            through = pc.add(pc.cumulative_sum(own), total)
            total = through[-1].as_py()
            columns = [
                *batch.columns, pa.array([part] * batch.num_rows, pa.int32()), own, pc.subtract(through, own)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.mapInArrow(run, schema), "running")
    # a row for each task of the shuffle
    sums = sorted(map(tuple, stored.groupBy("_part").agg(F.sum("_own")).collect()))
    offsets, total = [], 0
    for part, own in sums:
        offsets.append((part, total))
        total += own
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return stored.join(F.broadcast(table), "_part").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_ahead") + F.col("_offset")).alias("before")
    )
