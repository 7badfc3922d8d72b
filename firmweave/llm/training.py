"""Bounded samples of labelled documents, and features in flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmweave.llm.tables import map_batches, materialize


def fold_of(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``: a column."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)).cast("int")


def sampled_ids(labels: DataFrame, label: str, parts: int, held_out: int, each: int) -> DataFrame:
    """(sample_id, y) of at most ``each`` labelled documents per class, in hash order.

    Rows of the held-out fold never enter.  An id with several labels counts as 1
    if any of them is.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(fold_of("doc_id", parts) != held_out)
        .groupBy(F.col("doc_id").alias("sample_id")).agg(F.max(label).cast("int").alias("y"))
    )
    order = [F.xxhash64("sample_id"), F.col("sample_id")]
    return materialize(
        known.where("y = 1").orderBy(*order).limit(each)
        .unionAll(known.where("y = 0").orderBy(*order).limit(each)),
        "sample",
    )


def collect_features(
    docs: DataFrame, ids: DataFrame, features: Callable[[list[str | None]], Iterator[np.ndarray]]
) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature arrays and labels of the sampled documents, in id order, on the driver."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).join(ids, F.col("doc_id") == F.col("sample_id")).select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.int32).tobytes() for f in features(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary())],
                names=["doc_id", "y", "f"],
            )

    rows = map_batches(texts, run, "doc_id long, y int, f binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.f)))
    return [np.frombuffer(bytes(r.f), np.int32) for r in rows], np.array([r.y for r in rows], np.int8)
