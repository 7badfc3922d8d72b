"""Content summaries and exact cosine search.

Scoring is a matrix product per Arrow batch inside the tasks: Spark's
higher-order functions walk an array element by element outside generated code.
A task emits its own best ``k`` per query, never all pairs, and Spark merges
those few rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from firmweave import schemas as S
from firmweave.functions.truth import truthy
from firmweave.session import materialize

# Distances are compared at this many decimals, so that equal vectors tie
# whatever order their products are summed in; ties go to the smaller id.
DISTANCE_DECIMALS = 12
# Distances held at once by a task.
SLICE_CELLS = 4_000_000


def content_summary(df: DataFrame) -> DataFrame:
    """Add ``content_summary`` built from the truthy fields."""
    parts = [
        F.when(
            truthy(F.col(field), S.FIELD_TYPES[field]),
            F.concat(F.lit(label), F.col(field).cast("string")),
        )
        for label, field in S.SUMMARY_LABELS
    ]
    joined = F.concat_ws(" | ", *parts)
    return df.withColumn(
        "content_summary", F.when(joined == "", F.lit(S.NO_SUMMARY_TEXT)).otherwise(joined)
    )


def attach_vectors(
    df: DataFrame,
    vectors: DataFrame | None = None,
    key: str = "lead_id",
    dim: int = S.EMBEDDING_DIM,
) -> DataFrame:
    """Add ``embedding``; without a vector it is the zero vector.

    A left join: a missing vector never loses the record.
    """
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    if vectors is None:
        return df.withColumn("embedding", zero)
    found = vectors.select(key, F.col("embedding").alias("_vector"))
    return (
        df.join(found, key, "left")
        .withColumn("embedding", F.coalesce("_vector", zero))
        .drop("_vector")
    )


def bad_vectors(df: DataFrame, dim: int = S.EMBEDDING_DIM) -> DataFrame:
    """Rows whose vector is null or has another length."""
    return df.filter(F.col("embedding").isNull() | (F.size("embedding") != dim))


# -- X1, X2 -----------------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable rows, their vectors); other lengths and NULLs are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    usable = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
    return usable, flat.astype(np.float64, copy=False).reshape(len(usable), dim)


def _distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """1 - cosine, shape (queries, rows); infinite where either norm is zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    q_norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = (queries @ rows.T) / np.outer(q_norms, norms)
    distance = np.round(1.0 - cosine, DISTANCE_DECIMALS)
    return np.where(np.isnan(distance), np.inf, distance)


def _smallest(
    q: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest (distance, id) of each query position, grouped by query."""
    order = np.lexsort((ids, distance, q))
    q, distance, ids = q[order], distance[order], ids[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    keep = rank < k
    return q[keep], distance[keep], ids[keep]


def _candidate_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _score_batches(
    batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, k: int
) -> Iterator[pa.RecordBatch]:
    """Best k rows per query over all batches of a task.

    Only the running best and one slice of distances are held: a slice is as
    many rows as keep (queries x rows) within ``SLICE_CELLS``.
    """
    count, dim = queries.shape
    if not count:
        return
    step = max(1, SLICE_CELLS // max(1, count))
    best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    id_type = None
    for batch in batches:
        id_type = batch.schema.field("id").type
        usable, rows = _matrix(batch.column("embedding"), dim)
        ids = batch.column("id").take(pa.array(usable)).to_numpy(zero_copy_only=False)
        if ids.dtype == object:
            ids = ids.astype(str)
        for start in range(0, len(usable), step):
            distance = _distances(rows[start:start + step], queries)
            near = nearest_of(distance, ids[start:start + step], k)
            if best is not None:
                near = tuple(np.concatenate(pair) for pair in zip(best, near))
            best = _smallest(*near, k)
    if best is not None:
        yield from candidate_batches(best, query_ids, id_type)


def nearest_of(
    distance: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, distance, id) of the rows no worse than each query's k-th, ties included."""
    width = distance.shape[1]
    bound = np.partition(distance, min(k, width) - 1, axis=1)[:, min(k, width) - 1]
    q, at = np.nonzero(distance <= bound[:, None])
    return q, distance[q, at], ids[at]


def candidate_batches(
    best: tuple[np.ndarray, np.ndarray, np.ndarray], query_ids: np.ndarray, id_type: pa.DataType
) -> Iterator[pa.RecordBatch]:
    q, distance, ids = best
    for start in range(0, len(q), 10_000):
        part = slice(start, start + 10_000)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query_ids[q[part]], pa.int64()),
                pa.array(ids[part], id_type),
                pa.array(distance[part], pa.float64(), mask=np.isinf(distance[part])),
            ],
            names=["query_id", "id", "distance"],
        )


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
    return (
        candidates.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .withColumn("similarity", F.round(1.0 - F.col("distance"), 4))
    )


def search(
    embeddings: DataFrame, query_vector: Sequence[float], limit: int = 10
) -> DataFrame:
    """The ``limit`` rows nearest to one vector by cosine distance.

    ``embeddings`` has a unique ``id`` and ``embedding`` (further columns are
    joined back to the few results).  A zero vector has NULL similarity and
    ranks last.  Rows are embeddings: a lead with two vectors may appear twice.
    """
    queries = np.asarray([query_vector], dtype=np.float64)
    found = _nearest(embeddings, np.array([0]), queries, limit).drop("query_id")
    best = found.orderBy(F.col("distance").asc_nulls_last(), "id").limit(limit)
    best = best.withColumn("similarity", F.round(1.0 - F.col("distance"), 4))
    return _with_columns(embeddings, best).orderBy(F.col("distance").asc_nulls_last(), "id")


def _nearest(
    embeddings: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> DataFrame:
    schema = _candidate_schema(embeddings.schema["id"].dataType)
    return embeddings.select("id", "embedding").mapInArrow(
        lambda batches: _score_batches(batches, query_ids, queries, k), schema
    )


def _with_columns(embeddings: DataFrame, best: DataFrame) -> DataFrame:
    extra = [c for c in embeddings.columns if c not in ("id", "embedding")]
    if not extra:
        return best
    return best.join(embeddings.select("id", *extra), "id")


def bad_queries(queries: DataFrame, dim: int) -> DataFrame:
    """Queries without a vector of ``dim`` numbers: ``search_batch`` leaves them out."""
    return bad_vectors(queries, dim)


def search_batch(
    embeddings: DataFrame,
    queries: DataFrame,
    k: int = 10,
    dim: int = S.EMBEDDING_DIM,
    chunk_rows: int = 4096,
) -> DataFrame:
    """The ``k`` nearest rows for each query (query_id BIGINT, embedding).

    Queries are dealt into chunks of about ``chunk_rows``; the vectors of one
    chunk (at most a few times that many) go to every task, which scans its share
    of the embeddings, unshuffled, and emits its best ``k`` per query.  Work grows
    with queries times embeddings, as any exact search does; what is sent or
    shuffled never holds the embeddings.  Rows and queries of another length than
    ``dim`` are left out: ``bad_vectors`` and ``bad_queries`` list them.
    """
    good = queries.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim))
    stored = materialize(good.select("query_id", "embedding"), "queries")
    chunks = max(1, -(-stored.count() // chunk_rows))
    dealt = stored.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    schema = _candidate_schema(embeddings.schema["id"].dataType)
    found = None
    for chunk in range(chunks):
        rows = dealt.filter(F.col("chunk") == chunk).orderBy("query_id").collect()
        if not rows and found is not None:
            continue
        ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        matrix = np.asarray([r["embedding"] for r in rows], dtype=np.float64).reshape(-1, dim)
        near = materialize(_nearest(embeddings, ids, matrix, k), "candidates") if chunks > 1 else (
            _nearest(embeddings, ids, matrix, k)
        )
        found = near if found is None else found.unionByName(near)
    return _ranked(found.select(*schema.names), k)
