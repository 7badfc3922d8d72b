"""X1, X2 over a pivot index: exact cosine search that skips what cannot be near.

On unit vectors the chord length is a metric, and its square is twice the cosine distance.
The index deals vectors to their nearest pivot and into rings by their chord to it; a block
is a ring of a pivot.  With the least and greatest chord r1, r2 of a block to its pivot
p, a query q is at least max(chord(q, p) - r2, r1 - chord(q, p), 0) away from every vector in
the block.  A search first reads the blocks around each query until these hold k
vectors; the k-th best of them bounds the answer, and the second pass reads only the
blocks that the bound does not exclude.  Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from firmweave import schemas as S
from firmweave.operators import search as X
from firmweave.session import materialize

#: pivots of an index, vectors they are chosen from, and the width of a ring
PIVOTS, SAMPLE, RING = 256, 8192, 0.1
#: rows of a pivot that one file holds
FILE_ROWS = 200_000
#: chords are compared with this much room, far above what rounded distances and the error
#: of a sum of products can move them
ROOM = 1e-5
#: beyond any chord: the bound of vectors without a direction
FAR = 3.0
#: the pivot of vectors that have no direction: they rank last, whatever the query
NO_PIVOT = -1


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to length 1, whether they have a direction)."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        units = rows / norms[:, None]
    good = np.isfinite(units).all(axis=1)
    return np.where(good[:, None], units, 0.0), good


def _chords(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (units @ pivots.T), 0.0))


def choose_pivots(embeddings: DataFrame, dim: int, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Far-apart vectors of a bounded sample: the rows with the smallest hashes of their ids.

    Each next pivot is the sampled vector farthest from those chosen, so copies of one
    vector never make two pivots.  The choice steers cost only.
    """
    good = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim))
    rows = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    known = [r["embedding"] for r in rows if None not in r["embedding"]]
    units, directed = _units(np.asarray(known, dtype=np.float64).reshape(-1, dim))
    units = units[directed]
    if not len(units):
        return units
    chosen = [0]
    apart = _chords(units, units[:1])[:, 0]
    while len(chosen) < count and apart.max() > ROOM:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _chords(units, units[chosen[-1]][None])[:, 0])
    return units[chosen]


def build_index(
    embeddings: DataFrame, path: str, dim: int = S.EMBEDDING_DIM, count: int = PIVOTS, sample: int = SAMPLE
) -> None:
    """Write the index of ``embeddings`` (id, embedding) below ``path``.

    Rows are shuffled once, by pivot and, for a pivot with more than ``FILE_ROWS`` rows, a
    hash of the id, so that a group of copies does not fill one task.  Rows of another
    length than ``dim`` are left out, as in ``search_batch``.
    """
    spark = embeddings.sparkSession
    pivots = choose_pivots(embeddings, dim, count, sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, rows = X._matrix(batch.column("embedding"), dim)
            units, directed = _units(rows)
            pivot = np.full(len(rows), NO_PIVOT, dtype=np.int32)
            chord = np.zeros(len(rows))
            if len(pivots) and len(rows):
                to = _chords(units, pivots)
                pivot = np.where(directed, to.argmin(axis=1), NO_PIVOT).astype(np.int32)
                chord = np.where(directed, to.min(axis=1), 0.0)
            kept = batch.take(pa.array(usable))
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("embedding"), pa.array(pivot),
                 pa.array((chord / RING).astype(np.int32)), pa.array(chord)],
                names=["id", "embedding", "pivot", "ring", "chord"],
            )

    kinds = {c: embeddings.schema[c].dataType.simpleString() for c in ("id", "embedding")}
    placed = materialize(
        embeddings.select("id", "embedding").mapInArrow(
            place, f"id {kinds['id']}, embedding {kinds['embedding']}, pivot int, ring int, chord double"
        ),
        "placed",
    )
    blocks = materialize(
        placed.groupBy("pivot", "ring").agg(
            F.count("*").alias("rows"), F.min("chord").alias("least"), F.max("chord").alias("greatest")
        ),
        "blocks",
    )
    # a row per pivot
    parts = blocks.groupBy("pivot").agg(F.ceil(F.sum("rows") / FILE_ROWS).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "pivot").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts"))
    ).drop("parts").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "ring")
    dealt.select("id", "embedding", "ring", "pivot").write.mode("overwrite").partitionBy("pivot").parquet(
        f"{path}/rows"
    )
    embeddings.select("id").limit(0).write.mode("overwrite").parquet(f"{path}/ids")
    blocks.coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")
    vectors = [(k, [float(x) for x in p]) for k, p in enumerate(pivots)]
    spark.createDataFrame(vectors, "pivot int, embedding array<double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/pivots")


@dataclass(frozen=True)
class PivotIndex:
    """A written index; the driver holds its pivots and a line per block (``PIVOTS`` x 21 at most)."""

    rows: DataFrame
    pivots: np.ndarray
    block_pivot: np.ndarray
    block_ring: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    dim: int

    @staticmethod
    def load(spark: SparkSession, path: str, dim: int = S.EMBEDDING_DIM) -> PivotIndex:
        pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
        blocks = spark.read.parquet(f"{path}/blocks").orderBy("pivot", "ring").collect()
        kinds = spark.read.parquet(f"{path}/ids").schema
        return PivotIndex(
            # a table without rows has no folders to tell its columns
            spark.read.parquet(f"{path}/rows") if blocks else spark.createDataFrame([], kinds),
            np.array([p["embedding"] for p in pivots], dtype=np.float64).reshape(-1, dim),
            *[np.array([b[c] for b in blocks]) for c in ("pivot", "ring", "rows", "least", "greatest")],
            dim,
        )

    def _bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible chord between each query and the vectors of each block."""
        units, directed = _units(queries)
        bounds = np.zeros((len(queries), len(self.block_pivot)))
        real = np.flatnonzero(self.block_pivot != NO_PIVOT)
        if len(real):
            to = _chords(units, self.pivots)[:, self.block_pivot[real]]
            bounds[:, real] = np.maximum(np.maximum(to - self.greatest[real], self.least[real] - to), 0.0)
        bounds[~directed] = 0.0
        bounds[:, self.block_pivot == NO_PIVOT] = FAR
        return np.maximum(bounds - ROOM, 0.0)

    def _first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """For each query the nearest blocks that hold k vectors between them."""
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(np.where(self.block_pivot == NO_PIVOT, 0, self.counts)[order], axis=1)
        wanted = np.concatenate([np.zeros((len(bounds), 1)), held[:, :-1]], axis=1) < k
        mask = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(mask, order, wanted, axis=1)
        return mask

    def _scan(self, mask: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame | None:
        """The best k of each query over the blocks that its row of ``mask`` marks."""
        needed = np.flatnonzero(mask.any(axis=0))
        if not len(needed):
            return None
        # a bit for each query and needed block travels with the tasks
        bits, count = np.packbits(mask[:, needed], axis=0), len(ids)
        place = {
            (int(self.block_pivot[b]), int(self.block_ring[b])): j for j, b in enumerate(needed)
        }
        folders = sorted({pivot for pivot, _ in place})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, id_type = None, None
            for batch in batches:
                id_type = batch.schema.field("id").type
                _, rows = X._matrix(batch.column("embedding"), queries.shape[1])
                own = batch.column("id").to_numpy(zero_copy_only=False)
                own = own.astype(str) if own.dtype == object else own
                block = np.stack([batch.column(c).to_numpy() for c in ("pivot", "ring")], axis=1)
                for pivot, ring in np.unique(block, axis=0).tolist():
                    if (pivot, ring) not in place:
                        continue
                    asked = np.flatnonzero(np.unpackbits(bits[:, place[pivot, ring]], count=count))
                    at = np.flatnonzero((block == (pivot, ring)).all(axis=1))
                    step = max(1, X.SLICE_CELLS // len(asked))
                    for start in range(0, len(at), step):
                        part = at[start:start + step]
                        near = X.nearest_of(X._distances(rows[part], queries[asked]), own[part], k)
                        near = (asked[near[0]], *near[1:])
                        if best is not None:
                            near = tuple(np.concatenate(pair) for pair in zip(best, near))
                        best = X._smallest(*near, k)
            if best is not None:
                yield from X.candidate_batches(best, ids, id_type)

        schema = X._candidate_schema(self.rows.schema["id"].dataType)
        rows = self.rows.where(F.col("pivot").isin(folders)).select("id", "embedding", "pivot", "ring")
        return rows.mapInArrow(run, schema)

    def search_batch(
        self, queries: DataFrame, k: int = 10, chunk_rows: int = 4096
    ) -> tuple[DataFrame, DataFrame]:
        """(the k nearest rows of each query, a report), equal to ``search.search_batch``.

        Queries are dealt into chunks by their nearest pivot, so that those of a chunk
        need the same blocks.  The report has a row per chunk: queries, the row pairs a
        full scan would score (pairs), those scored (scored), and the same in blocks.
        """
        spark = queries.sparkSession
        good = queries.where(
            F.col("query_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == self.dim)
        )
        pivots, dim = self.pivots, self.dim

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                usable, rows = X._matrix(batch.column("embedding"), dim)
                units, _ = _units(rows)
                pivot = _chords(units, pivots).argmin(axis=1) if len(pivots) else np.zeros(len(rows), int)
                kept = batch.take(pa.array(usable))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(pivot.astype(np.int32))], names=[*batch.schema.names, "pivot"]
                )

        kind = queries.schema["embedding"].dataType.simpleString()
        stored = materialize(
            good.select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(
                near, f"query_id long, embedding {kind}, pivot int"
            ),
            "queries",
        )
        found, report = None, []
        for rows in _chunks(stored, chunk_rows):
            ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
            matrix = np.asarray([r["embedding"] for r in rows], dtype=np.float64).reshape(-1, dim)
            bounds = self._bounds(matrix)
            first = self._first(bounds, k)
            passes, read = [], first
            one = self._scan(first, ids, matrix, k)
            if one is not None:
                one = materialize(one, "candidates")
                passes.append(one)
                second = (bounds <= self._reach(one, ids, k)[:, None]) & ~first
                read = first | second
                two = self._scan(second, ids, matrix, k)
                if two is not None:
                    passes.append(materialize(two, "candidates"))
            report.append((
                len(ids), int(len(ids) * self.counts.sum()), int((read * self.counts).sum()),
                int(read.size), int(read.sum()),
            ))
            for part in passes:
                found = part if found is None else found.unionByName(part)
        if found is None:
            found = spark.createDataFrame([], X._candidate_schema(self.rows.schema["id"].dataType))
        shown = "queries long, pairs long, scored long, blocks long, read long"
        return X._ranked(found, k), spark.createDataFrame(report, shown)

    def _reach(self, found: DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
        """The chord within which each query's k best lie; without k of them, no limit."""
        kth = X._ranked(found, k).where(F.col("rank") == k).select("query_id", "distance").collect()
        by_id = {r["query_id"]: r["distance"] for r in kth}
        reach = [by_id.get(i) for i in ids.tolist()]
        return np.array([np.inf if d is None else np.sqrt(2.0 * max(d, 0.0)) + ROOM for d in reach])

    def search(self, vector: Sequence[float], limit: int = 10) -> DataFrame:
        """X1 through the index: id, distance and similarity of the nearest rows."""
        spark = self.rows.sparkSession
        one = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, embedding array<double>")
        return self.search_batch(one, limit)[0].drop("query_id").orderBy("rank")


def _chunks(stored: DataFrame, chunk_rows: int) -> Iterator[list]:
    """The queries in chunks of at most ``chunk_rows``, those of a pivot together."""
    ordered = stored.orderBy("pivot", "query_id").toLocalIterator()
    chunk = []
    for row in ordered:
        chunk.append(row)
        if len(chunk) == chunk_rows:
            yield chunk
            chunk = []
    if chunk:
        yield chunk
