"""Centroid clustering by an equal-average equal-variance search.

Vectors with exactly ``dim`` components, none null or non-finite, are kept; each
component x becomes the integer floor(1024 * x), x as double.  Everything after
that is exact integer arithmetic.

Method.  Assignment: centroids are sorted by component sum.  A vector starts at the
place of its own sum and scans outward, on the nearer side first.  With d components,
sums s and t and deviations u and v (the length of a vector less its mean), the
squared distance is at least (s - t)^2 / d + (u - v)^2.  The first term alone ends
the scan, since all further centroids lie farther out; both together spare the
distance of one centroid.  The bounds are taken in floating point with a margin that
exceeds its error, so they reject only what cannot win or tie, and distances are
integers.  Ties go to the smaller number.

Rounds.  Tasks send, for each centroid, exact sums of their vectors, which Spark
adds up: the driver receives at most (dim + 2) numbers a centroid, however many
vectors and tasks there are.  A round reads the vectors' column once, and nothing is
shuffled but those sums.  A centroid is a few hundred bytes and goes to the tasks with
the function; ``CENTROIDS`` bounds their number.

Defined cases: rows that are not kept have no result; fewer kept vectors with an id
than centroids asked for -> as many centroids as these; none -> no rows; a missing
vec_id never starts a centroid but is assigned; rows that repeat a vec_id are vectors
of their own (starting order: hash, then components); further columns are ignored.  A
component beyond 2^26 sends its batch through Python's unbounded integers; a
distance or sum that no long holds is NULL.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SCALE = 1024
#: most centroids that may be asked for: they travel with each task, and their sums to the driver
CENTROIDS = 4096
#: components below this keep squared distances of up to 512 components within 63 bits
NARROW = 2**26
#: sums travel in parts of so many bits, so that a long adds up those of 2^31 tasks
LIMB = 32
#: the bounds' share of error, far above that of double precision
MARGIN = 1e-9


def whole(x: float) -> int:
    """floor(SCALE * x), also where the product leaves the range of double."""
    return math.floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of kept vectors, their integers): int64, or objects where one is large."""
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    values = flat.astype(np.float64, copy=False).reshape(len(at), dim)
    good = np.isfinite(values).all(axis=1)
    at, values = at[good], values[good]
    if len(at) and np.abs(values).max() * SCALE >= NARROW:
        rows = [[whole(x) for x in row] for row in values.tolist()]
        return at, np.array(rows, dtype=object).reshape(len(at), dim)
    return at, np.floor(values * SCALE).astype(np.int64)


class Search:
    """The nearest of some centroids, by component sum and deviation."""

    def __init__(self, centroids: list[list[int]]):
        exact = np.array(centroids, dtype=object)
        self.wide = bool((np.abs(exact) >= NARROW).any())
        self.exact = exact
        if not self.wide:
            rows = exact.astype(np.int64)
            self.number = np.argsort(rows.sum(axis=1), kind="stable")
            self.rows = rows[self.number]
            self.sums, self.spread = self.features(self.rows)
        self.measured = 0

    @staticmethod
    def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = rows.sum(axis=1).astype(np.float64)
        off = rows - sums[:, None] / rows.shape[1]
        return sums, np.sqrt(np.einsum("ij,ij->i", off, off))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row."""
        if self.wide or rows.dtype == object:
            apart = np.array(
                [((self.exact - row.astype(object)) ** 2).sum(axis=1) for row in rows], dtype=object
            )
            best = [min(range(len(d)), key=d.__getitem__) for d in apart]
            return np.array(best, dtype=np.int64), np.array(
                [d[b] for d, b in zip(apart, best)], dtype=object
            )
        count, dim = len(self.rows), rows.shape[1]
        sums, spread = self.features(rows)
        after = np.searchsorted(self.sums, sums)
        before = after - 1
        label = np.full(len(rows), count, dtype=np.int64)
        best = np.full(len(rows), np.iinfo(np.int64).max, dtype=np.int64)
        edges = np.concatenate([[-np.inf], self.sums, [np.inf]])  # centroid k at place k + 1
        active = np.arange(len(rows))
        while len(active):
            below = sums[active] - edges[before[active] + 1]
            above = edges[after[active] + 1] - sums[active]
            down = below <= above
            gap = np.where(down, below, above)
            # all centroids further out differ at least as much in their sums
            left = np.isfinite(gap) & (gap * gap / dim * (1 - MARGIN) <= best[active])
            active, down, gap = active[left], down[left], gap[left]
            at = np.where(down, before[active], after[active])
            before[active[down]] -= 1
            after[active[~down]] += 1
            u, v = spread[active], self.spread[at]
            off = np.maximum(np.abs(u - v) - MARGIN * (u + v), 0.0)
            near = (gap * gap / dim + off * off) * (1 - MARGIN) <= best[active]
            who, at = active[near], at[near]
            self.measured += len(who)
            apart = rows[who] - self.rows[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            number = self.number[at]
            won = (distance < best[who]) | ((distance == best[who]) & (number < label[who]))
            best[who[won]], label[who[won]] = distance[won], number[won]
        return label, best


def first_centroids(vectors: DataFrame, count: int, dim: int, seed: int) -> list[list[int]]:
    """The kept vectors with the smallest hashes, in their order."""
    kept = vectors.where(
        F.col("vec_id").isNotNull()
        & (F.size("embedding") == dim)
        & ~F.exists(
            "embedding",
            lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
        )
    )
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.orderBy(named, "embedding").limit(count).select("embedding").collect()
    return [[whole(x) for x in r["embedding"]] for r in chosen]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if low := value & ((1 << LIMB) - 1):
            yield place, sign * low
        value >>= LIMB
        place += 1


def summed(
    vectors: DataFrame, centroids: list[list[int]], dim: int
) -> dict[int, tuple[int, int, list[int]]]:
    """For each centroid with vectors: their count, the sum of distances, the componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, totals = Search(centroids), {}
        for batch in batches:
            _, rows = integers(batch.column(0), dim)
            if not len(rows):
                continue
            label, distance = search.nearest(rows)
            for k in np.unique(label).tolist():
                own = label == k
                # a batch's sums of narrow components fit; totals are unbounded integers
                part = [int(own.sum()), sum(distance[own].tolist()), *rows[own].sum(axis=0).tolist()]
                totals[k] = [a + b for a, b in zip(totals[k], part)] if k in totals else part
        sent = [
            (k, place, limb, value)
            for k, parts in totals.items()
            for place, part in enumerate(parts)
            for limb, value in _limbs(part)
        ]
        columns = list(zip(*sent, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["k", "place", "limb", "value"]
        )

    sent = vectors.select("embedding").mapInArrow(run, "k long, place long, limb long, value long")
    added = sent.groupBy("k", "place", "limb").agg(F.sum("value").alias("value")).collect()
    totals: dict[int, list[int]] = {}
    for r in added:
        totals.setdefault(r["k"], [0] * (dim + 2))[r["place"]] += r["value"] << (LIMB * r["limb"])
    return {k: (t[0], t[1], t[2:]) for k, t in totals.items()}


def trained(vectors: DataFrame, count: int, rounds: int, dim: int, seed: int) -> list[list[int]]:
    """The centroids after ``rounds`` assignments and updates; empty ones stay."""
    centroids = first_centroids(vectors, count, dim, seed)
    for _ in range(rounds if centroids else 0):
        after = list(centroids)
        for k, (n, _, sums) in summed(vectors, centroids, dim).items():
            after[k] = [s // n for s in sums]
        if after == centroids:  # all further rounds are the same
            break
        centroids = after
    return centroids


def assigned(vectors: DataFrame, centroids: list[list[int]], dim: int) -> DataFrame:
    """vec_id, cluster, distance of each kept vector."""
    kind = vectors.schema["vec_id"].dataType
    schema = T.StructType([
        T.StructField("vec_id", kind),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids) if centroids else None
        for batch in batches:
            at, rows = integers(batch.column(1), dim)
            if search is None or not len(rows):
                continue
            label, distance = search.nearest(rows)
            if distance.dtype == object:
                distance = [_long(d) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(label.astype(np.int32)),
                    pa.array(distance, pa.int64()),
                ],
                names=schema.names,
            )

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def _long(value: int) -> int | None:
    return value if value < 2**63 else None


def _shown(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(
    vectors: DataFrame, count: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3
) -> DataFrame:
    """One row per kept vector: its cluster, squared distance, the inertias and the centroid's hash.

    ``vectors`` has vec_id and embedding.  A round costs one pass over the vectors;
    the last two passes give the sums of distances and the rows.
    """
    if not 1 <= count <= CENTROIDS:
        raise ValueError(f"count must lie within 1 and {CENTROIDS}")
    vectors = vectors.select("vec_id", "embedding")
    centroids = trained(vectors, count, rounds, dim, seed)
    sums = summed(vectors, centroids, dim) if centroids else {}
    total = _long(sum(d for _, d, _ in sums.values()))
    known = [(k, _long(sums[k][1]), _shown(centroids[k])) for k in sorted(sums)]
    table = vectors.sparkSession.createDataFrame(
        known, "cluster int, cluster_inertia long, centroid_sha256 string"
    )
    # at most CENTROIDS rows of a hundred bytes
    return assigned(vectors, centroids, dim).join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia",
        F.lit(total).cast("long").alias("inertia"), "centroid_sha256",
    )
