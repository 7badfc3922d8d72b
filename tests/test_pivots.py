"""Search through the pivot index must equal the full scan, and skip blocks where it can."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmweave.operators import pivots as P, search as X
from tests.test_search import sample, table


def both(spark, path, df, asked, k, dim, **how):
    P.build_index(df, path, dim, **{c: how.pop(c) for c in ("count", "sample") if c in how})
    index = P.PivotIndex.load(spark, path, dim)
    found, report = index.search_batch(asked, k, **how)
    got = sorted(map(tuple, found.select("query_id", "rank", "id", "similarity").collect()))
    want = X.search_batch(df, asked, k, dim).select("query_id", "rank", "id", "similarity")
    assert got == sorted(map(tuple, want.collect()))
    return got, report.collect(), index


@pytest.mark.parametrize("k", [1, 4, 200])
def test_awkward_vectors(spark, tmp_path, k):
    vectors = sample()
    vectors |= {50: np.full(6, np.nan), 51: np.full(6, 1e-30), 52: np.full(6, np.inf)}
    queries = {i: vectors[i] for i in range(10)} | {11: np.zeros(6), 70: None, 71: np.ones(5)}
    got, _, index = both(
        spark, str(tmp_path), table(spark, vectors).repartition(3), table(spark, queries, "query_id"), k, 6,
        count=7, chunk_rows=4)
    assert len({r[0] for r in got}) == 11
    one = index.search([float(x) for x in vectors[3]], k)
    assert [r.id for r in one.collect()] == [r[2] for r in got if r[0] == 3]


def test_clusters_are_skipped(spark, tmp_path):
    """Thirty clusters and a group of copies that holds a third of all rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    vectors = {i: centres[i % 30] + 0.05 * rng.normal(size=16) for i in range(2000)}
    vectors |= {i: centres[7] for i in range(2000, 3000)}
    df = table(spark, vectors).repartition(4)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    _, report, index = both(spark, str(tmp_path), df, asked, 5, 16, count=40)
    assert index.counts.sum() == 3000
    scored, pairs = sum(r.scored for r in report), sum(r.pairs for r in report)
    assert pairs == 60 * 3000 and scored < 0.5 * pairs
    assert sum(r.read for r in report) < 0.2 * sum(r.blocks for r in report)


def test_without_structure_all_is_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    df = table(spark, {i: rng.normal(size=24) for i in range(300)})
    asked = df.where("id < 20").select(F.col("id").alias("query_id"), "embedding")
    both(spark, str(tmp_path), df, asked, 10, 24, count=16, chunk_rows=7)


def test_no_rows_or_no_queries(spark, tmp_path):
    df = table(spark, sample())
    nothing = df.where("id < 0")
    asked = df.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    both(spark, f"{tmp_path}/a", nothing, asked, 3, 6)
    both(spark, f"{tmp_path}/b", df, asked.where("query_id < 0"), 3, 6)


def test_bounds_hold():
    """No vector of a block is nearer than the block's bound."""
    rng = np.random.default_rng(5)
    units, _ = P._units(rng.normal(size=(400, 8)))
    pivots, queries = units[:9], units[300:]
    chord = P._chords(units, pivots)
    pivot, ring = chord.argmin(axis=1), (chord.min(axis=1) / P.RING).astype(int)
    blocks = sorted(set(zip(pivot.tolist(), ring.tolist())))
    own = [chord[(pivot == p) & (ring == r), p] for p, r in blocks]
    index = P.PivotIndex(
        None, pivots, np.array([p for p, _ in blocks]), np.array([r for _, r in blocks]),
        np.array([len(o) for o in own]), np.array([o.min() for o in own]), np.array([o.max() for o in own]), 8)
    bounds, true = index._bounds(queries), P._chords(queries, units)
    for b, (p, r) in enumerate(blocks):
        assert (bounds[:, b] <= true[:, (pivot == p) & (ring == r)].min(axis=1)).all()
