"""Clustering against plain integers: every distance measured, no bound."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from firmweave.llm import centroids as C
from tests.llm.samples import SF, collected

DIM = 4


def plain(rows, count=3, rounds=4, dim=DIM, seed=3):
    kept = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:count]]

    def apart(v, c):
        return sum((x - y) ** 2 for x, y in zip(v, c))

    def near(v):
        return min((apart(v, c), k) for k, c in enumerate(centres))

    for _ in range(rounds if centres else 0):
        own = [near(v)[1] for _, v in kept]
        centres = [
            [sum(col) // len(col) for col in zip(*part)]
            if (part := [v for (_, v), k in zip(kept, own) if k == c]) else centres[c]
            for c in range(len(centres))
        ]
    last = [(i, *near(v)) for i, v in kept] if centres else []
    inertia = [sum(d for _, d, k in last if k == c) for c in range(len(centres))]

    def held(value):
        return value if value < 2**63 else None

    return sorted(
        ((i, k, held(d), held(inertia[k]), held(sum(inertia)), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
         for i, d, k in last), key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows],
        f"vec_id long, embedding array<{kind}>, cluster int, distance string")


def test_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = C.clusters(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collected(got) == plain(rows, 8, 10, 64)


def test_a_hot_vector_ties_and_repeats(spark):
    """A third of the rows are one vector; copies, equal ids and equal distances abound."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, DIM)]) for k in range(200)]
    rows += [(k, [1.0, 1.0, 1.0, 1.0]) for k in range(100)] + [(None, [0.0] * DIM)]
    assert collected(C.clusters(frame(spark, rows).repartition(5), 3, 4, DIM)) == plain(rows)


def test_bad_rows_and_few_vectors(spark):
    bad = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0] * 5), (5, [1.0, None, 1.0, 1.0]),
           (6, [float("nan")] * 4), (7, [1.0, float("inf"), 0.0, 0.0]), (8, [-float("inf")] * 4)]
    assert C.clusters(frame(spark, bad), 3, 4, DIM).count() == 0
    assert C.clusters(frame(spark, []), 3, 4, DIM).count() == 0
    some = [*bad, (9, [0.1, -0.1, 1e-9, -1e-9]), (10, [5.0, 5.0, 5.0, 5.0])]
    assert collected(C.clusters(frame(spark, some), 3, 4, DIM)) == plain(some)
    assert collected(C.clusters(frame(spark, [(None, [1.0] * 4)]), 3, 4, DIM)) == []
    with pytest.raises(ValueError):
        C.clusters(frame(spark, some), 0)


def test_components_beyond_the_narrow_range(spark):
    """Large components take the unbounded way; what no long holds is NULL."""
    rows = [(k, [float(x) * 1e6, 1.0, -2.0 * x, 0.5]) for k, x in enumerate(range(-20, 20))]
    assert collected(C.clusters(frame(spark, rows, "double"), 3, 4, DIM)) == plain(rows)
    huge = [(1, [1e300, 0.0, 0.0, 0.0]), (2, [-1e300, 1.7e308, 0.0, 0.0]), (3, [1.0] * 4)]
    got = collected(C.clusters(frame(spark, huge, "double"), 2, 2, DIM))
    assert [r[0] for r in got] == [1, 2, 3] and any(r[2] is None for r in got)


vector = st.lists(st.integers(-50, 50), min_size=DIM, max_size=DIM)


@settings(max_examples=200, deadline=None)
@given(st.lists(vector, min_size=1, max_size=30), st.lists(vector, min_size=1, max_size=20))
def test_the_search_is_exact(rows, centres):
    label, distance = C.Search(centres).nearest(np.array(rows, dtype=np.int64))
    for row, k, d in zip(rows, label.tolist(), distance.tolist()):
        assert (d, k) == min((sum((x - y) ** 2 for x, y in zip(row, c)), j) for j, c in enumerate(centres))


def test_the_bounds_spare_distances():
    rng = np.random.default_rng(2)
    centres = [[int(x) for x in rng.integers(-10, 10, 64) + 40 * k] for k in range(32)]
    rows = np.array(centres)[rng.integers(0, 32, 2000)] + rng.integers(-3, 4, (2000, 64))
    search = C.Search(centres)
    search.nearest(rows)
    assert search.measured < 3 * len(rows)  # of 32 each
