import numpy as np

from pyspark.sql import functions as F

from firmweave.operators import search as X


def brute(vectors, query, k):
    scored = []
    for i, v in vectors.items():
        if v is None or len(v) != len(query):
            continue
        v, q = np.asarray(v, float), np.asarray(query, float)
        norm = np.linalg.norm(v) * np.linalg.norm(q)
        d = round(1 - float(v @ q) / norm, 12) if norm else np.inf
        scored.append((d, i))
    return [i for _, i in sorted(scored)[:k]]


def table(spark, vectors, name="id"):
    return spark.createDataFrame(
        [(i, None if v is None else [float(x) for x in v]) for i, v in vectors.items()],
        f"{name} bigint, embedding array<float>",
    )


def sample():
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=6).round(1) for i in range(60)}
    vectors[20] = vectors[10]  # equal distances
    vectors[30] = np.zeros(6)
    vectors[31] = -vectors[0]
    vectors[40] = None
    vectors[41] = np.ones(5)
    return vectors


def test_one_query(spark):
    vectors = sample()
    df = table(spark, vectors).repartition(5).withColumn("lead_id", F.col("id") % 3)
    for k in (1, 10, 100):
        got = X.search(df, [float(x) for x in vectors[10]], k).collect()
        assert [r.id for r in got] == brute(vectors, vectors[10], k)
    assert got[-1].id == 30 and got[-1].similarity is None
    assert {r.id: r.lead_id for r in got}[10] == 1
    flipped = X.search(df, [float(x) for x in vectors[0]], 100).collect()
    assert {r.id: r.similarity for r in flipped}[31] == -1.0
    zero = X.search(df, [0.0] * 6, 3).collect()
    assert [(r.id, r.similarity) for r in zero] == [(0, None), (1, None), (2, None)]


def test_many_queries_in_chunks(spark):
    vectors = sample()
    queries = {i: vectors[i] for i in range(10)}
    want = {i: brute(vectors, q, 4) for i, q in queries.items()}
    queries |= {70: None, 71: np.ones(5), 72: np.ones(7)}
    df, asked = table(spark, vectors).repartition(3), table(spark, queries, "query_id")
    assert sorted(r.query_id for r in X.bad_queries(asked, 6).collect()) == [70, 71, 72]
    for how in ({}, {"chunk_rows": 3}):
        rows = X.search_batch(df, asked, 4, dim=6, **how).orderBy("query_id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want


def test_registered_search_of_every_fiftieth_row(spark, tmp_path):
    from catalog.queries import QUERIES

    # more queries than one chunk holds, on a grid of directions with known neighbours
    count = 50 * 4100
    cells = F.array(*[
        F.when(F.pmod(F.floor(F.col("vec_id") / 50), F.lit(64)) == k, 1.0).otherwise(0.0) + F.pmod("vec_id", F.lit(50)) * 0.01
        for k in range(64)
    ])
    made = spark.range(count).select(F.col("id").alias("vec_id"))
    made.select("vec_id", cells.cast("array<float>").alias("embedding"), F.lit(0).alias("label")).write.parquet(
        str(tmp_path / "embeddings.parquet"))
    rows = QUERIES["x2_nearest_rows"](spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.id)
    # equal vectors: ids that differ by a multiple of 50 * 64, the smallest first
    assert got == {q: [q % 3200 + 3200 * n for n in range(10)] for q in range(0, count, 50)}


def test_text_ids_and_no_queries(spark):
    vectors = {k: v for k, v in sample().items() if v is not None and len(v) == 6}
    df = table(spark, vectors).withColumn("id", F.format_string("%04d", "id"))
    asked = table(spark, {i: vectors[i] for i in range(5)}, "query_id")
    found = X.search_batch(df, asked, 3, dim=6, chunk_rows=2)
    assert dict(found.dtypes)["id"] == "string"
    got = {(r.query_id, r["rank"]): int(r.id) for r in found.collect()}
    assert got == {(q, n + 1): i for q in range(5) for n, i in enumerate(brute(vectors, vectors[q], 3))}
    nothing = X.search_batch(df, asked.limit(0), 3, dim=6)
    assert nothing.count() == 0 and dict(nothing.dtypes)["id"] == "string"


def test_summary_and_vectors(spark):
    ddl = ("lead_id string, company_name string, industry string, company_description string, "
           "ceo_name string, employee_count bigint, funding_raised string, founding_year bigint")
    df = spark.createDataFrame(
        [("a", "A", "I", "About A", "C", 5, "$1", 1999), ("b", None, "", None, None, 0, None, None)], ddl)
    got = {r.lead_id: r.content_summary for r in X.content_summary(df).collect()}
    assert got["a"] == "Company: A | Industry: I | About A | CEO: C | Employees: 5 | Funding: $1 | Founded: 1999"
    assert got["b"] == "No enrichment data available"
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "lead_id string, embedding array<float>")
    attached = {r.lead_id: r.embedding for r in X.attach_vectors(df, vectors, dim=2).collect()}
    assert attached == {"a": [1.0, 2.0], "b": [0.0, 0.0]}
    assert len(X.attach_vectors(df).first().embedding) == 1536
    bad = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, 2.0])], "id int, embedding array<float>")
    assert [r.id for r in X.bad_vectors(bad, 2).orderBy("id").collect()] == [1, 2]
