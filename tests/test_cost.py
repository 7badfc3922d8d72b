"""Work that must be done once per row, in generated code, and not written on the way."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import queries
from firmweave.functions import truth, variants
from firmweave.operators import providers, validation


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = {
        "orders": "id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice, "
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority",
        "customer": "id AS c_custkey, concat('Customer#', id) AS c_name, 1 AS c_nationkey, 1D AS c_acctbal, 'TOYS' AS c_mktsegment",
        "supplier": "id AS s_suppkey, concat('Supplier#', id) AS s_name",
        "part": "id AS p_partkey, 'part' AS p_name, 'brand' AS p_brand, 'type' AS p_type, 1 AS p_size",
        "lineitem": "id AS l_orderkey, id AS l_partkey, id AS l_suppkey",
        "documents": "id AS doc_id, 'a\\nb' AS text",
        "labels": "id AS doc_id, 1 AS quality, 0 AS toxic",
        "embeddings": "id AS vec_id, array_repeat(CAST(1 AS FLOAT), 64) AS embedding, 1 AS label",
    }
    for name, columns in rows.items():
        spark.sql(f"SELECT {columns} FROM range(40)").write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["f2_fill_responses", "x4_embedding_never_fails"])
def test_a_plan_that_does_not_fork_writes_nothing(spark, tables, monkeypatch, name):
    written = []
    monkeypatch.setattr(queries, "materialize", lambda df, *_: written.append(df) or df)
    assert queries.QUERIES[name](spark, tables).count() > 0
    assert not written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_names_and_codes_stay_in_generated_code(spark):
    df = spark.range(3).select(
        truth.names_where({"one": F.col("id") == 1, "some": F.col("id") > 0, "null": F.lit(None).cast("boolean")}).alias("names"),
        validation.gather_errors(F.when(F.col("id") == 2, "bad")).alias("codes"),
        truth.entries_where(
            [(F.col("id") == 2, F.struct(F.col("id").cast("string").alias("a")))], "array<struct<a:string>>"
        ).alias("entries"),
    )
    assert "lambda" not in plan(df)
    assert [tuple(r) for r in df.collect()] == [
        ([], [], []), (["one", "some"], [], []), (["some"], ["bad"], [("2",)])
    ]


def test_address_entries_are_judged_once(spark):
    body = '{"data": {"emails": [{"type": "generic", "position": "Buyer", "value": "a"}, {"type": "personal", "value": 0}]}}'
    rows = [(1, "n", "d", True, body, None), (2, "n", "d", True, '{"data": {"emails": [null]}}', None)]
    df = providers.normalize_domain_emails(
        spark.createDataFrame(
            rows, "request_id long, company_name string, company_domain string, configured boolean, body string, error string"
        ).repartition(2)
    )
    assert plan(df).count("transform(variant_get") + plan(df).count("transform(try_variant_get") <= 1
    assert sorted(df.collect()) == [(1, "ok", None, ""), (2, "error", "emails:bad_entry", None)]


def test_only_objects_are_objects(spark):
    texts = ['{}', '{"a": {"b": 1}}', '[]', '["x"]', '"{}"', 'null', '1', 'true']
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    doc = F.parse_json("t")
    found = docs.select("i", variants.is_object(doc).alias("root"), variants.is_object(doc, "$.a").alias("a"))
    assert [r.i for r in found.where("root").collect()] == [0, 1]
    assert [r.i for r in found.where("a").collect()] == [1]


@pytest.mark.parametrize("name", ["m1_priority_merge", "f4_fill_merge", "e1_complete_records"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, tables, capsys, name):
    """The JVM interprets a method of more than 8,000 bytes for as long as it runs."""
    df = queries.QUERIES[name](spark, tables).select("*")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_members_are_those_that_paths_name(spark):
    texts = [
        '{"a": 1, "b": {"c": "x"}, "l": [{"d": null}, null, 5]}', '{"a": null, "b": null, "l": {}}',
        '{"a": {"z": 0}, "b": [], "l": []}', '[]', 'null', '"t"', '{}',
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    doc = F.parse_json("t")
    held = variants.members(doc, "struct<a: string, b: struct<c: string>, l: array<struct<d: variant>>>")
    rows = docs.select(
        "i", held.isNotNull().alias("object"), held["a"].alias("a"), variants.raw_text(doc, "$.a").alias("path_a"),
        held["b"].isNotNull().alias("b"), variants.is_object(doc, "$.b").alias("path_b"),
        held["b"]["c"].alias("c"), variants.raw_text(doc, "$.b.c").alias("path_c"),
        F.transform(held["l"], lambda e: e.isNotNull()).alias("l"),
        F.transform(variants.elements(doc, "$.l"), lambda e: variants.is_object(e)).alias("path_l"),
        F.get(held["l"], F.lit(0))["d"].isNotNull().alias("null_is_there"),
    ).orderBy("i").collect()
    assert [r.object for r in rows] == [True, True, True, False, False, False, True]
    assert all((r.a, r.b, r.c, r.l) == (r.path_a, r.path_b, r.path_c, r.path_l) for r in rows)
    assert [r.null_is_there for r in rows][:3] == [True, False, False]
