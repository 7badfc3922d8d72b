import json

import pytest

from firmweave.operators import validation as val
from pyspark.sql import functions as F

GOOD = {"company_name": "A", "confidence_score": 0.5, "sources_used": []}


def _requests(spark, docs):
    rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "request_id int, raw_input string")


def test_v1_rules(spark):
    cases = [
        ({"company_name": "Acme"}, []),
        ({}, ["company_name:missing"]),
        ({"company_name": None}, ["company_name:not_text"]),
        ({"company_name": ""}, ["company_name:too_short"]),
        ({"company_name": " "}, []),
        ({"company_name": "x" * 256}, []),
        ({"company_name": "é" * 256}, []),
        ({"company_name": "x" * 257}, ["company_name:too_long"]),
        ({"company_name": 5}, ["company_name:not_text"]),
        ({"company_name": "A", "company_domain": "d" * 512}, []),
        ({"company_name": "A", "company_domain": "d" * 513}, ["company_domain:too_long"]),
        ({"company_name": "A", "company_domain": 1}, ["company_domain:not_text"]),
        ({"company_name": "A", "company_domain": None}, []),
        ({"company_name": "A", "additional_context": {"a": 1}}, []),
        ({"company_name": "A", "additional_context": None}, []),
        ({"company_name": "A", "additional_context": [1]}, ["additional_context:not_an_object"]),
        ({"company_name": "A", "additional_context": "x"}, ["additional_context:not_an_object"]),
        ("[1]", ["raw_input:not_an_object"]),
        ("broken", ["raw_input:not_an_object"]),
        (None, ["raw_input:not_an_object"]),
        ({"company_name": "", "company_domain": 1}, ["company_name:too_short", "company_domain:not_text"]),
    ]
    df = _requests(spark, [c[0] for c in cases])
    got = {r.request_id: r.errors for r in val.check_requests(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    valid, rejected = val.validate_requests(df)
    assert valid.count() + rejected.count() == len(cases)


# field value -> accepted value, or the error
EXTRACTION_CASES = [
    ("employee_count", "100", 100), ("employee_count", "100.0", 100),
    ("employee_count", '"100"', 100), ("employee_count", '"100.0"', 100),
    ("employee_count", '" 7 "', 7), ("employee_count", "true", 1),
    ("employee_count", "100.5", "invalid"), ("employee_count", '"1,000"', "invalid"),
    ("employee_count", '""', "invalid"), ("employee_count", "-1", "invalid"),
    ("employee_count", "null", None), ("employee_count", '"1_000"', 1000),
    ("employee_count", '"1e3"', "invalid"), ("employee_count", "1e2", 100),
    ("employee_count", "[1]", "invalid"), ("founding_year", "-5", -5),
    ("founding_year", '"+5"', 5), ("founding_year", "3000000000", 3000000000),
    ("ceo_name", "5", "invalid"), ("ceo_name", "true", "invalid"), ("ceo_name", '""', ""),
    ("ceo_name", "{}", "invalid"),
    ("confidence_score", '"0.5"', 0.5), ("confidence_score", "true", 1.0),
    ("confidence_score", "0", 0.0), ("confidence_score", "1", 1.0),
    ("confidence_score", "1.01", "invalid"), ("confidence_score", "null", "invalid"),
    ("confidence_score", '"1e-1"', 0.1), ("confidence_score", '"nan"', "invalid"),
    ("confidence_score", '"0.1f"', "invalid"),
    ("news_articles", "[]", []), ("news_articles", '["a", null]', "invalid"),
    ("news_articles", '"a"', "invalid"), ("news_articles", "[1]", "invalid"),
    ("sources_used", '["a"]', ["a"]), ("sources_used", "null", "invalid"),
    ("company_name", "null", "invalid"),
]


def test_v2_coercion(spark):
    docs = []
    for field, raw, _ in EXTRACTION_CASES:
        doc = {**GOOD, field: "@@"}
        docs.append(json.dumps(doc).replace('"@@"', raw))
    df = spark.createDataFrame(list(enumerate(docs)), "request_id int, content string")
    got = {r.request_id: r for r in val.check_extractions(df).collect()}
    for i, (field, raw, want) in enumerate(EXTRACTION_CASES):
        if want == "invalid":
            assert got[i].errors == [f"{field}:invalid"], (field, raw)
            assert got[i].extraction is None
        else:
            assert got[i].errors == [], (field, raw, got[i].errors)
            assert got[i].extraction[field] == want, (field, raw)


def test_v2_documents(spark):
    docs = [
        json.dumps({"company_name": "A", "sources_used": []}),
        json.dumps([GOOD]),
        "broken",
        json.dumps({**GOOD, "extra": [1]}),
        '{"company_name": "A", "company_name": "B", "confidence_score": 1, "sources_used": []}',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "request_id int, content string")
    got = {r.request_id: r for r in val.check_extractions(df).collect()}
    assert got[0].errors == ["confidence_score:missing"]
    assert got[1].errors == got[2].errors == ["content:not_an_object"]
    assert got[3].errors == []
    assert got[4].extraction.company_name == "B"
    valid, rejected = val.validate_extractions(df)
    assert (valid.count(), rejected.count()) == (2, 3)


def test_v4(spark):
    changes = spark.createDataFrame(
        [(1, "", "v"), (2, "k" * 128, "v" * 512), (3, "k" * 129, "v"), (4, "k", "v" * 513), (5, "k", None)],
        "n int, setting_key string, setting_value string",
    )
    valid, rejected = val.validate_changes(changes)
    assert [r.n for r in valid.collect()] == [2]
    assert {r.n: r.errors for r in rejected.collect()} == {
        1: ["key:too_short"], 3: ["key:too_long"], 4: ["value:too_long"], 5: ["value:missing"]
    }
    asked = spark.createDataFrame(
        [(1, "", 1), (2, "q" * 1000, 50), (3, "q" * 1001, 10), (4, "q", 0), (5, "q", 51), (6, "q", None)],
        "n int, query string, limit int",
    )
    valid, rejected = val.validate_queries(asked)
    assert {r.n: r.limit for r in valid.collect()} == {2: 50, 6: 10}
    assert {r.n: r.errors for r in rejected.collect()} == {
        1: ["query:too_short"], 3: ["query:too_long"], 4: ["limit:too_small"], 5: ["limit:too_large"]
    }


def test_v5_v6(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1,), (1,), (3,), (3,), (None,)], "k int")
    assert {(r.k, r.copies) for r in val.duplicate_keys(child, "k").collect()} == {(1, 2), (3, 2)}
    assert [r.k for r in val.orphans(child, parent, "k", "k").collect()] == [3, 3]
    states = spark.createDataFrame([("started",), ("odd",), (None,)], "status string")
    assert {r.status for r in val.illegal_values(states, "status", ["started"]).collect()} == {"odd", None}


def test_page_arguments():
    val.check_page(0, 1)
    for bad in ((-1, 10), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            val.check_page(*bad)
