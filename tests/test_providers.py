import json

from pyspark.sql import functions as F

from firmweave.operators import providers as P


def run(spark, provider, bodies, domain="d.com"):
    rows = [
        (i, "Asked", domain, True, b if isinstance(b, str) or b is None else json.dumps(b), None)
        for i, b in enumerate(bodies)
    ]
    df = spark.createDataFrame(
        rows,
        "request_id int, company_name string, company_domain string, configured boolean, "
        "body string, error string",
    )
    return [r.asDict() for r in P.normalize(df, provider).orderBy("request_id").collect()]


def test_n1(spark):
    got = run(spark, "profile", [
        {}, {"name": None}, {"name": ""}, {"linkedin": None}, {"metrics": []}, {"category": "x"},
        {"linkedin": {"handle": "h"}, "metrics": {"employees": 0, "raised": 5}},
        {"metrics": {"employees": "50", "raised": 0}}, {"metrics": {"employees": "1,200"}},
        {"metrics": {"employees": 10.5}, "foundedYear": ""}, [], "broken", {"description": {"a": 1}},
        {"description": []},
    ])
    assert [g["company_name"] for g in got[:3]] == ["Asked", None, ""]
    assert [g["error"] for g in got[3:6]] == [
        "linkedin:not_an_object", "metrics:not_an_object", "category:not_an_object"]
    assert all(g["state"] == "error" and g["company_name"] is None for g in got[3:6])
    assert (got[6]["linkedin_company_url"], got[6]["employee_count"], got[6]["funding_raised"]) == ("h", 0, "5")
    # a falsy number headed for text stays falsy
    assert (got[7]["employee_count"], got[7]["funding_raised"]) == (50, "")
    assert got[8]["employee_count"] is None
    assert [(i.field, i.original) for i in got[8]["issues"]] == [("employee_count", "1,200")]
    assert [i.field for i in got[9]["issues"]] == ["employee_count"] and got[9]["founding_year"] == 0
    assert [g["error"] for g in got[10:12]] == ["body:not_an_object", "body:not_json"]
    assert got[12]["company_description"] == '{"a":1}' and got[13]["company_description"] == ""


def test_n2(spark):
    got = run(spark, "contact", [
        {"fullName": "F"}, {"emailAddresses": []}, {"emailAddresses": [None]}, {"emailAddresses": [{}]},
        {"emailAddresses": [{"email": "a"}, {"email": "b"}]}, {"socialNetworks": None},
        {"emailAddresses": "x"}, {"emailAddresses": None, "socialNetworks": {"linkedin": "l"}},
        {"emailAddresses": {"email": "x"}}, {"emailAddresses": 0},
    ])
    assert [g["ceo_email"] for g in got] == [None, None, None, None, "a", None, None, None, None, None]
    assert [g["state"] for g in got] == [
        "ok", "ok", "error", "ok", "ok", "error", "error", "ok", "error", "ok"]
    assert got[0]["ceo_name"] == "F" and got[7]["linkedin_url"] == "l"


def test_n3(spark):
    def doc(*emails):
        return {"data": {"emails": list(emails)}}

    personal = {"type": "personal", "position": None, "value": "p"}
    ceo = {"type": "generic", "position": "CEO", "value": "c"}
    clerk = {"type": "generic", "position": "Clerk", "value": "k"}
    null = {"type": "generic", "position": None, "value": "n"}
    cases = [
        (doc(clerk), "ok", None), (doc(personal, ceo), "ok", "p"), (doc(clerk, ceo), "ok", "c"),
        (doc({"position": "Founder", "value": "f"}), "ok", "f"),
        (doc({"position": "chief EXECUTIVE officer", "value": None}, personal), "ok", None),
        (doc(null, personal), "error", None), (doc(personal, null), "ok", "p"),
        (doc({"value": "v"}), "ok", None), (doc("text"), "error", None),
        ({"data": {"emails": None}}, "error", None), ({"data": None}, "error", None),
        ({}, "ok", None), ({"data": {}}, "ok", None), ({"data": {"emails": ""}}, "ok", None),
        ({"data": {"emails": 0}}, "error", None), ({"data": {"emails": {}}}, "ok", None),
    ]
    got = run(spark, "emails", [c[0] for c in cases])
    assert [(g["state"], g["ceo_email"]) for g in got] == [c[1:] for c in cases]
    assert [g["state"] for g in run(spark, "emails", [doc(ceo)], domain="")] == ["skipped"]
    assert [g["state"] for g in run(spark, "emails", [doc(ceo)], domain=None)] == ["skipped"]


def test_n4(spark):
    cases = [
        ({"articles": [{"title": "t"}, {"url": "u"}, {"title": None, "url": "u"}, {}]}, ["t", "u", None, ""]),
        ({}, []), ({"articles": []}, []), ({"articles": None}, None), ({"articles": [None]}, None),
        ({"articles": ["x"]}, None),
    ]
    got = run(spark, "news", [c[0] for c in cases])
    assert [g["news_articles"] for g in got] == [c[1] for c in cases]
    assert [g["state"] for g in got] == ["ok", "ok", "ok", "error", "error", "error"]


def test_n5_n6(spark):
    df = spark.createDataFrame(
        [(1, "A", "d", False, None, None), (2, "A", "d", True, None, "timeout"), (3, "A", "d", None, "{}", None)],
        "request_id int, company_name string, company_domain string, configured boolean, body string, error string",
    )
    got = {r.request_id: (r.state, r.error) for r in P.normalize_news(df).collect()}
    assert got == {1: ("skipped", None), 2: ("error", "timeout"), 3: ("skipped", None)}


def test_n8(spark):
    rows = []
    for key, outcomes in {
        "s1": "s", "s2": "rs", "s3": "rrs", "late": "rrrs", "fatal": "fs", "all": "rrr", "rf": "rfs",
    }.items():
        for n, o in enumerate(outcomes, 1):
            rows.append((key, "p", n, "success" if o == "s" else "error", o == "r", f"b{n}", f"e{n}"))
    df = spark.createDataFrame(
        rows, "request_id string, provider string, attempt int, outcome string, retryable boolean, body string, error string")
    got = {
        r.request_id: (r.outcome, r.attempts_made, r.body, r.error, r.backoff_seconds)
        for r in P.reduce_attempts(df).collect()
    }
    assert got == {
        "s1": ("success", 1, "b1", None, 0), "s2": ("success", 2, "b2", None, 1),
        "s3": ("success", 3, "b3", None, 3), "late": ("error", 3, None, "e3", 3),
        "fatal": ("error", 1, None, "e1", 0), "all": ("error", 3, None, "e3", 3),
        "rf": ("error", 2, None, "e2", 1),
    }
    plan = P.reduce_attempts(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_n7(spark):
    leads = spark.createDataFrame([(1, "A", "d"), (2, "B", "")], "request_id int, company_name string, company_domain string")
    got = {(r.request_id, r.provider): r.params for r in P.provider_requests(leads).collect()}
    assert got[(1, "clearbit")] == {"domain": "d"} and got[(2, "clearbit")] == {"name": "B"}
    assert got[(1, "lusha")] == {"company": "A", "domain": "d"}
    assert (2, "hunter") not in got and got[(1, "hunter")] == {"domain": "d"}
    assert got[(2, "google_news")] == {"q": "B", "pageSize": "5", "sortBy": "relevancy", "language": "en"}
