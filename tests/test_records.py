from datetime import datetime as dt

from pyspark.sql import functions as F

from firmweave.functions import display as D
from firmweave.operators import audit, keyed, records

LEADS = ("id string, request_id string, company_name string, status string, enriched_data string, "
         "created_at timestamp, updated_at timestamp")
LOGS = "id bigint, request_id string, step_name string, status string, payload string, timestamp timestamp"
DAY = dt(2024, 1, 1)


def leads(spark):
    states = ["completed", "failed", "odd", "pending", "processing", "completed", "completed"]
    rows = [(f"i{n}", f"r{n}", f"c{n}", s, "old", dt(2024, 1, 1 + n // 2), DAY) for n, s in enumerate(states)]
    return spark.createDataFrame(rows, LEADS)


def test_pages_are_the_full_sort(spark):
    df = leads(spark)
    order = [r.request_id for r in records.page(df, limit=200).collect()]
    assert order == ["r6", "r4", "r5", "r2", "r3", "r0", "r1"]
    paged = [r.request_id for s in range(0, 9, 3) for r in records.page(df, s, 3).collect()]
    assert paged == order
    assert [r.request_id for r in records.page(df, status="completed").collect()] == ["r6", "r5", "r0"]
    assert records.page(df, status="").count() == 7 and records.page(df, status="none").count() == 0
    assert tuple(records.page_info(df, "none").first()) == (0, 1)
    assert tuple(records.page_info(df, None, per_page=3).first()) == (7, 3)
    assert tuple(records.status_counts(df).first()) == (7, 1, 1, 3, 1)
    assert tuple(records.status_counts(df.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert records.page_skip(3) == 40


def logs(spark):
    save, gate = "save_final_lineage", "evaluate_intelligence_gate"
    rows = [
        (1, "r0", gate, "started", None, DAY), (2, "r0", gate, "success", "{}", DAY),
        (3, "r1", save, "failed", None, DAY), (4, "r1", save, "started", None, DAY),
        (5, "r1", save, "success", None, dt(2024, 1, 2)), (6, "r2", gate, "failed", None, DAY),
        (7, "r5", "spawn_fallback_agent", "skipped", None, DAY),
    ]
    return spark.createDataFrame(rows, LOGS)


def test_audit(spark):
    got = {r.request_id: r.status for r in audit.lead_status(leads(spark), logs(spark)).collect()}
    assert got == {"r0": "processing", "r1": "completed", "r2": "failed", "r3": "pending",
                   "r4": "pending", "r5": "processing", "r6": "pending"}
    spans = {(r.request_id, r.step_name): r for r in audit.step_spans(logs(spark)).collect()}
    assert spans[("r1", "save_final_lineage")].seconds == 86400
    assert spans[("r5", "spawn_fallback_agent")].started_at is None
    shown = records.runs(leads(spark), logs(spark)).collect()
    assert [(r.request_id, r.step_count) for r in shown] == [
        ("r6", 0), ("r4", 0), ("r5", 1), ("r0", 2), ("r0", 2), ("r1", 3), ("r1", 3), ("r1", 3)]
    asked = spark.createDataFrame([("r1",), ("zz",)], "request_id string")
    assert [(r.id, r.total) for r in audit.logs_for(logs(spark), asked).collect()] == [(3, 3), (4, 3), (5, 3)]


def test_usage(spark):
    empty = spark.createDataFrame([], "request_id string, input_tokens int, output_tokens int, total_tokens int")
    assert tuple(audit.usage_summary(empty).first()) == (0, 0, 0, 0)
    answers = spark.createDataFrame([("a", "broken", 1, 2), ("b", "{}", None, None)],
                                    "request_id string, content string, input_tokens int, output_tokens int")
    assert [(r.request_id, r.total_tokens) for r in audit.usage_rows(answers, "m", "s").collect()] == [("a", 3)]


def test_updates_and_cascade(spark):
    updates = spark.createDataFrame(
        [("r0", "failed", None, 1), ("r0", "completed", "new", 2), ("r1", "completed", None, 1), ("zz", "failed", "x", 1)],
        "request_id string, status string, enriched_data string, seq int")
    now = dt(2025, 1, 1)
    got = {r.request_id: (r.status, r.enriched_data, r.updated_at)
           for r in records.update_leads(leads(spark), updates, ["seq"], F.lit(now)).collect()}
    assert got["r0"] == ("completed", "new", now) and got["r1"] == ("completed", "old", now)
    assert got["r2"] == ("odd", "old", DAY) and len(got) == 7
    gone = spark.createDataFrame([("r1",)], "request_id string")
    vectors = spark.createDataFrame([("i1",), ("i0",)], "lead_id string")
    kept = records.cascade_delete(
        leads(spark), {"logs": (logs(spark), "request_id", "request_id"), "vectors": (vectors, "lead_id", "id")}, gone)
    assert (kept["leads"].count(), kept["logs"].count()) == (6, 4)
    assert [r.lead_id for r in kept["vectors"].collect()] == ["i0"]


def test_keyed(spark):
    table = spark.createDataFrame([(1, "a", "1"), (2, "b", "2")], "id int, setting_key string, setting_value string")
    changes = spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", "5", 1)],
                                    "setting_key string, setting_value string, seq int")
    as_set = lambda df: {(r.id, r.setting_key, r.setting_value) for r in df.collect()}
    assert as_set(keyed.upsert(table, changes, ["setting_key"], ["seq"])) == {(1, "a", "1"), (2, "b", "4"), (3, "c", "5")}
    kept, lost = keyed.update_existing(table, changes, ["setting_key"], ["seq"])
    assert as_set(kept) == {(1, "a", "1"), (2, "b", "4")} and [r.setting_key for r in lost.collect()] == ["c"]
    kept, lost = keyed.delete_keys(table, changes, ["setting_key"])
    assert as_set(kept) == {(1, "a", "1")} and [r.setting_key for r in lost.collect()] == ["c"]
    rows, total = keyed.list_sorted(table, "setting_key")
    assert [r.setting_key for r in rows.collect()] == ["a", "b"] and total.first().total == 2


def test_display(spark):
    df = spark.createDataFrame([("x" * 17,), ("y" * 18,)], "s string")
    assert [r[0] for r in df.select(D.short_id(F.col("s"))).collect()] == ["x" * 17, "y" * 11 + "…"]
    one = spark.range(1)
    assert one.select(D.percent(F.lit(0.1234))).first()[0] == "12.3%"
    assert one.select(D.with_thousands(F.lit(1234567))).first()[0] == "1,234,567"
    assert one.select(D.status_group(F.lit("odd"))).first()[0] == "pending"


def test_each_start_has_its_own_end(spark):
    """A step that runs again gives a span of its own; a third of all rows are one step's."""
    gate, skip = "evaluate_intelligence_gate", "spawn_fallback_agent"

    def at(seconds):
        return dt(2024, 1, 1, 0, seconds // 60, seconds % 60)

    rows = [
        (1, "r0", gate, "started", None, at(0)), (2, "r0", gate, "success", None, at(5)),
        (3, "r0", gate, "started", None, at(60)), (4, "r0", gate, "failed", None, at(62)),
        (5, "r1", skip, "skipped", None, at(1)), (6, "r1", skip, "skipped", None, at(2)),
        (7, "r1", gate, "started", None, at(3)), (8, "r1", gate, "started", None, at(4)), (9, "r1", gate, "success", None, at(9)),
        (10, "r2", gate, "success", None, at(3)), (11, "r2", gate, None, None, at(4)), (12, "r2", gate, "started", None, at(5)),
    ]
    rows += [(100 + k, "hot", gate, ["started", "success"][k % 2], None, at(k)) for k in range(600)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    for how in ("true", "false"):  # one block, several blocks
        spark.conf.set(coalesce, how)
        try:
            spans = audit.step_runs(spark.createDataFrame(rows, LOGS).repartition(5)).collect()
        finally:
            spark.conf.set(coalesce, "true")
        shown = {(r.request_id, r.step_name, r.run): (r.started_at, r.ended_at, r.status) for r in spans}
        hot = {k[2]: v for k, v in shown.items() if k[0] == "hot"}
        assert hot == {k + 1: (at(2 * k), at(2 * k + 1), "success") for k in range(300)}
        assert {k: v for k, v in shown.items() if k[0] != "hot"} == {
            ("r0", gate, 1): (at(0), at(5), "success"), ("r0", gate, 2): (at(60), at(62), "failed"),
            ("r1", skip, 1): (None, at(1), "skipped"), ("r1", skip, 2): (None, at(2), "skipped"),
            ("r1", gate, 1): (at(3), None, "started"), ("r1", gate, 2): (at(4), at(9), "success"),
            ("r2", gate, 1): (None, at(3), "success"), ("r2", gate, 2): (None, None, None),
            ("r2", gate, 3): (at(5), None, "started")}
        assert {r.seconds for r in spans if r.request_id == "r0"} == {5.0, 2.0}
