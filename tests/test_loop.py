"""What the completion job writes, the queries read."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from firmweave import schemas as S
from firmweave.operators import audit, keyed, records, validation
from firmweave.plans import completion as C
from firmweave.session import materialized, scratch_dir
from firmweave.sources import payloads as P, sinks


@pytest.fixture()
def written(spark, tmp_path):
    rows = [(f"r{k:02d}", json.dumps({"company_name": f"Company {k}"}) if k % 5 else "broken") for k in range(40)]
    requests = spark.createDataFrame(rows, "request_id string, raw_input string").repartition(7)
    body = json.dumps({"name": "N", "url": "u"})
    landed = [(r, True, body, None) for r, _ in rows[::2]]
    profile = spark.createDataFrame(landed, "request_id string, configured boolean, body string, error string")
    verdicts = spark.createDataFrame(
        [(r, '{"missing_fields": []}', 11, 2) for r, _ in rows[::3]],
        "request_id string, content string, input_tokens int, output_tokens int")
    answer = json.dumps({"company_name": "X", "confidence_score": 0.5, "sources_used": ["s"], "industry": "I"})
    responses = spark.createDataFrame(
        [(r, answer, 100, 20) for r, _ in rows],
        "request_id string, content string, input_tokens int, output_tokens int")
    vectors = spark.createDataFrame([("r01", [1.0, 2.0])], "lead_id string, embedding array<float>")
    traced = C.trace(requests, {"profile": profile}, verdicts, responses)
    sinks.write_completion(traced, str(tmp_path), vectors=vectors, model_name="m", dim=2)
    names = {"leads": "leads", "logs": "pipeline_logs", "usage": "token_usage", "embeddings": "vector_embeddings"}
    return {k: P.read_table(spark, f"{tmp_path}/{k}", t) for k, t in names.items()}, rows


def test_logs_fold_to_the_status(written):
    tables, rows = written
    leads, logs = tables["leads"], tables["logs"]
    assert logs.where("id IS NULL OR seq IS NULL").count() == 0
    assert logs.select("id").distinct().count() == logs.count()
    want = {r.request_id: r.status for r in leads.collect()}
    assert {r.request_id: r.status for r in audit.lead_status(leads, logs).collect()} == want
    assert set(want.values()) == {"completed", "failed"}
    last = {r.request_id: r.step for r in audit.latest_step(logs).collect()}
    assert all(last[r] == S.STEP_NAMES[-1] for r, s in want.items() if s == "completed")


def test_lists_show_the_company(written):
    tables, rows = written
    names = {r: json.loads(t)["company_name"] if t != "broken" else None for r, t in rows}
    shown = {r.request_id: r.company for r in records.recent(tables["leads"], 50).collect()}
    assert shown == {r: n or "Unknown" for r, n in names.items()}
    assert {r.request_id: r.company for r in records.report(tables["leads"]).collect()} == shown
    runs = records.runs(tables["leads"], tables["logs"]).collect()
    assert {r.request_id: r.company_name for r in runs} == names
    detail = records.detail(tables["leads"], tables["logs"], tables["usage"]).collect()
    assert {r.request_id: r.name for r in detail if r.kind == "lead"} == names
    assert sum(r.kind == "log" for r in detail) == tables["logs"].count()


def test_usage_and_embeddings(written):
    tables, rows = written
    usage = tables["usage"].collect()
    good = [r for r, t in rows if t != "broken"]
    gate = {r for r, _ in rows[::3]} & set(good)
    assert {(u.request_id, u.input_tokens, u.total_tokens) for u in usage if u.step_name == S.STEP_NAMES[2]} == {
        (r, 11, 13) for r in gate}
    assert {u.request_id for u in usage if u.step_name == S.STEP_NAMES[3]} == set(good) - gate
    assert len({u.id for u in usage}) == len(usage) and {u.model_name for u in usage} == {"m"}
    vectors = {e.lead_id: e.embedding for e in tables["embeddings"].collect()}
    done = {r.request_id for r in tables["leads"].where("status = 'completed'").collect()}
    assert set(vectors) == done
    assert vectors["r01"] == [1.0, 2.0] and vectors["r02"] == [0.0, 0.0]


def test_scratch_is_removed_and_shared(spark):
    with materialized(spark.range(5), "x") as df:
        path = df.inputFiles()[0]
        assert df.count() == 5
    import os

    assert not os.path.exists(os.path.dirname(path.removeprefix("file://").removeprefix("file:")))
    assert scratch_dir(spark, "y").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_runs_meet_only_their_logs(spark):
    """With broadcasting limited, no exchange moves logs of leads that are not shown."""
    logs = spark.range(2000).select(
        F.col("id"), F.format_string("r%d", F.col("id") % 500).alias("request_id"), F.lit("fetch_apis").alias("step_name"),
        F.lit("started").alias("status"), F.lit(None).cast("string").alias("payload"),
        F.timestamp_seconds("id").alias("timestamp"))
    leads = spark.range(500).select(
        F.format_string("r%d", "id").alias("request_id"), F.lit("failed").alias("status"),
        F.lit("c").alias("company_name"), F.timestamp_seconds("id").alias("created_at"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # the logs are above it
    try:
        shown = records.runs(leads, logs, 3)
        plan = shown._jdf.queryExecution().sparkPlan().toString()
        rows = shown.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 12 and {r.step_count for r in rows} == {4}
    # wherever the logs are read, the few picked leads filter them first
    assert plan.count("LeftSemi, BuildRight") == plan.count("Range (0, 2000") == 2
    assert "SortMergeJoin [request_id" not in plan.split("LeftSemi")[1]


def test_hot_request_keeps_every_log(spark):
    logs = spark.range(4000).select(
        F.col("id"), F.when(F.col("id") < 3600, "hot").otherwise(F.col("id").cast("string")).alias("request_id"),
        F.lit("s").alias("step_name"), F.lit("x").alias("status"), F.lit(None).cast("string").alias("payload"),
        F.timestamp_seconds("id").alias("timestamp"))
    totals = {r.request_id: r.total for r in audit.logs_for(logs).collect()}
    assert totals["hot"] == 3600 and len(totals) == 401


def test_inserted_rows_get_keys(spark):
    table = spark.createDataFrame([(1, "a", "x"), (7, "b", "y")], "id int, setting_key string, setting_value string")
    changes = spark.createDataFrame(
        [("b", "new"), ("d", "v"), ("c", "w"), (None, "lost")], "setting_key string, setting_value string")
    rows = sorted((r.setting_key, r.id, r.setting_value) for r in keyed.upsert(table, changes, ["setting_key"]).collect())
    assert rows == [("a", 1, "x"), ("b", 7, "new"), ("c", 8, "w"), ("d", 9, "v")]


def test_intake_makes_ids_and_times(spark):
    """Without a key each row gets an id of its own, and without a time the present one."""
    from datetime import datetime, timedelta

    begun = datetime.now() - timedelta(seconds=5)
    with materialized(sinks.intake(spark.createDataFrame([("{}",)] * 50, "raw_input string")), "intake") as leads:
        rows = leads.collect()
    assert len({r.request_id for r in rows}) == 50 and all(r.id == r.request_id for r in rows)
    assert all(len(r.request_id) == 36 and r.request_id[14] == "4" for r in rows)
    assert {r.status for r in rows} == {"pending"}
    assert all(begun <= r.created_at <= datetime.now() and r.created_at == r.updated_at for r in rows)


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    """Rows that look alike within a run, and the same rows of another run, have ids of their own."""
    steps = spark.createDataFrame(
        [("a", "fetch_apis", "started", None)] * 3 + [("b", "fetch_apis", "failed", "{}")],
        "request_id string, step_name string, status string, payload string")
    path = str(tmp_path / "logs")
    for run in ("mon", "tue", "tue"):
        sinks.append_logs(steps, path, run=run)
    logs = spark.read.parquet(path)
    assert logs.count() == 8 and validation.duplicate_keys(logs, "id").count() == 0
    usage = spark.createDataFrame([("a", "m", 1, 2, "s")], "request_id string, model_name string, input_tokens int, output_tokens int, step_name string")
    vectors = spark.createDataFrame([("a", [1.0], "c")], "lead_id string, embedding array<float>, content_summary string")
    for run in (1, 2, 2):
        sinks.append_usage(usage, f"{path}-u", run=run)
        sinks.append_embeddings(vectors, f"{path}-v", run=run)
    for kind in "uv":
        rows = spark.read.parquet(f"{path}-{kind}")
        assert rows.count() == 2 and validation.duplicate_keys(rows, "id").count() == 0


def test_scratch_goes_with_the_driver(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from firmweave.session import materialize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert materialize(spark.range(3)).count() == 3
import os; assert os.listdir({str(tmp_path)!r})
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, capture_output=True)
    assert [f for f in os.listdir(tmp_path) if f.startswith("stage-")] == []
