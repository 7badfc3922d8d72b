"""One registered query per operator, over whole given tables.

Nested results are shown as joined text so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from catalog import views as V
from firmweave import schemas as S
from firmweave.functions.display import percent
from firmweave.functions.once import with_once
from firmweave.operators import (
    audit, keyed, merging, paging, pivots, providers, records, search, validation,
)
from firmweave.plans import changes, completion
from firmweave.session import materialize, scratch_dir
from firmweave.sources import folders, payloads as payload_source, sinks
from firmweave.streaming import requests as stream_requests, status as stream_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def now() -> Column:
    """A fixed time of writing."""
    return F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")



def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def joined(column: str | Column) -> Column:
    """List as text; the empty list is '' and a missing list NULL."""
    return F.array_join(column, "|", "<null>")


def pairs(column: str | Column, first: str, second: str) -> Column:
    return F.array_join(
        F.transform(column, lambda x: F.concat(x[first], F.lit("="), x[second])), "|"
    )


def checksum(column: str) -> Column:
    """A vector as one exact number: places times values in units of 2**-20."""
    return F.expr(
        f"aggregate(transform({column}, (v, i) -> (i + 1) * CAST(floor(CAST(v AS DOUBLE) * 1048576) AS BIGINT)), "
        "0L, (a, x) -> a + x)"
    )


def tagged(tag: str, df: DataFrame, column: str = "part") -> DataFrame:
    return df.withColumn(column, F.lit(tag))


def record_columns(record: str) -> list[Column]:
    return [
        (joined(f"{record}.{f}") if f in S.LIST_FIELDS else F.col(f"{record}.{f}")).alias(f)
        for f in S.CHECKED_FIELDS
    ]


# -- sources and sinks --------------------------------------------------------


@query
def s1_intake(spark, sf):
    raw = V.requests(spark, sf)
    leads = sinks.intake(raw.select("request_id", "raw_input"), key=F.col("request_id"), now=now())
    path = scratch_dir(spark, "s1")
    sinks.append(leads, path)
    return spark.read.parquet(path).select("id", "request_id", "raw_input", "status", "created_at")


@query
def s2_provider_source(spark, sf):
    path = scratch_dir(spark, "s2")
    for role, df in V.payloads(spark, sf).items():
        landed = df.withColumns(
            {
                "provider": F.lit(S.PROVIDER_SOURCES[role]),
                "request_id": F.col("request_id").cast("string"),
            }
        )
        landed.write.mode("append").partitionBy("provider").parquet(path)
    reads = [
        payload_source.read_provider(spark, path, role)
        .groupBy(F.lit(role).alias("role"))
        .agg(
            F.count("*").alias("n"),
            F.count_if("configured").alias("n_configured"),
            F.count("body").alias("n_bodies"),
            F.count("error").alias("n_errors"),
        )
        for role in S.PROVIDER_SOURCES
    ]
    out = reads[0]
    for more in reads[1:]:
        out = out.unionByName(more)
    return out


@query
def s3_log_sink(spark, sf):
    path = scratch_dir(spark, "s3")
    sinks.append_logs(V.logs(spark, sf), path)
    return spark.read.parquet(path).drop("seq")


@query
def s3_repeated_runs(spark, sf):
    """Two runs write the same steps, the second one twice; no row doubles and no id repeats."""
    path = scratch_dir(spark, "s3")
    steps = V.logs(spark, sf).drop("id")
    for run in (1, 2, 2):
        sinks.append_logs(steps, path, run=run)
    return spark.read.parquet(path).groupBy("request_id").agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids")
    )


@query
def s4_usage_sink(spark, sf):
    path = scratch_dir(spark, "s4")
    sinks.append_usage(V.usage(spark, sf).drop("total_tokens"), path)
    return spark.read.parquet(path)


@query
def s5_embedding_sink(spark, sf):
    path = scratch_dir(spark, "s5")
    vectors = V.embeddings(spark, sf)
    sinks.append_embeddings(vectors, path, now=now())
    sinks.append_embeddings(
        vectors.withColumn("content_summary", F.concat("content_summary", F.lit(" again"))),
        path, now=now(),
    )
    return spark.read.parquet(path).select(
        "lead_id", "content_summary", F.size("embedding").alias("dim"),
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"),
        F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last_value"),
    )


@query
def s6_leads_sink(spark, sf):
    path = scratch_dir(spark, "s6")
    leads = V.leads(spark, sf)
    done = leads.filter("status = 'processing'").select(
        "request_id", F.lower("company_name").alias("enriched_data")
    )
    sinks.write_leads(leads, done, path, now=now())
    return spark.read.parquet(path).select(
        "request_id", "status", "enriched_data", "created_at", "updated_at"
    )


# -- validation ---------------------------------------------------------------


@query
def v1_validate_requests(spark, sf):
    checked = validation.check_requests(V.requests(spark, sf))
    return checked.select(
        "request_id", "company_name", "company_domain",
        F.try_variant_get("additional_context", "$.priority", "string").alias("context_priority"),
        joined("errors").alias("errors"),
    )


@query
def v2_validate_extractions(spark, sf):
    checked = validation.check_extractions(V.responses(spark, sf))
    return checked.select(
        "request_id",
        joined("errors").alias("errors"),
        *record_columns("extraction"),
        F.round("extraction.confidence_score", 4).alias("confidence_score"),
        joined("extraction.sources_used").alias("sources_used"),
    )


@query
def v3_gap_lists(spark, sf):
    doc = F.try_parse_json("content")
    return V.verdicts(spark, sf).select(
        "request_id",
        joined(validation.gap_list(F.try_variant_get(doc, "$.missing_fields", "variant"))).alias(
            "missing_fields"
        ),
    )


@query
def v4_validate_changes(spark, sf):
    orders = V.table(spark, sf, "orders")
    changes = orders.selectExpr(
        "o_orderkey AS seq",
        """CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN repeat('k', 128)
           WHEN 3 THEN repeat('k', 129) ELSE o_orderpriority END AS setting_key""",
        """CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN repeat('v', 512)
           WHEN 2 THEN repeat('v', 513) WHEN 3 THEN '' ELSE o_orderstatus END AS setting_value""",
    )
    valid, rejected = validation.validate_changes(changes)
    return valid.select("seq", F.lit("").alias("errors")).unionByName(
        rejected.select("seq", joined("errors").alias("errors"))
    )


@query
def v4_validate_queries(spark, sf):
    asked = V.table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN NULL ELSE text END AS query",
        "CAST(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 60 END AS INT) AS limit",
    )
    valid, rejected = validation.validate_queries(asked)
    return valid.select("doc_id", "limit", F.lit("").alias("errors")).unionByName(
        rejected.select("doc_id", "limit", joined("errors").alias("errors"))
    )


@query
def v5_integrity(spark, sf):
    duplicates = validation.duplicate_keys(
        V.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber"
    ).select(
        F.lit("duplicate").alias("kind"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"),
        F.col("copies"),
    )
    leads = V.leads(spark, sf).filter("status <> 'pending'")
    lost = validation.orphans(V.logs(spark, sf), leads, "request_id", "request_id")
    return duplicates.unionByName(
        lost.groupBy(F.col("request_id").cast("string").alias("key"))
        .agg(F.count("*").alias("copies"))
        .select(F.lit("orphan").alias("kind"), "key", "copies")
    )


@query
def v6_illegal_values(spark, sf):
    states = V.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id",
        "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'paused' END AS status",
    )
    steps = V.table(spark, sf, "events").selectExpr(
        "event_id AS request_id",
        "CASE event_type WHEN 'view' THEN 'fetch_apis' WHEN 'click' THEN NULL ELSE event_type END AS step_name",
    )
    bad_status = validation.illegal_values(states, "status", S.LOG_STATUSES)
    bad_step = validation.illegal_values(steps, "step_name", S.STEP_NAMES)
    return bad_status.select("request_id", F.lit("status").alias("field"), F.col("status").alias("value")).unionByName(
        bad_step.select("request_id", F.lit("step").alias("field"), F.col("step_name").alias("value"))
    )


# -- providers ----------------------------------------------------------------


def _provider_input(spark, sf, role):
    """A provider's payloads beside the request they were fetched for."""
    leads = V.leads(spark, sf).select("request_id", "company_name", "company_domain")
    return keyed.co_locate(V.payloads(spark, sf)[role]).join(leads, "request_id")


@query
def n1_profile(spark, sf):
    r = providers.normalize_profile(_provider_input(spark, sf, "profile"))
    return r.select(
        "request_id", "state", "error", pairs("issues", "field", "original").alias("issues"),
        *providers.PROVIDER_FIELDS["profile"],
    )


@query
def n2_contact(spark, sf):
    r = providers.normalize_contact(_provider_input(spark, sf, "contact"))
    return r.select("request_id", "state", "error", *providers.PROVIDER_FIELDS["contact"])


@query
def n3_domain_emails(spark, sf):
    r = providers.normalize_domain_emails(_provider_input(spark, sf, "emails"))
    return r.select("request_id", "state", "error", "ceo_email")


@query
def n4_news(spark, sf):
    r = providers.normalize_news(_provider_input(spark, sf, "news"))
    return r.select(
        "request_id", "state", "error", F.size("news_articles").alias("n_articles"),
        joined("news_articles").alias("news_articles"),
    )


@query
def n5_provider_states(spark, sf):
    out = None
    for role in S.PROVIDER_SOURCES:
        part = _provider_input(spark, sf, role).select(
            "request_id", F.lit(role).alias("role"),
            providers.provider_state(role, F.col("configured"), F.col("company_domain")).alias("state"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def n6_provider_errors(spark, sf):
    readers = {
        "profile": providers.normalize_profile,
        "contact": providers.normalize_contact,
        "emails": providers.normalize_domain_emails,
        "news": providers.normalize_news,
    }
    out = None
    for role, normalize in readers.items():
        part = normalize(_provider_input(spark, sf, role)).filter("state = 'error'").select(
            "request_id", F.lit(role).alias("role"), "error"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def n7_provider_requests(spark, sf):
    calls = providers.provider_requests(V.leads(spark, sf))
    shown = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("params")),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        ),
        "&",
    )
    return calls.select("request_id", "provider", shown.alias("params"))


@query
def n8_reduce_attempts(spark, sf):
    return providers.reduce_attempts(V.attempts(spark, sf), order=["ts", "event_id"])


# -- merge, gaps, fill --------------------------------------------------------


def _requested(spark, sf) -> DataFrame:
    return V.leads(spark, sf).select("request_id", "company_name", "company_domain")


def _merged(spark, sf) -> DataFrame:
    return merging.merge_payloads(_requested(spark, sf), V.payloads(spark, sf))


def _gapped(spark, sf) -> DataFrame:
    return merging.decide_gaps(merging.detect_gaps(_merged(spark, sf)), V.verdicts(spark, sf))


def _filled(spark, sf) -> DataFrame:
    return merging.attach_responses(_gapped(spark, sf), V.responses(spark, sf))


@query
def m1_priority_merge(spark, sf):
    return _merged(spark, sf).select("request_id", *record_columns("api"))


@query
def m2_sources(spark, sf):
    found = merging.queried_sources(_requested(spark, sf), V.payloads(spark, sf))
    return found.select("request_id", joined("api_sources").alias("api_sources"))


@query
def m3_errors(spark, sf):
    return _merged(spark, sf).select(
        "request_id",
        pairs("api_errors", "source", "error").alias("api_errors"),
        pairs("type_issues", "field", "original").alias("type_issues"),
    )


@query
def m4_fields_populated(spark, sf):
    return _merged(spark, sf).select(
        "request_id", joined("fields_populated").alias("fields_populated")
    )


@query
def g1_detect_gaps(spark, sf):
    return merging.detect_gaps(_merged(spark, sf)).select(
        "request_id", joined("gaps").alias("gaps")
    )


@query
def g2_gap_verdict(spark, sf):
    return _gapped(spark, sf).select("request_id", joined("missing_fields").alias("missing_fields"))


@query
def g3_branch(spark, sf):
    needs, complete = merging.split_by_gaps(materialize(_gapped(spark, sf)))
    return needs.select(
        "request_id", F.lit("fill").alias("branch"), F.lit(None).cast("string").alias("reason")
    ).unionByName(
        complete.select("request_id", F.lit("skip").alias("branch"), F.col("skip_reason").alias("reason"))
    )


@query
def f1_prompts(spark, sf):
    needs, _ = merging.split_by_gaps(materialize(_gapped(spark, sf)))
    text = F.col("prompt")
    return merging.prompts(needs).select(
        "request_id",
        F.element_at(F.split(text, "\n"), 1).alias("first_line"),
        F.element_at(F.split(text, "\n"), 2).alias("fields_line"),
        F.element_at(F.split(text, "\n"), -1).alias("last_line"),
        F.contains(text, F.lit('"ceo_name" : ')).alias("shows_data"),
    )


@query
def f2_fill_responses(spark, sf):
    # one half is used: nothing forks, so the rows go on to the join unwritten
    needs, _ = merging.split_by_gaps(_gapped(spark, sf))
    return merging.attach_responses(needs, V.responses(spark, sf)).select(
        "request_id", "fill_error", F.col("extraction").isNotNull().alias("usable")
    )


@query
def f3_fields_filled(spark, sf):
    valid, _ = validation.validate_extractions(V.responses(spark, sf))
    return valid.select(
        "request_id", joined(merging.fields_filled(F.col("extraction"))).alias("fields_filled")
    )


@query
def f4_fill_merge(spark, sf):
    done = merging.fill_gaps(_filled(spark, sf))
    return done.select(
        "request_id", *record_columns("record"),
        F.round("record.confidence_score", 4).alias("confidence_score"),
        joined("record.sources_used").alias("sources_used"),
        F.round("record.fallback_confidence_score", 4).alias("fallback_confidence_score"),
        joined("record.fallback_sources_used").alias("fallback_sources_used"),
        joined("record.api_sources").alias("api_sources"),
        F.col("record.had_fallback").alias("had_fallback"),
    )


@query
def f5_result_metrics(spark, sf):
    return merging.fill_gaps(_filled(spark, sf)).select("request_id", "total_fields", "had_fallback")


def trace(spark, sf) -> DataFrame:
    return completion.trace(
        V.requests(spark, sf), V.payloads(spark, sf), V.verdicts(spark, sf), V.responses(spark, sf)
    )


def completed_leads(spark, sf) -> DataFrame:
    return shown_leads(completion.leads_of(trace(spark, sf), now=now()))


def shown_leads(leads: DataFrame) -> DataFrame:
    return leads.select(
        "request_id", "status", *record_columns("enriched_data"),
        F.round("enriched_data.confidence_score", 4).alias("confidence_score"),
        joined("enriched_data.sources_used").alias("sources_used"),
        joined("enriched_data.api_sources").alias("api_sources"),
        F.col("enriched_data.had_fallback").alias("had_fallback"),
        "created_at",
    )


@query
def e1_complete_records(spark, sf):
    return completed_leads(spark, sf)


@query
def e2_step_logs(spark, sf):
    texts = ("company_name", "error", "traceback", "has_gaps", "had_fallback", "total_fields", "reason")
    lists = ("sources_queried", "fields_populated", "missing_fields", "fields_filled")
    schema = ", ".join([*(f"{c} string" for c in texts), *(f"{c} array<string>" for c in lists)])
    logs = completion.derive_logs(trace(spark, sf), now=now())
    # each payload is parsed once, not once for each column
    read = with_once(logs, doc=F.from_json("payload", schema))
    return read.select(
        "request_id", "seq", "step_name", "status",
        F.coalesce(F.length("payload") > 0, F.lit(False)).alias("has_payload"),
        *[F.col(f"doc.{c}").alias(c) for c in texts],
        *[joined(f"doc.{c}").alias(c) for c in lists],
    )


def _written(spark, sf) -> str:
    """Everything the whole job writes, below one folder."""
    path = scratch_dir(spark, "completion")
    vectors = V.embeddings(spark, sf).select("lead_id", "embedding")
    sinks.write_completion(
        trace(spark, sf), path, now=now(), vectors=vectors,
        model_name="offline-model", dim=64,
    )
    return path


@query
def e1_usage(spark, sf):
    return completion.usage_of(trace(spark, sf), now()).select(
        "request_id", "step_name", "input_tokens", "output_tokens"
    )


@query
def e1_changed_only(spark, sf):
    """Two runs: the second one runs only the tenth of the requests whose profile has changed."""
    out, asked = scratch_dir(spark, "changes"), V.requests(spark, sf)
    given = V.payloads(spark, sf)
    stale = {**given, "profile": given["profile"].withColumn(
        "body", F.when(F.col("request_id") % 10 != 0, F.col("body"))
    )}
    for run, payloads in enumerate((stale, given)):
        enricher = stream_requests.Enricher(payloads, out, V.verdicts(spark, sf), V.responses(spark, sf))
        changes.complete_changed(asked, enricher, run)
    return shown_leads(changes.read_completed(spark, out))


@query
def e1_embeddings(spark, sf):
    vectors = V.embeddings(spark, sf).select("lead_id", "embedding")
    return completion.embeddings_of(trace(spark, sf), vectors, now(), dim=64).select(
        "lead_id", "content_summary", F.forall("embedding", lambda v: v == 0).alias("is_zero"),
        checksum("embedding").alias("checksum"),
    )


@query
def q5_recent_of_completed(spark, sf):
    """The newest of the leads that the job itself wrote."""
    return records.recent(spark.read.parquet(f"{_written(spark, sf)}/leads"))


@query
def a2_status_of_completed(spark, sf):
    """Folding the written logs gives back the status that the job gave."""
    path = _written(spark, sf)
    leads = spark.read.parquet(f"{path}/leads")
    return audit.lead_status(leads, spark.read.parquet(f"{path}/logs"))


# -- search -------------------------------------------------------------------


@query
def x0_content_summary(spark, sf):
    leads = completion.leads_of(trace(spark, sf), now=now()).select("request_id", "enriched_data.*")
    return search.content_summary(leads).select("request_id", "content_summary")


@query
def x1_nearest(spark, sf):
    vectors = V.embeddings(spark, sf)
    # one row by key: the vector asked for
    asked = vectors.filter("id = 0").select("embedding").first()["embedding"]
    return search.search(vectors, asked, 10).select(
        "lead_id", "content_summary", "similarity", percent(F.col("similarity")).alias("shown")
    )


@query
def x2_nearest_batch(spark, sf):
    """Queries are the mean vectors of the labels."""
    given = V.table(spark, sf, "embeddings")
    means = (
        given.select("label", F.posexplode("embedding").alias("at", "value"))
        .groupBy("label", "at")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("embedding"))
    )
    queries = means.select(F.col("label").cast("bigint").alias("query_id"), "embedding")
    return search.search_batch(V.embeddings(spark, sf), queries, 10, dim=64).select(
        "query_id", "id", "rank", "similarity"
    )


@query
def x2_nearest_rows(spark, sf):
    """Queries are the rows whose id is divisible by 50: they grow with the table."""
    vectors = V.embeddings(spark, sf)
    queries = vectors.where("id % 50 = 0").select(F.col("id").cast("bigint").alias("query_id"), "embedding")
    return search.search_batch(vectors, queries, 10, dim=64).select("query_id", "id", "rank", "similarity")


@query
def x2_pruned_rows(spark, sf):
    """The same search through a pivot index, which skips blocks that hold none of the nearest."""
    vectors = V.embeddings(spark, sf)
    path = scratch_dir(spark, "index")
    pivots.build_index(vectors, path, dim=64)
    queries = vectors.where("id % 50 = 0").select(F.col("id").cast("bigint").alias("query_id"), "embedding")
    found, _ = pivots.PivotIndex.load(spark, path, dim=64).search_batch(queries, 10)
    return found.select("query_id", "id", "rank", "similarity")


@query
def x3_attach_vectors(spark, sf):
    leads = V.leads(spark, sf).select(F.col("id").alias("lead_id"))
    attached = search.attach_vectors(leads, V.embeddings(spark, sf), dim=64)
    return attached.select(
        "lead_id",
        F.size("embedding").alias("dim"),
        F.forall("embedding", lambda v: v == 0).alias("is_zero"),
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"),
    )


@query
def x4_embedding_never_fails(spark, sf):
    """Every completed lead keeps its row whether or not a vector exists."""
    leads = completion.leads_of(trace(spark, sf), now=now()).filter("status = 'completed'")
    with_text = search.content_summary(leads.select(F.col("id").alias("lead_id"), "enriched_data.*"))
    attached = search.attach_vectors(
        with_text.select("lead_id", "content_summary"), V.embeddings(spark, sf).select("lead_id", "embedding"), dim=64
    )
    return attached.select(
        "lead_id", "content_summary", F.forall("embedding", lambda v: v == 0).alias("is_zero")
    )


@query
def x5_bad_vectors(spark, sf):
    damaged = V.table(spark, sf, "embeddings").selectExpr(
        "vec_id",
        """CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN slice(embedding, 1, 63)
           WHEN 2 THEN concat(embedding, array(CAST(0 AS FLOAT))) ELSE embedding END AS embedding""",
    )
    return search.bad_vectors(damaged, 64).select(
        "vec_id", F.size("embedding").alias("dim"), F.col("embedding").isNull().alias("is_null")
    ).withColumn("dim", F.when(F.col("is_null"), F.lit(None)).otherwise(F.col("dim")))


# -- lead queries -------------------------------------------------------------


@query
def q1_lookup(spark, sf):
    leads = V.leads(spark, sf)
    keys = V.table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"))
    one = records.lookup(leads, "request_id", 7)
    many = records.lookup_many(leads, keys, "request_id")
    columns = ["request_id", "company_name", "status", "created_at"]
    return tagged("one", one.select(*columns)).unionByName(tagged("many", many.select(*columns)))


@query
def q2_page(spark, sf):
    leads = V.leads(spark, sf)
    columns = ["request_id", "company_name", "status", "created_at"]
    first = records.page(leads).select(*columns)
    deep = records.page(leads, skip=120, limit=200, status="completed").select(*columns)
    return tagged("first", first).unionByName(tagged("completed", deep))


@query
def q2_deep_page(spark, sf):
    """Pages half and three quarters down the list, found by counting."""
    pages = paging.count_pages(V.leads(spark, sf), held=100)
    columns = ["request_id", "company_name", "status", "created_at"]
    middle = pages.page(pages.info()[0] // 2, 200).select(*columns)
    done = pages.page(pages.info("completed")[0] * 3 // 4, 50, "completed").select(*columns)
    return tagged("middle", middle).unionByName(tagged("completed", done))


@query
def q3_page_info(spark, sf):
    leads = V.leads(spark, sf)
    out = tagged("all", records.page_info(leads, ""))
    for status in [*S.LEAD_STATUSES, "unheard of"]:
        out = out.unionByName(tagged(status, records.page_info(leads, status)))
    return out


@query
def q4_status_counts(spark, sf):
    return records.status_counts(V.leads(spark, sf))


@query
def q5_recent(spark, sf):
    return records.recent(V.leads(spark, sf))


@query
def q6_runs(spark, sf):
    return records.runs(V.leads(spark, sf), V.logs(spark, sf)).drop("log_id")


@query
def q7_detail(spark, sf):
    return records.detail(V.leads(spark, sf), V.logs(spark, sf), V.usage(spark, sf))


@query
def q8_report(spark, sf):
    return records.report(V.leads(spark, sf))


@query
def q8_usage_report(spark, sf):
    long_ids = V.usage(spark, sf).withColumn(
        "request_id", F.lpad(F.col("request_id").cast("string"), 36, "0")
    )
    return records.usage_report(long_ids)


@query
def q8_log_report(spark, sf):
    return records.log_report(V.step_events(spark, sf))


# -- audit and usage ----------------------------------------------------------


@query
def a1_logs_for(spark, sf):
    keys = V.table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"))
    return audit.logs_for(V.logs(spark, sf), keys)


@query
def a2_lead_status(spark, sf):
    return audit.lead_status(V.leads(spark, sf), V.logs(spark, sf))


@query
def a3_step_spans(spark, sf):
    return audit.step_spans(V.step_events(spark, sf)).withColumn("seconds", F.round("seconds", 3))


@query
def a3_step_runs(spark, sf):
    return audit.step_runs(V.step_events(spark, sf)).withColumn("seconds", F.round("seconds", 3))


@query
def a4_latest_step(spark, sf):
    return audit.latest_step(V.step_events(spark, sf))


@query
def t1_usage_for(spark, sf):
    keys = V.table(spark, sf, "labels").select(F.col("doc_id").alias("request_id"))
    return audit.usage_for(V.usage(spark, sf), keys)


@query
def t2_token_summary(spark, sf):
    return audit.usage_summary(V.usage(spark, sf))


@query
def t2_from_daily_partials(spark, sf):
    """The same totals, merged from what each day has left."""
    tokens = V.usage(spark, sf).withColumn("day", F.to_date("created_at"))
    return audit.usage_total(audit.usage_partials(tokens, "day"))


@query
def t3_recent_usage(spark, sf):
    return audit.recent_usage(V.usage(spark, sf))


@query
def t4_usage_from_responses(spark, sf):
    gate = audit.usage_rows(
        V.verdicts(spark, sf).withColumn("created_at", now()), "offline-model", S.STEP_NAMES[2]
    )
    fill = audit.usage_rows(
        V.responses(spark, sf).withColumn("created_at", now()), "offline-model", S.STEP_NAMES[3]
    )
    # the ids are hashes of the row
    return gate.unionByName(fill).drop("id")


# -- keyed updates ------------------------------------------------------------


@query
def u1_update_leads(spark, sf):
    updates = V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 2 AS request_id",
        "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'processing' END AS status",
        "CASE WHEN l_returnflag = 'A' THEN concat('part ', l_partkey) END AS enriched_data",
        "l_shipdate AS changed_at", "l_partkey AS part", "l_linenumber AS line",
    )
    return records.update_leads(
        V.leads(spark, sf), updates, order=["changed_at", "part", "line"], now=now()
    ).select("request_id", "status", "enriched_data", "created_at", "updated_at")


@query
def u2_cascade_delete(spark, sf):
    ids = V.table(spark, sf, "labels").select(F.col("doc_id").alias("request_id"))
    kept = records.cascade_delete(
        V.leads(spark, sf),
        {
            "logs": (V.logs(spark, sf), "request_id", "request_id"),
            "usage": (V.usage(spark, sf), "request_id", "request_id"),
            "embeddings": (V.embeddings(spark, sf), "lead_id", "id"),
        },
        ids,
    )
    out = None
    for name, df in kept.items():
        key = "lead_id" if name == "embeddings" else "request_id"
        part = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
        part = tagged(name, part, "table_name")
        out = part if out is None else out.unionByName(part)
    return out


@query
def c1_sorted_listing(spark, sf):
    rows, total = keyed.list_sorted(V.config(spark, sf), "setting_key")
    return rows.select("id", "setting_key", "setting_value").unionByName(
        total.select(F.col("total").alias("id"), F.lit("(total)").alias("setting_key"),
                     F.lit(None).cast("string").alias("setting_value"))
    )


@query
def c2_upsert(spark, sf):
    return keyed.upsert(
        V.config(spark, sf), V.config_changes(spark, sf), ["setting_key"],
        order=["changed_at", "seq"],
    )


@query
def c2_upsert_in_folders(spark, sf):
    """The same upsert on a table in hash folders."""
    path = scratch_dir(spark, "c2")
    table = folders.FolderTable.create(V.config(spark, sf), path, ["setting_key"], folders=16)
    table.upsert(V.config_changes(spark, sf), ["changed_at", "seq"])
    return table.read()


@query
def c3_update_existing(spark, sf):
    table, lost = keyed.update_existing(
        V.config(spark, sf), V.config_changes(spark, sf), ["setting_key"],
        order=["changed_at", "seq"],
    )
    return tagged("table", table.select("setting_key", "setting_value")).unionByName(
        tagged("not found", lost.withColumn("setting_value", F.lit(None).cast("string")))
    )


@query
def c4_delete_keys(spark, sf):
    table, lost = keyed.delete_keys(
        V.config(spark, sf), V.config_changes(spark, sf), ["setting_key"]
    )
    return tagged("table", table.select("setting_key", "setting_value")).unionByName(
        tagged("not found", lost.withColumn("setting_value", F.lit(None).cast("string")))
    )


# -- streaming ----------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream; its timestamps become instants."""
    schema = V.table(spark, sf, name).schema
    # a pattern: the stream source refuses the bare path of a single file
    raw = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")
    return raw.withColumns(
        {
            f.name: F.col(f.name).cast("timestamp")
            for f in schema.fields
            if f.dataType.simpleString() == "timestamp_ntz"
        }
    )


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            f.name: F.col(f.name).cast("timestamp_ntz")
            for f in df.schema.fields
            if f.dataType.simpleString() == "timestamp"
        }
    )


def _finish(handle) -> None:
    handle.awaitTermination()


def _request_stream(spark, sf) -> DataFrame:
    return _stream(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id",
        """CASE o_orderkey % 6 WHEN 1 THEN '{"company_name": ""}' WHEN 2 THEN 'none'
           ELSE concat('{"company_name": "Company ', o_custkey, '"}') END AS raw_input""",
        "o_orderdate AS created_at",
    )


@query
def r1s_stream_intake(spark, sf):
    out = scratch_dir(spark, "r1s")
    _finish(stream_requests.stream_requests(
        _request_stream(spark, sf), out, f"{out}-state", available_now=True
    ))
    valid = spark.read.parquet(f"{out}/valid").select(
        "request_id", "company_name", "created_at", F.lit("").alias("errors")
    )
    rejected = spark.read.parquet(f"{out}/rejected").select(
        "request_id", "company_name", "created_at", joined("errors").alias("errors")
    )
    return _ntz(valid.unionByName(rejected))


@query
def r2s_stream_dedup(spark, sf):
    """Each event is delivered twice; one stays."""
    out = scratch_dir(spark, "r2s")
    events = _stream(spark, sf, "events").selectExpr(
        "event_id AS request_id", "ts AS created_at", "event_type",
        "explode(array(1, 2)) AS delivery",
    )
    once = stream_requests.dedup_stream(events, "1 hour")
    _finish(stream_requests.start_batches(
        once.drop("delivery"),
        lambda df, i: stream_requests.write_batch(df, out, i),
        f"{out}-state", available_now=True,
    ))
    return _ntz(spark.read.parquet(out).drop("batch_id"))


def _enriched(spark, sf, requests: DataFrame) -> str:
    """Where a stream of requests has left its outputs; each waits for all its payloads."""
    out = scratch_dir(spark, "r3s")
    roles = V.payloads(spark, sf)
    readers = {role: (lambda role=role: V.payloads(spark, sf)[role]) for role in roles}
    enricher = stream_requests.Enricher(
        readers, out, lambda: V.verdicts(spark, sf), lambda: V.responses(spark, sf),
        lambda: V.embeddings(spark, sf).select("lead_id", "embedding"),
        expected=list(roles), patience="30 days", dim=64,
    )
    _finish(stream_requests.start_batches(
        requests, enricher.batch, f"{out}-state", available_now=True
    ))
    enricher.drain(spark)
    return out


@query
def r3s_stream_enrich(spark, sf):
    out = _enriched(spark, sf, _request_stream(spark, sf))
    return stream_requests.read_current(spark, out).select(
        "request_id", "status", "enriched_data.company_name", "enriched_data.industry",
        joined("enriched_data.api_sources").alias("api_sources"),
        F.col("enriched_data.had_fallback").alias("had_fallback"),
    )


def _streamed(spark, sf) -> dict[str, DataFrame]:
    """The tables that streaming all requests has written, as the batch queries read them."""
    out = _enriched(spark, sf, V.requests(spark, sf, _stream(spark, sf, "orders")))
    return {
        kind: stream_requests.read_current(spark, out, kind=kind)
        for kind in ("leads", "logs", "usage", "embeddings")
    }


@query
def r3s_runs_of_stream(spark, sf):
    """Q6 on what the stream wrote; times of writing differ between runs."""
    tables = _streamed(spark, sf)
    return records.runs(tables["leads"], tables["logs"], 50).select(
        "request_id", "company_name", "lead_status", "step_count", "step_name", "log_status",
        F.col("log_id").isNotNull().alias("has_id"),
    )


@query
def r3s_detail_of_stream(spark, sf):
    """Q7 on what the stream wrote, with the number of rows that bear each id."""
    tables = _streamed(spark, sf)
    rows = records.detail(tables["leads"], tables["logs"], tables["usage"], ordered=False)
    return with_bearers(rows).select("request_id", "kind", "name", "status", "total_tokens", "bearers")


def with_bearers(rows: DataFrame) -> DataFrame:
    """Rows of Q7 with the number of those that bear the id of each; leads have no id of their own.

    Counted where the rows of an id lie together: what the rows are made of runs and moves once.
    """
    borne = F.coalesce((F.col("kind") != "lead") & F.col("id").isNotNull(), F.lit(False))
    counted = rows.where(borne).withColumn("bearers", F.count("*").over(Window.partitionBy("id", "kind")))
    return counted.unionByName(rows.where(~borne).withColumn("bearers", F.lit(None).cast("bigint")))


@query
def r3s_usage_of_stream(spark, sf):
    """T2 on what the stream wrote."""
    return audit.usage_summary(_streamed(spark, sf)["usage"])


@query
def r3s_nearest_of_stream(spark, sf):
    """X1 on what the stream wrote."""
    asked = V.embeddings(spark, sf).filter("id = 0").select("embedding").first()["embedding"]
    return search.search(_streamed(spark, sf)["embeddings"], asked, 10).select(
        "lead_id", "content_summary", "similarity"
    )


def _step_stream(spark, sf) -> DataFrame:
    return V.step_events_of(_stream(spark, sf, "events"))


@query
def r4s_stream_status(spark, sf):
    out = scratch_dir(spark, "r4s")
    _finish(stream_status.stream_status(
        _step_stream(spark, sf), out, f"{out}-state", available_now=True
    ))
    return _ntz(stream_status.current_status(spark, out))


@query
def r5s_stream_monitor(spark, sf):
    out = scratch_dir(spark, "r5s")
    _finish(stream_status.stream_monitor(
        _step_stream(spark, sf), out, f"{out}-state", available_now=True
    ))
    return _ntz(spark.read.parquet(f"{out}/messages").drop("batch_id"))


@query
def r6s_stream_status_counts(spark, sf):
    out = scratch_dir(spark, "r6s")
    leads = _stream(spark, sf, "orders").selectExpr(f"{V.LEAD_STATUS} AS status")
    _finish(stream_status.stream_status_counts(leads, out, f"{out}-state", available_now=True))
    return stream_status.newest_batch(spark.read.parquet(out))


@query
def r6s_stream_usage_totals(spark, sf):
    out = scratch_dir(spark, "r6t")
    tokens = V.usage_of(_stream(spark, sf, "conversations"))
    _finish(stream_status.stream_usage_totals(tokens, out, f"{out}-state", available_now=True))
    return stream_status.usage_totals(spark, out)
