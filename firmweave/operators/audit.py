"""Step-log and token-usage analytics.

Groups are always folded by aggregates that combine on the map side (or kept as
sorted rows), so one busy request cannot fill a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from firmweave import schemas as S
from firmweave.functions.blocks import ahead, dealt, join_ahead, running_sum, within
from firmweave.operators.records import lookup_many
from firmweave.session import materialize
from firmweave.sources.sinks import usage_ledger_rows

#: statuses that end a step
ENDS = ("success", "failed", "skipped")


def logs_for(logs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A1: logs of the asked requests, oldest first, each with the request's total.

    A request without logs has no rows (not found).  Totals are counted map-side,
    written, and joined by their measured size: broadcast while small, else by a
    sort-merge join whose hot requests AQE splits.  The final sort is by range over
    (request, time, id), which spreads a hot request too.
    """
    wanted = logs if ids is None else lookup_many(logs, ids, "request_id")
    totals = materialize(wanted.groupBy("request_id").agg(F.count("*").alias("total")), "totals")
    return wanted.join(totals, "request_id").orderBy("request_id", *log_order(logs))


def log_order(logs: DataFrame) -> list[str]:
    """Columns that order the logs of a request: several may share a time of writing."""
    return [c for c in ("timestamp", "seq", "id") if c in logs.columns]


def lead_status(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """A2: the status each request has according to its last log row."""
    last = logs.groupBy("request_id").agg(
        F.max_by(F.struct("step_name", "status"), F.struct(*log_order(logs))).alias("_last")
    )
    step, status = F.col("_last.step_name"), F.col("_last.status")
    return requests.select("request_id").join(last, "request_id", "left").select(
        "request_id",
        F.when(F.col("_last").isNull(), "pending")
        .when(status == "failed", "failed")
        .when((step == S.STEP_NAMES[-1]) & (status == "success"), "completed")
        .otherwise("processing")
        .alias("status"),
    )


def step_spans(logs: DataFrame) -> DataFrame:
    """A3: start, end, final status and seconds of each (request, step).

    A skipped step has no start, a running one no end.  Log times are taken at
    the start of the writing transaction, so durations are lower bounds.
    """
    return _spans(logs, ["request_id", "step_name"], log_order(logs))


def _spans(logs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    ts = F.col("timestamp")
    spans = logs.groupBy(*keys).agg(
        F.min(F.when(F.col("status") == "started", ts)).alias("started_at"),
        F.max(F.when(F.col("status").isin(*ENDS), ts)).alias("ended_at"),
        F.max_by("status", F.struct(*order)).alias("status"),
    )
    seconds = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    return spans.withColumn("seconds", seconds / 1_000_000)


def step_runs(logs: DataFrame) -> DataFrame:
    """A3 by runs: a span for each time a step was run, so that each start has its own end.

    A span opens at a ``started`` row and at the first row after a span has ended; it ends
    with success, failed or skipped.  One that started again without an end stays
    without one.  Spans are numbered by a running count that splits a hot step over
    tasks (``functions.blocks``), then folded on the map side.
    """
    keys, order = ["request_id", "step_name"], log_order(logs)
    rows = materialize(dealt(logs.select(*keys, "status", *order), keys, order), "steps")
    rows = join_ahead(rows, ahead(rows, keys, max_row=F.max(F.struct(*order, "status"))), keys)
    before = F.coalesce(
        F.lag(F.struct("status")).over(within(keys, order)),
        F.when(F.col("max_row").isNotNull(), F.struct(F.col("max_row.status").alias("status"))),
    )
    rows = rows.withColumn("_before", before).drop("max_row")
    opens = (
        (F.col("status") == "started") | F.col("_before").isNull() | F.col("_before.status").isin(*ENDS)
    )
    rows = rows.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("long"))
    rows = running_sum(rows, keys, order, "_ahead", F.col("_opens"))
    numbered = rows.withColumn("run", F.col("_ahead") + F.col("_opens"))
    return _spans(numbered, [*keys, "run"], order)


def latest_step(logs: DataFrame) -> DataFrame:
    """A4: the newest step message of each request."""
    newest = F.max_by(
        F.struct("step_name", "status", "timestamp"), F.struct(*log_order(logs))
    )
    return logs.groupBy("request_id").agg(newest.alias("_m")).select(
        "request_id", F.col("_m.step_name").alias("step"), "_m.status", "_m.timestamp"
    )


def usage_for(tokens: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Usage rows of the asked requests, oldest first."""
    wanted = tokens if ids is None else lookup_many(tokens, ids, "request_id")
    return wanted.orderBy("request_id", "created_at", "id")


def usage_summary(tokens: DataFrame) -> DataFrame:
    """Token sums (0 for none) and the exact number of requests."""
    def total(column: str):
        return F.coalesce(F.sum(F.col(column).cast("bigint")), F.lit(0))

    return tokens.agg(
        total("input_tokens").alias("total_input_tokens"),
        total("output_tokens").alias("total_output_tokens"),
        total("total_tokens").alias("total_tokens"),
        F.count_distinct("request_id").alias("total_requests"),
    )


TOKENS = ("input_tokens", "output_tokens", "total_tokens")


def usage_partials(tokens: DataFrame, *by: str) -> DataFrame:
    """T2 in parts that merge exactly: token sums and a bitmap of the requests' numbers.

    A row per ``by`` (say, the day) and 32,768 consecutive numbers.  ``request_id`` must be
    a dense number: each row holds a bitmap of 4 KB.  Rows without an id count in the sums.
    """
    number = F.col("request_id").cast("bigint")
    return tokens.groupBy(*by, F.bitmap_bucket_number(number).alias("bucket")).agg(
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in TOKENS],
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("requests"),
    )


def usage_total(partials: DataFrame) -> DataFrame:
    """``usage_summary`` of all rows that the partials stand for."""
    merged = partials.groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in TOKENS], F.bitmap_or_agg("requests").alias("requests")
    )
    return merged.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c if c.startswith("total") else f"total_{c}")
            for c in TOKENS
        ],
        F.coalesce(F.sum(F.bitmap_count("requests")), F.lit(0)).alias("total_requests"),
    )


def recent_usage(tokens: DataFrame, n: int = 100) -> DataFrame:
    """The newest usage rows."""
    return tokens.orderBy(F.col("created_at").desc(), "request_id", "id").limit(n)


def usage_rows(responses: DataFrame, model_name: str, step_name: str) -> DataFrame:
    """T4: a ledger row per response that reports usage, readable or not."""
    reported = responses.filter(
        F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    )
    return usage_ledger_rows(
        reported.withColumns({"model_name": F.lit(model_name), "step_name": F.lit(step_name)})
    )
