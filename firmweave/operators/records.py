"""Lead queries and keyed updates.

Creation times tie often, so every ordering ends in the request id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from firmweave import schemas as S
from firmweave.functions import display as D
from firmweave.operators.keyed import latest_per_key
from firmweave.operators.validation import check_page
from firmweave.session import materialize


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("request_id").asc()]


def company_of(df: DataFrame) -> Column:
    """The company's name: a column of its own, or the one in the raw request."""
    if "company_name" in df.columns:
        return F.col("company_name")
    return F.get_json_object("raw_input", "$.company_name")


def _with_status(df: DataFrame, status: str | None) -> DataFrame:
    return df.filter(F.col("status") == status) if status else df


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Q1: the rows of one key; the equality reaches the scan."""
    return df.filter(F.col(key) == value)


def lookup_many(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Q1 for a table of keys.

    A semi join without a hint: Spark broadcasts the keys when their measured
    size allows and shuffles both sides otherwise.
    """
    return df.join(keys.select(key).distinct(), key, "left_semi")


def page(df: DataFrame, skip: int = 0, limit: int = 50, status: str | None = None) -> DataFrame:
    """Q2: one page, newest first; an empty status means no filter."""
    check_page(skip, limit)
    return _with_status(df, status).orderBy(*_newest_first()).offset(skip).limit(limit)


def page_info(df: DataFrame, status: str | None = None, per_page: int = S.PER_PAGE) -> DataFrame:
    """Q3: total under the same filter, and the number of pages (at least one)."""
    return _with_status(df, status).agg(F.count("*").alias("total")).withColumn(
        "total_pages",
        F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint"),
    )


def page_skip(page_number: int, per_page: int = S.PER_PAGE) -> int:
    """Q3: rows before a page, pages counted from 1."""
    if page_number < 1:
        raise ValueError("page must be 1 or more")
    return (page_number - 1) * per_page


def status_counts(df: DataFrame) -> DataFrame:
    """Q4: all rows and the count of each known status, in one pass."""
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in S.LEAD_STATUSES],
    )


def recent(df: DataFrame, n: int = 10) -> DataFrame:
    """Q5: the newest leads with company, status and creation time."""
    return df.orderBy(*_newest_first()).limit(n).select(
        "request_id",
        F.coalesce(company_of(df), F.lit(S.UNKNOWN_COMPANY_TEXT)).alias("company"),
        "status",
        "created_at",
    )


def runs(leads: DataFrame, logs: DataFrame, n: int = 50) -> DataFrame:
    """Q6: the newest ``n`` started leads, each with its logs in order.

    Long form: one row per log (one row with NULL log columns for a lead
    without any), carrying ``step_count``, the number of log rows.  The at most
    ``n`` leads are picked first, and one semi join keeps their logs; only these
    are counted and meet the leads.  The picked leads are the small side of each
    join that reads all logs, so Spark broadcasts them.
    """
    picked = (
        leads.filter(F.col("status").isin("processing", "completed", "failed"))
        .orderBy(*_newest_first())
        .limit(n)
        .select(
            "request_id", company_of(leads).alias("company_name"),
            F.col("status").alias("lead_status"), "created_at",
        )
    )
    return _with_logs(picked, logs).orderBy(
        F.col("created_at").desc(), "request_id", "timestamp", "log_id"
    )


def _with_logs(picked: DataFrame, logs: DataFrame) -> DataFrame:
    kept = logs.join(picked.select("request_id"), "request_id", "left_semi")
    counts = kept.groupBy("request_id").agg(F.count("*").alias("step_count"))
    entries = kept.select(
        "request_id",
        F.col("id").alias("log_id"),
        "step_name",
        F.col("status").alias("log_status"),
        "payload",
        "timestamp",
    )
    return (
        picked.join(counts, "request_id", "left")
        .withColumn("step_count", F.coalesce("step_count", F.lit(0)))
        .join(entries, "request_id", "left")
    )


def detail(
    leads: DataFrame, logs: DataFrame, tokens: DataFrame, ids: DataFrame | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Q7: everything known of the asked leads, in long form.

    Each lead gives one ``lead`` row, its logs one ``log`` row each and its
    usage one ``usage`` row each, sorted by lead, kind and time.  Children of
    unknown leads do not appear.  A union instead of a join of the children: no
    row multiplies and no child list is gathered.  Not ``ordered``, the rows come in no
    order, for uses that would only sort them again.
    """
    if ids is not None:
        leads = lookup_many(leads, ids, "request_id")
    keys = leads.select("request_id")
    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    head = leads.select(
        "request_id", F.lit("lead").alias("kind"), F.col("created_at").alias("at"),
        none_int.alias("id"), company_of(leads).alias("name"), "status",
        none_int.alias("total_tokens"),
    )
    steps = logs.join(keys, "request_id", "left_semi").select(
        "request_id", F.lit("log").alias("kind"), F.col("timestamp").alias("at"),
        F.col("id").cast("bigint").alias("id"), F.col("step_name").alias("name"), "status",
        none_int.alias("total_tokens"),
    )
    usage = tokens.join(keys, "request_id", "left_semi").select(
        "request_id", F.lit("usage").alias("kind"), F.col("created_at").alias("at"),
        F.col("id").cast("bigint").alias("id"), F.col("step_name").alias("name"),
        none_text.alias("status"), F.col("total_tokens").cast("bigint").alias("total_tokens"),
    )
    rows = head.unionByName(steps).unionByName(usage)
    if not ordered:
        return rows
    kind_rank = F.when(F.col("kind") == "lead", 0).when(F.col("kind") == "log", 1).otherwise(2)
    return rows.orderBy("request_id", kind_rank, "at", "id")


def report(df: DataFrame) -> DataFrame:
    """Q8: leads as shown in a list."""
    return df.select(
        F.coalesce(company_of(df), F.lit(S.UNKNOWN_COMPANY_TEXT)).alias("company"),
        F.col("request_id").cast("string").alias("request_id"),
        D.short_id(F.col("request_id")).alias("shown_id"),
        "status",
        D.status_group(F.col("status")).alias("status_group"),
        D.shown_time(F.col("created_at"), D.LIST_TIME).alias("created"),
        D.shown_time(F.col("created_at"), D.SHORT_TIME).alias("created_short"),
    )


def usage_report(tokens: DataFrame) -> DataFrame:
    """Q8: token rows as shown in a list."""
    return tokens.select(
        D.short_id(F.col("request_id")).alias("shown_id"),
        "step_name",
        "model_name",
        *[
            D.with_thousands(F.col(c)).alias(c)
            for c in ("input_tokens", "output_tokens", "total_tokens")
        ],
        D.shown_time(F.col("created_at"), D.USAGE_TIME).alias("time"),
    )


def log_report(logs: DataFrame) -> DataFrame:
    """Q8: log rows as shown in a run's list of steps."""
    return logs.select(
        "request_id",
        "step_name",
        "status",
        D.status_group(F.col("status")).alias("status_group"),
        D.shown_time(F.col("timestamp"), D.CLOCK_TIME).alias("time"),
    )


# -- U1, U2 -----------------------------------------------------------------


def update_leads(
    leads: DataFrame,
    updates: DataFrame,
    order: Sequence[str] | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Set status, and enriched_data where the update carries one.

    Unknown request ids are ignored, untouched leads stay as they are, and
    ``updated_at`` moves for touched ones only.  ``order`` names the columns
    deciding which of several updates of a request is last.
    """
    now = F.current_timestamp() if now is None else now
    if order:
        updates = latest_per_key(updates, ["request_id"], order)
    new = updates.select(
        "request_id",
        F.col("status").alias("_status"),
        F.col("enriched_data").alias("_enriched"),
        F.lit(True).alias("_touched"),
    )
    changed = {
        "status": F.coalesce("_status", "status"),
        "enriched_data": F.coalesce("_enriched", "enriched_data"),
        "updated_at": F.when(F.col("_touched"), now).otherwise(F.col("updated_at")),
    }
    return leads.join(new, "request_id", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in leads.columns]
    )


def cascade_delete(
    leads: DataFrame, children: dict[str, tuple[DataFrame, str, str]], ids: DataFrame
) -> dict[str, DataFrame]:
    """Remove leads by request_id together with their child rows.

    ``children`` maps a table name to (rows, child key, lead key), e.g. the
    embeddings refer by lead_id to leads.id and the others by request_id.  The
    doomed keys are found and written once; each child only meets that table.
    """
    asked = ids.select("request_id").distinct()
    lead_keys = list(dict.fromkeys(key for _, _, key in children.values()))
    doomed = materialize(
        leads.join(asked, "request_id", "left_semi").select(*lead_keys).distinct(), "doomed"
    )
    kept = {"leads": leads.join(asked, "request_id", "left_anti")}
    for name, (rows, child_key, lead_key) in children.items():
        gone = doomed.select(F.col(lead_key).alias(child_key))
        kept[name] = rows.join(gone, child_key, "left_anti")
    return kept
