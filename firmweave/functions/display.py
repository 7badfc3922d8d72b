"""Display projections: status groups, times, counts and shortened ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The report formats.
SHORT_TIME = "MMM dd, HH:mm"
LIST_TIME = "yyyy-MM-dd HH:mm"
CLOCK_TIME = "HH:mm:ss"
USAGE_TIME = "MM-dd HH:mm"
SHORT_ID_CHARS = 12
SHORT_ID_SLACK = 5
ELLIPSIS = "…"


def status_group(status: Column) -> Column:
    return (
        F.when(status.isin("completed", "success"), "completed")
        .when(status.isin("processing", "started"), "processing")
        .when(status == "failed", "failed")
        .when(status == "skipped", "skipped")
        .otherwise("pending")
    )


def shown_time(ts: Column, pattern: str) -> Column:
    return F.coalesce(F.date_format(ts, pattern), F.lit(""))


def with_thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def short_id(text: Column) -> Column:
    """Cut to 11 characters and an ellipsis; up to 17 characters pass whole."""
    text = text.cast("string")
    return F.when(
        F.length(text) > SHORT_ID_CHARS + SHORT_ID_SLACK,
        F.concat(F.substring(text, 1, SHORT_ID_CHARS - 1), F.lit(ELLIPSIS)),
    ).otherwise(text)


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)
