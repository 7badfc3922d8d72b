"""Merge provider results, find gaps, fill them.

The operators work on one wide row per request holding the four provider
results (see ``plans.completion``).  All of them are projections: apart from
joining verdicts and responses by request_id nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from firmweave import schemas as S
from firmweave.functions import variants as V
from firmweave.functions.once import with_once
from firmweave.functions.truth import entries_where, falsy, names_where
from firmweave.operators.keyed import co_locate
from firmweave.operators.providers import (
    PROVIDER_FIELDS,
    provider_state,
    result_columns,
    with_provider,
)
from firmweave.operators.validation import check_extractions, gap_list

PROVIDERS = list(S.PROVIDER_SOURCES)  # lowest priority first


def typed_struct(values: Mapping[str, Column], types: Mapping[str, str]) -> Column:
    return F.struct(*[values[f].cast(t).alias(f) for f, t in types.items()])


# -- M1..M4 -----------------------------------------------------------------


def merged_record(input_name: Column) -> Column:
    """M1: the highest-priority non-null value of each of the twelve fields.

    Reads the prefixed provider columns of the row.  Emptiness does not matter
    here: an empty text of a later provider replaces a good earlier value and
    only then counts as a gap.
    """
    values: dict[str, Column] = {}
    for field in S.FIELD_TYPES:
        offers = [
            F.col(f"{p}_{field}") for p in reversed(PROVIDERS) if field in PROVIDER_FIELDS[p]
        ]
        if field == "company_name":
            offers.append(input_name)
        values[field] = F.coalesce(*offers)
    return typed_struct(values, S.FIELD_TYPES)


def sources_queried() -> Column:
    """M2: providers that were called, in merge order, errors included."""
    return names_where(
        {S.PROVIDER_SOURCES[p]: F.col(f"{p}_state") != "skipped" for p in PROVIDERS}
    )


def source_errors() -> Column:
    """M3: (source, error) of the providers whose error text is not empty."""
    return entries_where(
        [
            (
                F.col(f"{p}_error") != "",
                F.struct(
                    F.lit(S.PROVIDER_SOURCES[p]).alias("source"), F.col(f"{p}_error").alias("error")
                ),
            )
            for p in PROVIDERS
        ],
        "array<struct<source:string,error:string>>",
    )


def fields_populated(record: Column, fields: list[str] | None = None) -> Column:
    """M4: names of the non-null fields, in declared order."""
    return names_where({f: record[f].isNotNull() for f in fields or S.CHECKED_FIELDS})


def merge_results(df: DataFrame) -> DataFrame:
    """M1-M4 on rows holding all four providers' prefixed columns."""
    merged = with_once(df, api=merged_record(F.col("company_name"))).withColumns(
        {
            "api_sources": sources_queried(),
            "api_errors": source_errors(),
            "type_issues": F.coalesce("profile_issues", F.array().cast(S.ISSUES_DDL)),
        }
    ).drop(*[f"{p}_{c}" for p in PROVIDERS for c in result_columns(p)])
    return merged.withColumn("fields_populated", fields_populated(F.col("api")))


def merge_providers(
    requests: DataFrame, profile: DataFrame, contact: DataFrame, emails: DataFrame,
    news: DataFrame,
) -> DataFrame:
    """M1-M4 over normalised provider tables keyed by request_id.

    Requests carry request_id and company_name; a provider without a row for a
    request counts as skipped.  All joins share one key, so each input is
    shuffled once (not at all when bucketed by it).
    """
    wide = requests
    for p, df in zip(PROVIDERS, (profile, contact, emails, news)):
        columns = [F.col(c).alias(f"{p}_{c}") for c in result_columns(p)]
        wide = wide.join(df.select("request_id", *columns), "request_id", "left")
    wide = wide.withColumns(
        {f"{p}_state": F.coalesce(f"{p}_state", F.lit("skipped")) for p in PROVIDERS}
    )
    return merge_results(wide)


def join_payloads(
    requests: DataFrame,
    payloads: Mapping[str, DataFrame],
    located: Callable[[DataFrame], DataFrame] = co_locate,
    columns: tuple[str, ...] = ("configured", "body", "error"),
) -> DataFrame:
    """Each request with every provider's landed row, prefixed and not yet parsed.

    Inputs hold one row per request_id at most.  ``located`` shuffles an input by
    that key (nothing to do for bucketed ones); the joins reuse the layout.
    """
    types = {"configured": "boolean", "body": "string", "error": "string"}
    wide = located(requests)
    for p in PROVIDERS:
        if p in payloads:
            named = [F.col(c).alias(f"{p}_{c}") for c in columns]
            wide = wide.join(located(payloads[p].select("request_id", *named)), "request_id", "left")
        else:
            wide = wide.withColumns({f"{p}_{c}": F.lit(None).cast(types[c]) for c in columns})
    return wide


def merge_payloads(
    requests: DataFrame, payloads: Mapping[str, DataFrame],
    located: Callable[[DataFrame], DataFrame] = co_locate,
) -> DataFrame:
    """M1-M4 from raw payloads: one wide join, then every body is read in place.

    ``requests``: request_id, company_name, company_domain.
    """
    wide = join_payloads(requests, payloads, located)
    for p in PROVIDERS:
        wide = with_provider(wide, p, prefix=f"{p}_")
    return merge_results(wide)


def queried_sources(
    requests: DataFrame, payloads: Mapping[str, DataFrame],
    located: Callable[[DataFrame], DataFrame] = co_locate,
) -> DataFrame:
    """M2 alone: (request_id, api_sources), from settings only; no body is read."""
    wide = join_payloads(requests, payloads, located, ("configured",))
    called = {
        S.PROVIDER_SOURCES[p]: provider_state(p, F.col(f"{p}_configured"), F.col("company_domain"))
        == "called"
        for p in PROVIDERS
    }
    return wide.select("request_id", names_where(called).alias("api_sources"))


# -- G1..G3 -----------------------------------------------------------------


def detected_gaps(record: Column) -> Column:
    """G1: the checked fields whose value is falsy, in list order."""
    return names_where({f: falsy(record[f], kind) for f, kind in S.FIELD_TYPES.items()})


def detect_gaps(df: DataFrame, record: str = "api") -> DataFrame:
    return df.withColumn("gaps", detected_gaps(F.col(record)))


def confirmed_gaps(gaps: Column, content: Column, verdict: Column) -> Column:
    """The gap list that stands after the verdict, NULL when complete.

    ``verdict`` is ``content`` parsed once beforehand.  A verdict may name its
    own list of fields or declare the record complete by an empty one; a
    verdict that cannot be read or holds anything else leaves all gaps standing.
    """
    named = V.at(verdict, "$.missing_fields")
    usable = V.is_object_text(content) & named.isNotNull()
    declared_complete = usable & (V.raw_text(named).isNull() | V.is_hollow(named))
    return (
        F.when(F.size(gaps) == 0, F.lit(None))
        .when(declared_complete, F.lit(None))
        .otherwise(F.coalesce(F.when(usable, gap_list(named)), gaps))
    )


def decide_gaps(df: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Add ``missing_fields`` to rows with ``gaps``.

    ``verdicts`` holds at most one (request_id, content) per request.
    """
    if verdicts is None:
        return df.withColumn("missing_fields", F.when(F.size("gaps") > 0, F.col("gaps")))
    # text is joined; only what some gap asks for is parsed
    found = verdicts.select("request_id", F.col("content").alias("_content"))
    joined = df.join(found, "request_id", "left")
    return (
        with_once(joined, _doc=V.parse(F.when(F.size("gaps") > 0, F.col("_content"))))
        .withColumn(
            "missing_fields", confirmed_gaps(F.col("gaps"), F.col("_content"), F.col("_doc"))
        )
        .drop("_content", "_doc")
    )


def split_by_gaps(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(needs filling, complete).  Materialise ``df`` first if both are written."""
    missing = F.col("missing_fields")
    return df.filter(missing.isNotNull()), df.filter(missing.isNull()).withColumn(
        "skip_reason", F.lit(S.SKIP_REASON_TEXT)
    )


# -- F1 ---------------------------------------------------------------------


def prompts(df: DataFrame, record: str = "api") -> DataFrame:
    """request text for the model, one per row needing a fill.

    Expects company_name, missing_fields and the gathered record; nulls are
    kept in the rendered JSON so the model sees what is unknown.
    """
    known = F.to_json(F.col(record), {"ignoreNullFields": "false", "pretty": "true"})
    gathered = F.when(
        F.size(fields_populated(F.col(record))) > 0,
        F.concat(F.lit("Known so far, from the data providers:\n"), known),
    ).otherwise(F.lit("No data is available from any provider."))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Company to look up: "), F.col("company_name")),
        F.concat(F.lit("Fields still empty: "), F.array_join("missing_fields", ", ")),
        gathered,
        F.lit("Answer with one JSON object in the agreed fourteen-field form."),
    )
    return df.select("request_id", text.alias("prompt"))


# -- F2..F5 -----------------------------------------------------------------


def attach_responses(
    gapped: DataFrame, responses: DataFrame, on_missing: str = "fail"
) -> DataFrame:
    """join one response per request and mark the outcome.

    Adds ``extraction`` and ``fill_error``.  A missing or invalid response
    fails the record (``on_missing='keep'`` lets a missing one pass unfilled).
    """
    # text is joined; only the responses that some gap asked for are checked
    answers = responses.select(
        "request_id", F.col("content").alias("_response"), F.lit(True).alias("_answered")
    )
    joined = gapped.join(answers, "request_id", "left")
    own = {"errors": "_own_errors"} if "errors" in gapped.columns else {}
    checked = check_extractions(joined.withColumnsRenamed(own), "_response").withColumn(
        "_why", F.array_join("errors", "; ")
    )
    checked = checked.drop("errors").withColumnsRenamed({v: k for k, v in own.items()})
    return checked.withColumn("fill_error", fill_error(checked, on_missing)).drop(
        "_why", "_answered", "_response"
    )


def fill_error(df: DataFrame, on_missing: str = "fail") -> Column:
    """Error text of an unanswered or invalid response, NULL when usable."""
    if on_missing not in ("fail", "keep"):
        raise ValueError("on_missing is 'fail' or 'keep'")
    unanswered = F.when(
        df["_answered"].isNull(),
        F.lit("response:missing") if on_missing == "fail" else F.lit(None).cast("string"),
    )
    return F.when(df["_answered"].isNull(), unanswered).when(
        df["extraction"].isNull(), df["_why"]
    )


def fields_filled(extraction: Column) -> Column:
    """non-null response fields other than the name and the two provenance fields."""
    counted = [f for f in S.CHECKED_FIELDS if f != "company_name"]
    return names_where({f: extraction[f].isNotNull() for f in counted})


def filled_record(api: Column, fill: Column, api_sources: Column) -> Column:
    """the final record.

    A truthy provider value stands.  Otherwise a non-null fill value replaces
    it, listed as missing or not; a null fill leaves the falsy value in place.
    ``fill`` is NULL when no fill took place.
    """
    values = {
        f: F.when(~falsy(api[f], kind), api[f]).otherwise(F.coalesce(fill[f], api[f]))
        for f, kind in S.FIELD_TYPES.items()
    }
    values["confidence_score"] = fill["confidence_score"]
    values["sources_used"] = fill["sources_used"]
    values["fallback_confidence_score"] = fill["confidence_score"]
    values["fallback_sources_used"] = fill["sources_used"]
    values["api_sources"] = api_sources
    values["had_fallback"] = fill.isNotNull()
    return typed_struct(values, S.RECORD_TYPES)


def fill_gaps(df: DataFrame) -> DataFrame:
    """F4 + F5 on rows with ``api``, ``extraction`` and ``api_sources``."""
    record = filled_record(F.col("api"), F.col("extraction"), F.col("api_sources"))
    return with_once(df, record=record).withColumns(
        {
            "total_fields": total_fields(F.col("record")),
            "had_fallback": F.col("record.had_fallback"),
        }
    )


def total_fields(record: Column) -> Column:
    """number of non-null public fields of the final record."""
    public = [f for f in S.RECORD_TYPES if f not in ("api_sources", "had_fallback")]
    total = F.lit(0)
    for f in public:
        total = total + record[f].isNotNull().cast("int")
    return total
