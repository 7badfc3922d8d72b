"""V1-V6: record validation and integrity checks.

Every rule is a column expression yielding an error code or NULL; the codes of a
row are gathered in one ``errors`` array, and a row is valid when it is empty.
Each ``validate_*`` function returns ``(valid, rejected)`` over the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from firmweave import schemas as S
from firmweave.functions import variants as V
from firmweave.functions.once import with_once
from firmweave.functions.truth import present


def gather_errors(*codes: Column) -> Column:
    return present(*codes)


def split_on_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        df.filter(F.size("errors") == 0).drop("errors"),
        df.filter(F.size("errors") > 0),
    )


# -- V1 ---------------------------------------------------------------------


_REQUEST_MEMBERS = (
    "struct<company_name: variant, company_domain: variant, additional_context: variant>"
)


def check_requests(df: DataFrame, raw: str = "raw_input") -> DataFrame:
    """V1: add company_name, company_domain, context and ``errors``.

    The name must be text of 1 to 256 characters (blanks count, nothing is
    trimmed), the domain text of at most 512, the context an object.
    """
    held = F.col("_held")
    name, domain, context = F.col("_name"), F.col("_domain"), F.col("_context")
    name_text, domain_text = V.raw_text(held["company_name"]), V.raw_text(held["company_domain"])
    context_value = held["additional_context"]
    members = V.members(V.parse(F.col(raw)), _REQUEST_MEMBERS)
    parsed = with_once(df, _held=members).withColumns(
        {
            "_name": V.kind(held["company_name"]),
            "_domain": V.kind(held["company_domain"]),
            "_context": V.kind(context_value),
        }
    )
    # a text that does not parse has no members either
    errors = F.when(held.isNull(), F.array(F.lit("raw_input:not_an_object"))).otherwise(
        gather_errors(
            F.when(name.isNull(), "company_name:missing")
            .when(name != V.TEXT, "company_name:not_text")
            .when(F.length(name_text) < 1, "company_name:too_short")
            .when(F.length(name_text) > S.NAME_MAX, "company_name:too_long"),
            F.when(~domain.isin(V.NULL, V.TEXT), "company_domain:not_text").when(
                F.length(domain_text) > S.DOMAIN_MAX, "company_domain:too_long"
            ),
            F.when(~context.isin(V.NULL, V.OBJECT), "additional_context:not_an_object"),
        )
    )
    return parsed.withColumns(
        {
            "company_name": F.when(name == V.TEXT, name_text),
            "company_domain": F.when(domain == V.TEXT, domain_text),
            "additional_context": F.when(context == V.OBJECT, context_value),
            "errors": errors,
        }
    ).drop("_held", "_name", "_domain", "_context")


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_on_errors(check_requests(df))


# -- V2 ---------------------------------------------------------------------


def _extraction_field(value: Column, field: str, ddl: str) -> Column:
    """The field's typed value, NULL unless it obeys the field's rule."""
    if ddl == "string":
        return F.when(V.kind(value) == V.TEXT, V.raw_text(value))
    if ddl == "bigint":
        value = V.as_whole_number(value)
        return F.when(value >= 0, value) if field == "employee_count" else value
    if ddl == "double":
        value = V.as_number(value)
        return F.when(value.between(0.0, 1.0), value)
    return F.when(V.all_text(value), F.try_variant_get(value, "$", ddl))


_EXTRACTION_MEMBERS = S.struct_ddl({f: "variant" for f in S.EXTRACTION_TYPES})

REQUIRED = ("company_name", "confidence_score", "sources_used")


def check_extractions(df: DataFrame, content: str = "content") -> DataFrame:
    """V2: add ``extraction`` (a 14-field struct) and ``errors``.

    Whole-number text, flags and whole doubles pass for integers; text fields
    take text only; lists take text elements only; unknown keys are ignored.
    One violation rejects the whole response, whose struct is then NULL.
    """
    held = F.col("_held")
    fields = F.struct(
        *[_extraction_field(held[f], f, ddl).alias(f) for f, ddl in S.EXTRACTION_TYPES.items()]
    )
    members = V.members(V.parse(F.col(content)), _EXTRACTION_MEMBERS)
    typed = with_once(with_once(df, _held=members), _typed=fields)
    codes = []
    for field in S.EXTRACTION_TYPES:
        wrong = F.col(f"_typed.{field}").isNull()
        given = held[field]
        if field in REQUIRED:
            codes.append(
                F.when(given.isNull(), f"{field}:missing").when(wrong, f"{field}:invalid")
            )
        else:
            codes.append(
                F.when(wrong & V.raw_text(given).isNotNull(), f"{field}:invalid")
            )
    errors = F.when(held.isNull(), F.array(F.lit("content:not_an_object"))).otherwise(
        gather_errors(*codes)
    )
    return (
        with_once(typed, errors=errors)
        .withColumn("extraction", F.when(F.size("errors") == 0, F.col("_typed")))
        .drop("_held", "_typed")
    )


def validate_extractions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid, rejected = split_on_errors(check_extractions(df))
    return valid, rejected.drop("extraction")


# -- V3 ---------------------------------------------------------------------


def gap_list(value: Column) -> Column:
    """V3: a non-empty list of text as ARRAY<STRING>, anything else NULL."""
    names = F.try_variant_get(value, "$", "array<string>")
    return F.when(V.all_text(value) & (F.size(names) > 0), names)


# -- V4 ---------------------------------------------------------------------


def validate_changes(
    df: DataFrame, key: str = "setting_key", value: str = "setting_value"
) -> tuple[DataFrame, DataFrame]:
    """V4: key of 1 to 128 characters, value present and at most 512."""
    k, v = F.col(key), F.col(value)
    errors = gather_errors(
        F.when(k.isNull(), "key:missing")
        .when(F.length(k) < 1, "key:too_short")
        .when(F.length(k) > S.CONFIG_KEY_MAX, "key:too_long"),
        F.when(v.isNull(), "value:missing").when(
            F.length(v) > S.CONFIG_VALUE_MAX, "value:too_long"
        ),
    )
    return split_on_errors(df.withColumn("errors", errors))


def validate_queries(
    df: DataFrame, text: str = "query", limit: str = "limit"
) -> tuple[DataFrame, DataFrame]:
    """V4: query text of 1 to 1000 characters, limit 1 to 50 (NULL means 10)."""
    q, n = F.col(text), F.coalesce(F.col(limit), F.lit(10))
    errors = gather_errors(
        F.when(q.isNull(), "query:missing")
        .when(F.length(q) < 1, "query:too_short")
        .when(F.length(q) > S.QUERY_TEXT_MAX, "query:too_long"),
        F.when(n < 1, "limit:too_small").when(n > S.SEARCH_LIMIT_MAX, "limit:too_large"),
    )
    return split_on_errors(df.withColumns({limit: n, "errors": errors}))


# -- V5, V6 -----------------------------------------------------------------


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """V5: keys held by more than one row.  Counts combine before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """V5: child rows whose key no parent holds.

    Only the distinct child keys meet the parent, so a hot key costs one row
    there; the rows themselves are picked by the (normally few) orphan keys.
    A NULL key refers to nothing and is not an orphan.
    """
    known = parent.select(F.col(parent_key).alias(child_key))
    lost = (
        child.select(child_key)
        .filter(F.col(child_key).isNotNull())
        .distinct()
        .join(known, child_key, "left_anti")
    )
    return child.join(lost, child_key, "left_semi")


def illegal_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """V6: rows whose value is outside the legal set (NULL is outside too)."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


# -- scalar arguments --------------------------------------------------------


def check_page(skip: int, limit: int) -> None:
    if skip < 0:
        raise ValueError("skip must be 0 or more")
    if not 1 <= limit <= S.LIST_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {S.LIST_LIMIT_MAX}")
