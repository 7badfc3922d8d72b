"""Normalise the landed payloads of four data providers.

Each provider adds plain columns to a row: its state (``ok``, ``error`` or
``skipped``), its error and its fields.  The payload is parsed once; every
column is then its own small expression, so a query that needs only the states
computes only those.

A key that is absent is harmless, while an explicit null (or any other
non-object) where a nested object is read spoils the whole payload.  Such a
payload gives no values and an error code; it never fails the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from firmweave import schemas as S
from firmweave.functions import variants as V
from firmweave.functions.once import with_once
from firmweave.functions.truth import entries_where

PROVIDER_FIELDS = {
    "profile": [
        "company_name", "company_description", "company_website",
        "linkedin_company_url", "employee_count", "industry", "founding_year",
        "funding_raised",
    ],
    "contact": ["ceo_name", "ceo_email", "linkedin_url"],
    "emails": ["ceo_email"],
    "news": ["news_articles"],
}


# What is read of nearly every payload, in one pass over its document.
_MEMBERS = {
    "profile": "struct<name: string, description: string, url: string, linkedin: struct<handle: string>, "
    "metrics: struct<employees: string, raised: string>, category: struct<industry: string>, "
    "foundedYear: string>",
    "contact": "struct<fullName: string, emailAddresses: array<struct<email: string>>, "
    "socialNetworks: struct<linkedin: string>>",
    "emails": "struct<data: struct<emails: array<struct<type: string, position: variant, value: variant>>>>",
    "news": "struct<articles: array<struct<title: variant, url: variant>>>",
}


def _not_object(doc: Column, path: str, read: Column) -> Column:
    """Present, but not an object; ``read`` holds its members and is NULL if it is none."""
    return read.isNull() & V.at(doc, path).isNotNull()


def _not_iterable(value: Column, items: Column) -> Column:
    """Neither absent, nor a list, nor an empty text or object (which hold no items).

    ``items`` holds the items of a list and is NULL otherwise.
    """
    return items.isNull() & value.isNotNull() & ~(
        V.is_kind(value, V.TEXT, V.OBJECT) & V.is_hollow(value)
    )


def _member(held: Column, path: str) -> Column:
    """The member of the struct ``held`` that a path such as ``$.a.b`` names."""
    for name in path.split(".")[1:]:
        held = held[name]
    return held


# Each reader gives (fault, fields) of a payload known to be an object; ``held`` are its members.


def _profile(doc: Column, held: Column, input_name: Column) -> tuple[Column, dict[str, Column]]:
    fault = (
        F.when(_not_object(doc, "$.linkedin", held["linkedin"]), "linkedin:not_an_object")
        .when(_not_object(doc, "$.metrics", held["metrics"]), "metrics:not_an_object")
        .when(_not_object(doc, "$.category", held["category"]), "category:not_an_object")
    )
    fields = {}
    for field, path in S.PROFILE_PATHS.items():
        text = _member(held, path)
        if field == "company_name":
            absent = text.isNull() & V.at(doc, path).isNull()
            fields[field] = F.when(absent, input_name).otherwise(V.as_text(doc, path, text))
        elif field in S.INT_FIELDS:
            # a falsy value of another type stays falsy: 0 rather than NULL
            fields[field] = F.coalesce(
                V.as_whole_number(doc, path, text),
                F.when(V.is_hollow(doc, path, text), F.lit(0).cast("bigint")),
            )
        else:
            fields[field] = V.as_text(doc, path, text)
    return fault, fields


def _contact(doc: Column, held: Column, input_name: Column) -> tuple[Column, dict[str, Column]]:
    addresses, first = V.at(doc, "$.emailAddresses"), F.get(held["emailAddresses"], F.lit(0))
    any_given = V.raw_text(addresses).isNotNull() & ~V.is_hollow(addresses)
    fault = F.when(
        first.isNull() & any_given, "emailAddresses:first_not_an_object"
    ).when(
        _not_object(doc, "$.socialNetworks", held["socialNetworks"]), "socialNetworks:not_an_object"
    )
    return fault, {
        "ceo_name": V.as_text(doc, "$.fullName", held["fullName"]),
        "ceo_email": V.as_text(doc, "$.emailAddresses[0].email", first["email"]),
        "linkedin_url": V.as_text(
            doc, "$.socialNetworks.linkedin", held["socialNetworks"]["linkedin"]
        ),
    }


def _email_verdict(entry: Column) -> Column:
    """hit, miss or fault of one address entry, NULL if it is no object."""
    position = entry["position"]
    return (
        F.when(entry.isNull(), "fault")
        .when(entry["type"] == "personal", "hit")
        .when(position.isNull(), "miss")
        .when(~V.is_kind(position, V.TEXT), "fault")
        .when(F.lower(V.raw_text(position)).isin(*S.EXECUTIVE_POSITIONS), "hit")
        .otherwise("miss")
    )


def _decisive_entry(held: Column) -> Column:
    """The first address entry that is not a plain miss, with its verdict."""
    judged = F.transform(
        held["data"]["emails"],
        lambda e: F.struct(_email_verdict(e).alias("verdict"), e["value"].alias("value")),
    )
    return F.try_element_at(F.filter(judged, lambda e: e["verdict"] != "miss"), F.lit(1))


def _emails(
    doc: Column, held: Column, input_name: Column
) -> tuple[Column, dict[str, Column]]:
    data, decisive = held["members"]["data"], held["decisive"]
    fault = (
        F.when(_not_object(doc, "$.data", data), "data:not_an_object")
        .when(_not_iterable(V.at(doc, "$.data.emails"), data["emails"]), "emails:not_a_list")
        .when(decisive["verdict"] == "fault", "emails:bad_entry")
    )
    return fault, {"ceo_email": V.as_text(decisive["value"])}


def _news(doc: Column, held: Column, input_name: Column) -> tuple[Column, dict[str, Column]]:
    articles = held["articles"]
    fault = F.when(_not_iterable(V.at(doc, "$.articles"), articles), "articles:not_a_list").when(
        F.exists(articles, lambda a: a.isNull()), "articles:bad_entry"
    )

    def headline(article: Column) -> Column:
        return (
            F.when(article["title"].isNotNull(), V.as_text(article["title"]))
            .when(article["url"].isNotNull(), V.as_text(article["url"]))
            .otherwise(F.lit(""))
        )

    headlines = F.transform(articles, headline)
    return fault, {
        "news_articles": F.coalesce(headlines, F.array().cast("array<string>"))
    }


_READERS = {"profile": _profile, "contact": _contact, "emails": _emails, "news": _news}


def provider_state(provider: str, configured: Column, domain: Column) -> Column:
    """A provider is skipped when not configured, emails also without a domain."""
    idle = ~F.coalesce(configured, F.lit(False))
    if provider == "emails":
        idle = idle | domain.isNull() | (domain == "")
    return F.when(idle, "skipped").otherwise("called")


def result_columns(provider: str) -> list[str]:
    """Names of the columns ``with_provider`` adds, without their prefix."""
    issues = ["issues"] if provider == "profile" else []
    return ["state", "error", *issues, *PROVIDER_FIELDS[provider]]


def with_provider(df: DataFrame, provider: str, prefix: str = "") -> DataFrame:
    """N1-N6 on a row holding ``<prefix>configured``, ``<prefix>body`` and ``<prefix>error``.

    Replaces them by the provider's state, error and fields under the same
    prefix.  The row also carries company_name and company_domain.
    """
    doc, held, body = F.col(f"{prefix}_doc"), F.col(f"{prefix}_held"), F.col(f"{prefix}body")
    decisive = F.col(f"{prefix}_decisive")
    read = F.struct(held.alias("members"), decisive.alias("decisive")) if provider == "emails" else held
    fault, fields = _READERS[provider](doc, read, F.col("company_name"))
    failure = (
        F.when(F.col(f"{prefix}error").isNotNull(), F.col(f"{prefix}error"))
        .when(doc.isNull(), "body:not_json")
        .when(held.isNull(), "body:not_an_object")
        .otherwise(fault)
    )
    state = provider_state(provider, F.col(f"{prefix}configured"), F.col("company_domain"))
    called = F.col(f"{prefix}_called") == "called"
    df = with_once(df.withColumn(f"{prefix}_called", state), **{f"{prefix}_doc": V.parse(F.when(called, body))})
    df = with_once(df, **{f"{prefix}_held": V.members(doc, _MEMBERS[provider])})
    if provider == "emails":
        df = with_once(df, **{f"{prefix}_decisive": _decisive_entry(held)})
    df = with_once(df, **{f"{prefix}_failure": F.when(called, failure)})
    good = called & F.col(f"{prefix}_failure").isNull()
    added = {
        f"{prefix}state": F.when(~called, "skipped")
        .when(F.col(f"{prefix}_failure").isNotNull(), "error")
        .otherwise("ok"),
        f"{prefix}error": F.col(f"{prefix}_failure"),
        **{f"{prefix}{f}": F.when(good, c) for f, c in fields.items()},
    }
    # read again by the issues
    numbers = {c: added.pop(c) for c in [f"{prefix}{f}" for f in S.INT_FIELDS] if c in added}
    df = (with_once(df, **numbers) if numbers else df).withColumns(added)
    if provider == "profile":
        df = df.withColumn(f"{prefix}issues", _profile_issues(held, good, prefix))
    drop = ["_doc", "_held", "_decisive", "_called", "_failure", "configured", "body"]
    # without a prefix, the requested name has made way for the provider's
    return df.drop(*[f"{prefix}{c}" for c in drop])


def _profile_issues(held: Column, good: Column, prefix: str) -> Column:
    """Truthy values that a whole-number field cannot hold, as (field, original).

    A falsy value has become 0, so only a refused one leaves the field NULL.
    """
    entries = []
    for f in S.INT_FIELDS:
        text = _member(held, S.PROFILE_PATHS[f])
        refused = text.isNotNull() & F.col(f"{prefix}{f}").isNull()
        entries.append((good & refused, F.struct(F.lit(f).alias("field"), text.alias("original"))))
    return entries_where(entries, S.ISSUES_DDL)


def normalize(df: DataFrame, provider: str) -> DataFrame:
    """DataFrame form of one provider.

    Expects request_id, company_name, company_domain, configured, body, error;
    returns request_id, state, error (for the profile also issues) and the
    provider's fields.
    """
    return with_provider(df, provider).select("request_id", *result_columns(provider))


def normalize_profile(df: DataFrame) -> DataFrame:
    """Company profile; an absent name falls back to the requested one."""
    return normalize(df, "profile")


def normalize_contact(df: DataFrame) -> DataFrame:
    """Contact person; the e-mail is that of the first address."""
    return normalize(df, "contact")


def normalize_domain_emails(df: DataFrame) -> DataFrame:
    """The first personal or executive address of the domain."""
    return normalize(df, "emails")


def normalize_news(df: DataFrame) -> DataFrame:
    """Headlines; an absent title falls back to the url."""
    return normalize(df, "news")


# -- N7 ---------------------------------------------------------------------


def provider_requests(leads: DataFrame) -> DataFrame:
    """One row per (request, provider) to call, with its parameters.

    Secrets are not part of the parameters.
    """
    name, domain = F.col("company_name"), F.col("company_domain")
    has_domain = domain.isNotNull() & (domain != "")

    def params(**pairs: Column | str) -> Column:
        flat: list[Column] = []
        for key, value in pairs.items():
            flat += [F.lit(key), value if isinstance(value, Column) else F.lit(value)]
        return F.create_map(*flat)

    calls = {
        "profile": F.when(has_domain, params(domain=domain)).otherwise(params(name=name)),
        "contact": F.when(has_domain, params(company=name, domain=domain)).otherwise(
            params(company=name)
        ),
        "emails": F.when(has_domain, params(domain=domain)),
        "news": params(
            q=name, pageSize=str(S.NEWS_PAGE_SIZE), sortBy=S.NEWS_SORT, language=S.NEWS_LANGUAGE
        ),
    }
    rows = F.array(
        *[
            F.struct(F.lit(S.PROVIDER_SOURCES[p]).alias("provider"), m.alias("params"))
            for p, m in calls.items()
        ]
    )
    return (
        leads.select("request_id", F.explode(rows).alias("call"))
        .select("request_id", "call.provider", "call.params")
        .filter(F.col("params").isNotNull())
    )


# -- N8 ---------------------------------------------------------------------


def reduce_attempts(attempts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The outcome of at most three attempts per (request, provider).

    The first success wins, an error that must not be retried stops at once,
    and otherwise the third error stands.  ``row_number() <= 3`` keeps three
    rows per key on the map side already, so a hot key never gathers in one
    task; what follows works on at most three rows per key.
    """
    order = order or ["attempt"]
    w = Window.partitionBy("request_id", "provider").orderBy(*order)
    first = (
        attempts.withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= S.MAX_ATTEMPTS)
    )
    entry = F.struct(
        "_n", "outcome", "retryable", "body", "error",
        ((F.col("outcome") == "success") | ~F.coalesce(F.col("retryable"), F.lit(False))).alias(
            "final"
        ),
    )
    tries = F.array_sort(F.collect_list(entry))
    grouped = first.groupBy("request_id", "provider").agg(tries.alias("tries"))
    decided = F.coalesce(
        F.try_element_at(F.filter("tries", lambda t: t["final"]), F.lit(1)),
        F.element_at("tries", -1),
    )
    last = F.col("last")
    success = last["outcome"] == "success"
    # seconds waited before the winning try: 2^(n-1) clamped, over earlier tries
    waited = F.aggregate(
        F.filter("tries", lambda t: t["_n"] < last["_n"]),
        F.lit(0).cast("bigint"),
        lambda total, t: total
        + F.least(
            F.greatest(F.pow(F.lit(2), t["_n"] - 1), F.lit(S.BACKOFF_MIN_SECONDS)),
            F.lit(S.BACKOFF_MAX_SECONDS),
        ).cast("bigint"),
    )
    return grouped.withColumn("last", decided).select(
        "request_id",
        "provider",
        F.when(success, "success").otherwise("error").alias("outcome"),
        last["_n"].cast("int").alias("attempts_made"),
        F.when(success, last["body"]).alias("body"),
        F.when(~success, last["error"]).alias("error"),
        waited.alias("backoff_seconds"),
    )
