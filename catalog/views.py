"""The given tables seen as the engine's inputs.

No company-record data is supplied, so each engine table is a projection of a
whole given table.  The ``CASE`` on a key plants every payload shape the rules
distinguish; nothing is filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firmweave.session import tune


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders_with_customer(
    spark: SparkSession, sf: str, orders: DataFrame | None = None
) -> DataFrame:
    """``orders``, the table's rows or a stream of them, each with its customer."""
    orders = table(spark, sf, "orders") if orders is None else orders
    customer = table(spark, sf, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")


DOMAIN = (
    "CASE WHEN c_custkey % 7 = 0 THEN NULL "
    "ELSE concat(lower(replace(c_name, '#', '-')), '.example.com') END"
)

LEAD_STATUS = (
    "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'failed' "
    "WHEN o_orderstatus = 'F' THEN 'completed' "
    "WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'pending' END"
)


def leads(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_with_customer(spark, sf).selectExpr(
        "o_orderkey AS id",
        "o_orderkey AS request_id",
        "c_name AS company_name",
        f"{DOMAIN} AS company_domain",
        f"{LEAD_STATUS} AS status",
        "CASE WHEN o_orderstatus = 'F' THEN c_mktsegment END AS enriched_data",
        "o_orderdate AS created_at",
        "o_orderdate AS updated_at",
    )


def requests(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    raw = f"""
      CASE o_orderkey % 23
        WHEN 1 THEN '{{"company_domain": "a.example.com"}}'
        WHEN 2 THEN '{{"company_name": null}}'
        WHEN 3 THEN '{{"company_name": ""}}'
        WHEN 4 THEN concat('{{"company_name": ', o_custkey, '}}')
        WHEN 5 THEN concat('{{"company_name": "', repeat('n', 256), '"}}')
        WHEN 6 THEN concat('{{"company_name": "', repeat('n', 257), '"}}')
        WHEN 7 THEN concat('{{"company_name": "', c_name, '", "company_domain": "',
                           repeat('d', 513), '"}}')
        WHEN 8 THEN concat('{{"company_name": "', c_name, '", "additional_context": ["x"]}}')
        WHEN 9 THEN concat('{{"company_name": "', c_name,
                           '", "additional_context": {{"priority": "', o_orderpriority, '"}}}}')
        WHEN 10 THEN concat('request ', o_orderkey)
        WHEN 11 THEN concat('["', c_name, '"]')
        WHEN 12 THEN concat('{{"company_name": "', c_name, '", "company_domain": null}}')
        WHEN 13 THEN '{{"company_name": " "}}'
        WHEN 14 THEN concat('{{"company_name": "', c_name, '", "company_domain": ""}}')
        ELSE concat('{{"company_name": "', c_name, '"', coalesce(concat(
               ', "company_domain": "', {DOMAIN}, '"'), ''), '}}')
      END"""
    return _orders_with_customer(spark, sf, orders).selectExpr(
        "o_orderkey AS request_id", f"{raw} AS raw_input", "o_orderdate AS created_at"
    )


def profile_payloads(spark: SparkSession, sf: str) -> DataFrame:
    name = "\"name\": \"', c_name, ' Inc\""
    description = "\"description\": \"Serves ', c_mktsegment, '\", \"url\": \"https://www.example.com/', c_custkey, '\""
    linkedin = "\"linkedin\": {\"handle\": \"company/', c_custkey, '\"}"
    metrics = "\"metrics\": {\"employees\": ', c_custkey % 50, ', \"raised\": \"$', c_nationkey, 'M\"}"
    category = "\"category\": {\"industry\": \"', c_mktsegment, '\"}"
    founded = "\"foundedYear\": ', 1900 + c_nationkey, '"

    def body(*parts: str) -> str:
        return "concat('{" + ", ".join(parts) + "}')"

    whole = (name, description, linkedin, metrics, category, founded)
    case = f"""
      CASE o_orderkey % 13
        WHEN 1 THEN {body(*whole[1:])}
        WHEN 2 THEN {body('"name": null', *whole[1:])}
        WHEN 3 THEN {body(name, description, '"linkedin": null', metrics, category, founded)}
        WHEN 4 THEN {body(name, description, linkedin, '"metrics": null', category, founded)}
        WHEN 5 THEN {body(name, description, linkedin, founded)}
        WHEN 6 THEN {body(name, description, linkedin,
                          '"metrics": {"employees": "1,200", "raised": "$1M"}', category, founded)}
        WHEN 7 THEN {body(name, description, linkedin,
                          '"metrics": {"employees": " 50 ", "raised": ' + "', o_orderkey, '}",
                          category, founded)}
        WHEN 8 THEN '[]'
        WHEN 9 THEN concat('profile of ', c_name)
        WHEN 10 THEN NULL
        ELSE {body(*whole)}
      END"""
    return _orders_with_customer(spark, sf).selectExpr(
        "o_orderkey AS request_id",
        "o_orderkey % 13 <> 0 AS configured",
        f"{case} AS body",
        "CASE WHEN o_orderkey % 13 = 10 THEN 'timeout' END AS error",
    )


def contact_payloads(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi")
    )
    joined = lines.join(table(spark, sf, "supplier"), F.col("lo") == F.col("s_suppkey"), "left")
    name = "\"fullName\": \"', s_name, '\""
    two = (
        "\"emailAddresses\": [{\"email\": \"s', lo, '@example.com\"}, "
        "{\"email\": \"s', hi, '@example.com\"}]"
    )
    social = "\"socialNetworks\": {\"linkedin\": \"in/', lo, '\"}"

    def body(*parts: str) -> str:
        return "concat('{" + ", ".join(parts) + "}')"

    case = f"""
      CASE l_orderkey % 9
        WHEN 1 THEN {body(name, social)}
        WHEN 2 THEN {body(name, '"emailAddresses": []', social)}
        WHEN 3 THEN {body(name, '"emailAddresses": [null]', social)}
        WHEN 4 THEN {body(name, '"emailAddresses": [{}]', social)}
        WHEN 5 THEN {body(name, two, '"socialNetworks": null')}
        WHEN 6 THEN {body(name, two)}
        WHEN 7 THEN {body('"fullName": ""', two, social)}
        WHEN 8 THEN {body(name, '"emailAddresses": null', social)}
        ELSE {body(name, two, social)}
      END"""
    return joined.selectExpr(
        "l_orderkey AS request_id", "true AS configured", f"{case} AS body",
        "CAST(NULL AS STRING) AS error",
    )


def emails_payloads(spark: SparkSession, sf: str) -> DataFrame:
    def entry(kind: str, position: str | None, value: str) -> str:
        place = f', "position": {position}' if position else ""
        return f'{{"type": "{kind}"{place}, "value": {value}}}'

    middle_kind = "', CASE WHEN o_orderstatus = 'P' THEN 'personal' ELSE 'generic' END, '"
    title = (
        "\"', CASE o_orderpriority WHEN '1-URGENT' THEN 'CEO' WHEN '2-HIGH' THEN 'Founder' "
        "WHEN '3-MEDIUM' THEN 'Chief Executive Officer' ELSE 'Clerk' END, '\""
    )
    first = entry("generic", "\"', o_orderpriority, '\"", "\"info', o_orderkey, '@example.com\"")
    first_null = entry("generic", "null", "\"info', o_orderkey, '@example.com\"")
    second = entry(middle_kind, '"Buyer"', "\"p', o_orderkey, '@example.com\"")
    second_null = entry(middle_kind, '"Buyer"', "null")
    second_bare = entry(middle_kind, None, "\"p', o_orderkey, '@example.com\"")
    third = entry("generic", title, "\"x', o_orderkey, '@example.com\"")
    third_null = entry("generic", "null", "\"x', o_orderkey, '@example.com\"")

    def body(*entries: str) -> str:
        return "concat('{\"data\": {\"emails\": [" + ", ".join(entries) + "]}}')"

    case = f"""
      CASE o_orderkey % 10
        WHEN 1 THEN {body(first_null, second, third)}
        WHEN 2 THEN {body(first, second, third_null)}
        WHEN 3 THEN '{{"data": {{"emails": null}}}}'
        WHEN 4 THEN '{{"data": null}}'
        WHEN 5 THEN '{{"data": {{}}}}'
        WHEN 6 THEN {body(first, second_null, third)}
        WHEN 7 THEN {body(first, second_bare, third)}
        ELSE {body(first, second, third)}
      END"""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id", "o_orderkey % 10 <> 0 AS configured", f"{case} AS body",
        "CAST(NULL AS STRING) AS error",
    )


def news_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Articles are the lines of the whole document text."""
    lines = "split(text, '\\n')"
    case = f"""
      CASE doc_id % 7
        WHEN 1 THEN '{{"status": "ok"}}'
        WHEN 2 THEN '{{"articles": null}}'
        WHEN 3 THEN to_json(named_struct('articles', transform({lines}, x ->
                    named_struct('title', CAST(NULL AS STRING), 'url', x))),
                    map('ignoreNullFields', 'false'))
        WHEN 4 THEN to_json(named_struct('articles', transform({lines}, x ->
                    named_struct('url', x))))
        WHEN 5 THEN '{{"articles": [{{}}]}}'
        WHEN 6 THEN '{{"articles": [{{"title": "t"}}, null]}}'
        ELSE to_json(named_struct('articles', transform({lines}, x ->
                    named_struct('title', x))))
      END"""
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS request_id", "true AS configured", f"{case} AS body",
        "CAST(NULL AS STRING) AS error",
    )


def payloads(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "profile": profile_payloads(spark, sf),
        "contact": contact_payloads(spark, sf),
        "emails": emails_payloads(spark, sf),
        "news": news_payloads(spark, sf),
    }


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    case = """
      CASE doc_id % 8
        WHEN 0 THEN '{"assessment": "fine"}'
        WHEN 1 THEN '{"missing_fields": []}'
        WHEN 2 THEN '{"missing_fields": null}'
        WHEN 3 THEN CASE WHEN quality = 1
                    THEN '{"missing_fields": ["ceo_email", "company_revenue"]}'
                    ELSE '{"missing_fields": ["industry"]}' END
        WHEN 4 THEN '{"missing_fields": ["ceo_email", 1]}'
        WHEN 5 THEN '{"missing_fields": "ceo_email"}'
        WHEN 6 THEN 'no fields are missing'
        ELSE '["ceo_email"]'
      END"""
    return table(spark, sf, "labels").selectExpr(
        "doc_id AS request_id", f"{case} AS content",
        "20 + quality AS input_tokens", "CASE WHEN doc_id % 8 <> 2 THEN 5 + toxic END AS output_tokens",
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("partkey")
    )
    joined = parts.join(
        table(spark, sf, "part"), F.col("partkey") == F.col("p_partkey"), "left"
    )
    k = "l_orderkey % 17"
    # the value of each key by variant; NULL leaves the key out
    company = f"CASE WHEN {k} = 12 THEN NULL ELSE concat('\"company_name\": \"', p_name, '\"') END"
    ceo = (
        f"CASE {k} WHEN 10 THEN '\"ceo_name\": 5' WHEN 11 THEN '\"ceo_name\": \"\"' "
        "ELSE concat('\"ceo_name\": \"Lead of ', p_brand, '\"') END"
    )
    count = (
        f"CASE {k} WHEN 1 THEN concat('\"employee_count\": \" ', p_size, '.0 \"') "
        f"WHEN 2 THEN '\"employee_count\": -1' WHEN 3 THEN '\"employee_count\": 100.5' "
        "WHEN 11 THEN '\"employee_count\": 0' "
        "ELSE concat('\"employee_count\": ', p_size) END"
    )
    year = (
        f"CASE {k} WHEN 7 THEN '\"founding_year\": true' "
        "ELSE concat('\"founding_year\": ', 1950 + p_size, '.0') END"
    )
    news = (
        f"CASE {k} WHEN 8 THEN '\"news_articles\": \"none\"' "
        "ELSE concat('\"news_articles\": [\"', p_name, '\", \"', p_brand, '\"]') END"
    )
    score = (
        f"CASE {k} WHEN 4 THEN NULL WHEN 5 THEN '\"confidence_score\": 1.01' "
        "WHEN 6 THEN '\"confidence_score\": \"0.5\"' "
        "ELSE concat('\"confidence_score\": 0.', lpad(CAST(p_size % 100 AS STRING), 2, '0')) END"
    )
    sources = (
        f"CASE {k} WHEN 9 THEN '\"sources_used\": [1]' "
        "ELSE concat('\"sources_used\": [\"catalog\", \"', p_brand, '\"]') END"
    )
    rest = (
        "concat('\"ceo_email\": null, \"company_description\": \"', p_type, '\", "
        "\"linkedin_url\": \"in/p', partkey, '\", \"linkedin_company_url\": null, "
        "\"company_website\": \"https://p', partkey, '.example.com\", \"funding_raised\": \"$', "
        "p_size, 'K\", \"industry\": \"', p_type, '\", \"extra\": 1')"
    )
    full = (
        f"concat('{{', concat_ws(', ', {company}, {ceo}, {count}, {year}, {news}, {score}, "
        f"{sources}, {rest}), '}}')"
    )
    case = f"""
      CASE {k}
        WHEN 13 THEN concat('[', {full}, ']')
        WHEN 14 THEN concat('The company is ', p_name)
        WHEN 15 THEN NULL
        WHEN 16 THEN concat('{{"company_name": "', p_name,
                            '", "confidence_score": 1, "sources_used": []}}')
        ELSE {full}
      END"""
    return joined.selectExpr(
        "l_orderkey AS request_id", f"{case} AS content",
        f"CASE WHEN {k} <> 3 THEN p_size * 10 END AS input_tokens", "p_size AS output_tokens",
    )


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey * 10 + l_linenumber AS id",
        "l_orderkey AS request_id",
        """CASE l_linenumber % 5 WHEN 1 THEN 'validate_input' WHEN 2 THEN 'fetch_apis'
           WHEN 3 THEN 'evaluate_intelligence_gate' WHEN 4 THEN 'spawn_fallback_agent'
           ELSE 'save_final_lineage' END AS step_name""",
        """CASE l_returnflag WHEN 'A' THEN 'started' WHEN 'R' THEN 'failed'
           ELSE 'success' END AS status""",
        "concat('{\"quantity\": ', CAST(l_quantity AS INT), '}') AS payload",
        "l_shipdate AS timestamp",
    )


STEP_OF_EVENT = (
    "CASE event_type WHEN 'signup' THEN 'validate_input' WHEN 'view' THEN 'fetch_apis' "
    "WHEN 'click' THEN 'evaluate_intelligence_gate' WHEN 'error' THEN 'spawn_fallback_agent' "
    "ELSE 'save_final_lineage' END"
)
STATUS_OF_EVENT = (
    "CASE event_id % 4 WHEN 0 THEN 'started' WHEN 1 THEN 'success' WHEN 2 THEN 'failed' "
    "ELSE 'skipped' END"
)


def step_events_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS id", "user_id AS request_id", f"{STEP_OF_EVENT} AS step_name",
        f"{STATUS_OF_EVENT} AS status", "props AS payload", "ts AS timestamp",
    )


def step_events(spark: SparkSession, sf: str) -> DataFrame:
    return step_events_of(table(spark, sf, "events"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id AS request_id", "event_type AS provider", "ts", "event_id",
        "CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'error' END AS outcome",
        "event_id % 5 <> 0 AS retryable", "props AS body",
        "concat('error ', event_id) AS error",
    )


WORDS = "CAST(length(text) - length(replace(text, ' ', '')) + 1 AS INT)"


def usage_of(conversations: DataFrame) -> DataFrame:
    return conversations.selectExpr(
        "turn AS id",
        "conv_id AS request_id",
        "'offline-model' AS model_name",
        f"CASE WHEN role = 'assistant' THEN 0 ELSE {WORDS} END AS input_tokens",
        f"CASE WHEN role = 'assistant' THEN {WORDS} ELSE 0 END AS output_tokens",
        f"{WORDS} AS total_tokens",
        "role AS step_name",
        """timestampadd(SECOND, turn, timestampadd(MINUTE, conv_id,
           TIMESTAMP_NTZ '2024-01-01 00:00:00')) AS created_at""",
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return usage_of(table(spark, sf, "conversations"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "vec_id AS lead_id", "embedding",
        "concat('label ', label) AS content_summary",
    )


def config(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed table as large as the customers."""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "concat('cust-', c_custkey) AS setting_key",
        "c_mktsegment AS setting_value",
    )


def config_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of changes as large as the orders; half its keys are unknown."""
    return table(spark, sf, "orders").selectExpr(
        "concat('cust-', o_custkey * 2) AS setting_key", "o_orderpriority AS setting_value",
        "o_orderdate AS changed_at", "o_orderkey AS seq",
    )
