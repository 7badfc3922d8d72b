"""Table schemas, field lists and the fixed values shared by all operators."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Names, limits and texts that appear in results and so must be
# exactly these.

# the twelve checked fields, in report order
CHECKED_FIELDS = [
    "company_name", "ceo_name", "ceo_email", "company_description",
    "linkedin_url", "linkedin_company_url", "employee_count",
    "company_website", "funding_raised", "industry", "founding_year",
    "news_articles",
]

# provider role -> name recorded as the source, lowest priority first
PROVIDER_SOURCES = {
    "profile": "clearbit",
    "contact": "lusha",
    "emails": "hunter",
    "news": "google_news",
}

STEP_NAMES = [
    "validate_input",
    "fetch_apis",
    "evaluate_intelligence_gate",
    "spawn_fallback_agent",
    "save_final_lineage",
]

LEAD_STATUSES = ["pending", "processing", "completed", "failed"]
LOG_STATUSES = ["started", "success", "failed", "skipped"]

EXECUTIVE_POSITIONS = ["ceo", "chief executive officer", "founder"]

EMBEDDING_DIM = 1536
NO_SUMMARY_TEXT = "No enrichment data available"
SKIP_REASON_TEXT = "No data gaps detected"
UNKNOWN_COMPANY_TEXT = "Unknown"

# label and field of each part of a content summary
SUMMARY_LABELS = [
    ("Company: ", "company_name"),
    ("Industry: ", "industry"),
    ("", "company_description"),
    ("CEO: ", "ceo_name"),
    ("Employees: ", "employee_count"),
    ("Funding: ", "funding_raised"),
    ("Founded: ", "founding_year"),
]

# where a profile payload holds each field
PROFILE_PATHS = {
    "company_name": "$.name",
    "company_description": "$.description",
    "company_website": "$.url",
    "linkedin_company_url": "$.linkedin.handle",
    "employee_count": "$.metrics.employees",
    "industry": "$.category.industry",
    "founding_year": "$.foundedYear",
    "funding_raised": "$.metrics.raised",
}

MAX_ATTEMPTS = 3
BACKOFF_MIN_SECONDS = 1
BACKOFF_MAX_SECONDS = 10

NAME_MAX = 256
DOMAIN_MAX = 512
CONFIG_KEY_MAX = 128
CONFIG_VALUE_MAX = 512
QUERY_TEXT_MAX = 1000
SEARCH_LIMIT_MAX = 50
LIST_LIMIT_MAX = 200
PER_PAGE = 20
TRACE_CHARS = 500

NEWS_PAGE_SIZE = 5
NEWS_SORT = "relevancy"
NEWS_LANGUAGE = "en"
# ---------------------------------------------------------------------------

INT_FIELDS = ("employee_count", "founding_year")
LIST_FIELDS = ("news_articles",)

# Counts are BIGINT: a provider or model may return more than 32 bits.
FIELD_TYPES = {
    f: "bigint" if f in INT_FIELDS else "array<string>" if f in LIST_FIELDS else "string"
    for f in CHECKED_FIELDS
}

EXTRACTION_TYPES = {**FIELD_TYPES, "confidence_score": "double", "sources_used": "array<string>"}

RECORD_TYPES = {
    **EXTRACTION_TYPES,
    "fallback_confidence_score": "double",
    "fallback_sources_used": "array<string>",
    "api_sources": "array<string>",
    "had_fallback": "boolean",
}


def struct_ddl(types: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in types.items()) + ">"


ISSUES_DDL = "array<struct<field: string, original: string>>"

REQUESTS_DDL = "request_id STRING, raw_input STRING, created_at TIMESTAMP"
PAYLOADS_DDL = (
    "request_id STRING, provider STRING, configured BOOLEAN, body STRING, error STRING"
)
ATTEMPTS_DDL = (
    "request_id STRING, provider STRING, attempt INT, outcome STRING, "
    "retryable BOOLEAN, body STRING, error STRING"
)
RESPONSES_DDL = (
    "request_id STRING, content STRING, input_tokens INT, output_tokens INT"
)
LEADS_DDL = (
    "id STRING, request_id STRING, raw_input STRING, "
    f"enriched_data {struct_ddl(RECORD_TYPES)}, status STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
LOGS_DDL = (
    "id BIGINT, request_id STRING, seq INT, step_name STRING, status STRING, "
    "payload STRING, timestamp TIMESTAMP"
)
USAGE_DDL = (
    "id BIGINT, request_id STRING, model_name STRING, input_tokens INT, "
    "output_tokens INT, total_tokens INT, step_name STRING, created_at TIMESTAMP"
)
EMBEDDINGS_DDL = (
    "id BIGINT, lead_id STRING, embedding ARRAY<FLOAT>, content_summary STRING, "
    "created_at TIMESTAMP"
)
CONFIG_DDL = "id INT, setting_key STRING, setting_value STRING"
