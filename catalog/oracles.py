"""The registered queries in plain SQL, for DuckDB on the same tables.

No SQL here parses JSON: what a payload must yield is computed from the source
columns it was built from, so a reading error on the Spark side shows up.
"""

from __future__ import annotations

import re

NAMES = "'company_name', 'ceo_name', 'ceo_email', 'company_description', 'linkedin_url', " \
        "'linkedin_company_url', 'employee_count', 'company_website', 'funding_raised', " \
        "'industry', 'founding_year', 'news_articles'"
FIELDS = [n.strip().strip("'") for n in NAMES.split(",")]
INTS = ("employee_count", "founding_year")

DOMAIN = ("CASE WHEN c_custkey % 7 = 0 THEN NULL "
          "ELSE lower(replace(c_name, '#', '-')) || '.example.com' END")

LEAD_STATUS = ("CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'failed' "
               "WHEN o_orderstatus = 'F' THEN 'completed' "
               "WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'pending' END")


def text_list(items: list[str]) -> str:
    """Items that are not NULL, joined by '|'."""
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), '|')"


def shown(column: str) -> str:
    """A list as text with NULL elements marked; NULL list stays NULL."""
    return (f"CASE WHEN {column} IS NULL THEN NULL ELSE coalesce(array_to_string("
            f"list_transform({column}, lambda x: coalesce(x, '<null>')), '|'), '') END")


def falsy(field: str, prefix: str = "") -> str:
    c = f"{prefix}{field}"
    if field == "news_articles":
        return f"({c} IS NULL OR len({c}) = 0)"
    return f"({c} IS NULL OR {c} = {0 if field in INTS else repr('')})"


CTES = {
    "leads": f"""
      SELECT o_orderkey AS id, o_orderkey AS request_id, c_name AS company_name,
             {DOMAIN} AS company_domain, {LEAD_STATUS} AS status,
             CASE WHEN o_orderstatus = 'F' THEN c_mktsegment END AS enriched_data,
             o_orderdate AS created_at, o_orderdate AS updated_at
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "requests": f"""
      SELECT o_orderkey AS request_id, o_orderdate AS created_at,
        o_orderkey % 23 AS k,
        CASE WHEN o_orderkey % 23 IN (1, 2, 4, 10, 11) THEN NULL
             WHEN o_orderkey % 23 = 3 THEN ''
             WHEN o_orderkey % 23 = 5 THEN repeat('n', 256)
             WHEN o_orderkey % 23 = 6 THEN repeat('n', 257)
             WHEN o_orderkey % 23 = 13 THEN ' ' ELSE c_name END AS company_name,
        CASE WHEN o_orderkey % 23 = 1 THEN 'a.example.com'
             WHEN o_orderkey % 23 = 7 THEN repeat('d', 513)
             WHEN o_orderkey % 23 = 14 THEN ''
             WHEN o_orderkey % 23 IN (2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13) THEN NULL
             ELSE {DOMAIN} END AS company_domain,
        CASE WHEN o_orderkey % 23 = 9 THEN o_orderpriority END AS context_priority,
        CASE o_orderkey % 23 WHEN 1 THEN 'company_name:missing'
             WHEN 2 THEN 'company_name:not_text' WHEN 3 THEN 'company_name:too_short'
             WHEN 4 THEN 'company_name:not_text' WHEN 6 THEN 'company_name:too_long'
             WHEN 7 THEN 'company_domain:too_long'
             WHEN 8 THEN 'additional_context:not_an_object'
             WHEN 10 THEN 'raw_input:not_an_object' WHEN 11 THEN 'raw_input:not_an_object'
             ELSE '' END AS errors
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "profile": """
      SELECT o_orderkey AS request_id, c.*, o_orderkey % 13 AS k,
        CASE WHEN o_orderkey % 13 = 0 THEN 'skipped'
             WHEN o_orderkey % 13 IN (3, 4, 8, 9, 10) THEN 'error' ELSE 'ok' END AS state,
        CASE o_orderkey % 13 WHEN 3 THEN 'linkedin:not_an_object'
             WHEN 4 THEN 'metrics:not_an_object' WHEN 8 THEN 'body:not_an_object'
             WHEN 9 THEN 'body:not_json' WHEN 10 THEN 'timeout' END AS error
      FROM orders LEFT JOIN customer c ON o_custkey = c_custkey""",
    # name: 'absent' falls back to the asked name, which differs by query
    "profile_values": """
      SELECT request_id, state, error, k,
        CASE WHEN state <> 'ok' OR k = 2 OR k = 1 THEN NULL ELSE c_name || ' Inc' END
          AS company_name,
        CASE WHEN state = 'ok' THEN 'Serves ' || c_mktsegment END AS company_description,
        CASE WHEN state = 'ok' THEN 'https://www.example.com/' || c_custkey END
          AS company_website,
        CASE WHEN state = 'ok' THEN 'company/' || c_custkey END AS linkedin_company_url,
        CASE WHEN state <> 'ok' OR k IN (5, 6) THEN NULL WHEN k = 7 THEN 50
             ELSE c_custkey % 50 END AS employee_count,
        CASE WHEN state = 'ok' AND k <> 5 THEN c_mktsegment END AS industry,
        CASE WHEN state = 'ok' THEN CAST(1900 + c_nationkey AS BIGINT) END AS founding_year,
        CASE WHEN state <> 'ok' OR k = 5 THEN NULL WHEN k = 6 THEN '$1M'
             WHEN k = 7 THEN CAST(request_id AS VARCHAR) ELSE '$' || c_nationkey || 'M' END
          AS funding_raised,
        CASE WHEN state = 'ok' AND k = 6 THEN 'employee_count=1,200' ELSE '' END AS issues
      FROM profile""",
    "contact": """
      SELECT l_orderkey AS request_id, lo, hi, s_name, l_orderkey % 9 AS k,
        CASE WHEN l_orderkey % 9 IN (3, 5) THEN 'error' ELSE 'ok' END AS state,
        CASE l_orderkey % 9 WHEN 3 THEN 'emailAddresses:first_not_an_object'
             WHEN 5 THEN 'socialNetworks:not_an_object' END AS error
      FROM (SELECT l_orderkey, min(l_suppkey) lo, max(l_suppkey) hi FROM lineitem GROUP BY 1)
      LEFT JOIN supplier ON lo = s_suppkey""",
    "contact_values": """
      SELECT request_id, state, error,
        CASE WHEN state <> 'ok' THEN NULL WHEN k = 7 THEN '' ELSE s_name END AS ceo_name,
        CASE WHEN state = 'ok' AND k IN (0, 6, 7) THEN 's' || lo || '@example.com' END
          AS ceo_email,
        CASE WHEN state = 'ok' AND k <> 6 THEN 'in/' || lo END AS linkedin_url
      FROM contact""",
    # the result of the call, before a missing domain skips it
    "emails_called": """
      SELECT o_orderkey AS request_id, o_orderkey % 10 AS k, o_orderstatus = 'P' AS personal,
        o_orderpriority AS priority,
        CASE WHEN o_orderkey % 10 = 1 THEN 'emails:bad_entry'
             WHEN o_orderkey % 10 = 2 AND o_orderstatus <> 'P' THEN 'emails:bad_entry'
             WHEN o_orderkey % 10 = 3 THEN 'emails:not_a_list'
             WHEN o_orderkey % 10 = 4 THEN 'data:not_an_object' END AS fault
      FROM orders""",
    "emails_found": """
      SELECT request_id, k, fault,
        CASE WHEN fault IS NOT NULL OR k = 5 THEN NULL
             WHEN personal AND k = 6 THEN NULL
             WHEN personal THEN 'p' || request_id || '@example.com'
             WHEN priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
             THEN 'x' || request_id || '@example.com' END AS ceo_email
      FROM emails_called""",
    "news_values": """
      SELECT doc_id AS request_id,
        CASE WHEN doc_id % 7 IN (2, 6) THEN 'error' ELSE 'ok' END AS state,
        CASE doc_id % 7 WHEN 2 THEN 'articles:not_a_list' WHEN 6 THEN 'articles:bad_entry' END
          AS error,
        CASE doc_id % 7 WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN NULL WHEN 6 THEN NULL
             WHEN 3 THEN list_transform(string_split(text, chr(10)),
                                        lambda x: CAST(NULL AS VARCHAR))
             WHEN 5 THEN [''] ELSE string_split(text, chr(10)) END AS news_articles
      FROM documents""",
    "verdicts": """
      SELECT doc_id AS request_id, doc_id % 8 AS k,
        CASE WHEN doc_id % 8 = 3 AND quality = 1 THEN ['ceo_email', 'company_revenue']
             WHEN doc_id % 8 = 3 THEN ['industry'] END AS named
      FROM labels""",
    "parts": """
      SELECT l_orderkey, min(l_partkey) AS partkey FROM lineitem GROUP BY 1""",
    "fills": """
      SELECT l_orderkey AS request_id, l_orderkey % 17 AS k, p.*,
        CASE l_orderkey % 17 WHEN 2 THEN 'employee_count:invalid'
             WHEN 3 THEN 'employee_count:invalid' WHEN 4 THEN 'confidence_score:missing'
             WHEN 5 THEN 'confidence_score:invalid' WHEN 8 THEN 'news_articles:invalid'
             WHEN 9 THEN 'sources_used:invalid' WHEN 10 THEN 'ceo_name:invalid'
             WHEN 12 THEN 'company_name:missing' WHEN 13 THEN 'content:not_an_object'
             WHEN 14 THEN 'content:not_an_object' WHEN 15 THEN 'content:not_an_object'
             ELSE '' END AS errors
      FROM parts LEFT JOIN part p ON partkey = p_partkey""",
    "fill_values": """
      SELECT request_id, errors, errors = '' AS usable,
        CASE WHEN errors = '' THEN p_name END AS company_name,
        CASE WHEN errors <> '' OR k = 16 THEN NULL WHEN k = 11 THEN ''
             ELSE 'Lead of ' || p_brand END AS ceo_name,
        CAST(NULL AS VARCHAR) AS ceo_email,
        CASE WHEN errors = '' AND k <> 16 THEN p_type END AS company_description,
        CASE WHEN errors = '' AND k <> 16 THEN 'in/p' || p_partkey END AS linkedin_url,
        CAST(NULL AS VARCHAR) AS linkedin_company_url,
        CASE WHEN errors <> '' OR k = 16 THEN NULL WHEN k = 11 THEN 0
             ELSE CAST(p_size AS BIGINT) END AS employee_count,
        CASE WHEN errors = '' AND k <> 16 THEN 'https://p' || p_partkey || '.example.com' END
          AS company_website,
        CASE WHEN errors = '' AND k <> 16 THEN '$' || p_size || 'K' END AS funding_raised,
        CASE WHEN errors = '' AND k <> 16 THEN p_type END AS industry,
        CASE WHEN errors <> '' OR k = 16 THEN NULL WHEN k = 7 THEN 1
             ELSE CAST(1950 + p_size AS BIGINT) END AS founding_year,
        CASE WHEN errors = '' AND k <> 16 THEN [p_name, p_brand] END AS news_articles,
        CASE WHEN errors <> '' THEN NULL WHEN k = 6 THEN CAST(0.5 AS DOUBLE)
             WHEN k = 16 THEN CAST(1 AS DOUBLE)
             ELSE round(CAST(p_size % 100 AS DOUBLE) / 100, 4) END AS confidence_score,
        CASE WHEN errors <> '' THEN NULL WHEN k = 16 THEN CAST([] AS VARCHAR[])
             ELSE ['catalog', p_brand] END AS sources_used
      FROM fills""",
    # the asked name and domain: of the lead, or as read from the raw request
    "asked_leads": "SELECT request_id, company_name, company_domain FROM leads",
    "asked_requests": "SELECT request_id, company_name, company_domain FROM requests",
    "logs": """
      SELECT l_partkey * 10 + l_linenumber AS id, l_orderkey AS request_id,
        CASE l_linenumber % 5 WHEN 1 THEN 'validate_input' WHEN 2 THEN 'fetch_apis'
             WHEN 3 THEN 'evaluate_intelligence_gate' WHEN 4 THEN 'spawn_fallback_agent'
             ELSE 'save_final_lineage' END AS step_name,
        CASE l_returnflag WHEN 'A' THEN 'started' WHEN 'R' THEN 'failed' ELSE 'success' END
          AS status,
        '{"quantity": ' || CAST(l_quantity AS INTEGER) || '}' AS payload,
        l_shipdate AS timestamp
      FROM lineitem""",
    "step_events": """
      SELECT event_id AS id, user_id AS request_id,
        CASE event_type WHEN 'signup' THEN 'validate_input' WHEN 'view' THEN 'fetch_apis'
             WHEN 'click' THEN 'evaluate_intelligence_gate'
             WHEN 'error' THEN 'spawn_fallback_agent' ELSE 'save_final_lineage' END AS step_name,
        CASE event_id % 4 WHEN 0 THEN 'started' WHEN 1 THEN 'success' WHEN 2 THEN 'failed'
             ELSE 'skipped' END AS status,
        props AS payload, ts AS timestamp
      FROM events""",
    "tokens": """
      SELECT turn AS id, conv_id AS request_id, 'offline-model' AS model_name,
        CASE WHEN role = 'assistant' THEN 0 ELSE words END AS input_tokens,
        CASE WHEN role = 'assistant' THEN words ELSE 0 END AS output_tokens,
        words AS total_tokens, role AS step_name,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) AS created_at
      FROM (SELECT *, CAST(len(text) - len(replace(text, ' ', '')) + 1 AS INTEGER) AS words
            FROM conversations)""",
    "config": """
      SELECT c_custkey AS id, 'cust-' || c_custkey AS setting_key, c_mktsegment AS setting_value
      FROM customer""",
    "changes": """
      SELECT 'cust-' || (o_custkey * 2) AS setting_key,
             arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS setting_value
      FROM orders GROUP BY 1""",
    "nearest_means": """
      SELECT label, list(mean ORDER BY pos) AS mean FROM (
        SELECT label, pos, avg(CAST(v AS DOUBLE)) AS mean FROM (
          SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
          FROM embeddings) u GROUP BY label, pos) m GROUP BY label""",
}


def _merged(asked: str) -> str:
    """Provider results and the merged twelve fields per asked request."""
    return f"""
      SELECT a.request_id, a.company_name AS asked_name,
        coalesce(p.state, 'skipped') AS profile_state, p.error AS profile_error,
        coalesce(p.issues, '') AS type_issues,
        coalesce(c.state, 'skipped') AS contact_state, c.error AS contact_error,
        CASE WHEN e.k = 0 OR a.company_domain IS NULL OR a.company_domain = '' THEN 'skipped'
             WHEN e.fault IS NOT NULL THEN 'error' ELSE 'ok' END AS emails_state,
        CASE WHEN e.k = 0 OR a.company_domain IS NULL OR a.company_domain = '' THEN NULL
             ELSE e.fault END AS emails_error,
        coalesce(n.state, 'skipped') AS news_state, n.error AS news_error,
        coalesce(p.company_name, a.company_name) AS company_name,
        c.ceo_name,
        coalesce(CASE WHEN e.k = 0 OR a.company_domain IS NULL OR a.company_domain = '' THEN NULL
                      ELSE e.ceo_email END, c.ceo_email) AS ceo_email,
        p.company_description, c.linkedin_url, p.linkedin_company_url, p.employee_count,
        p.company_website, p.funding_raised, p.industry, p.founding_year, n.news_articles
      FROM {asked} a
      LEFT JOIN profile_values p USING (request_id)
      LEFT JOIN contact_values c USING (request_id)
      LEFT JOIN emails_found e USING (request_id)
      LEFT JOIN news_values n USING (request_id)"""


def _gaps(merged: str) -> str:
    detected = ", ".join(f"CASE WHEN {falsy(f)} THEN '{f}' END" for f in FIELDS)
    populated = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in FIELDS)
    return f"""
      SELECT *, CASE WHEN len(gaps) = 0 OR k IN (1, 2) THEN NULL
                     ELSE coalesce(named, gaps) END AS missing_fields
      FROM (SELECT m.*, v.k, v.named,
              list_filter([{detected}], lambda x: x IS NOT NULL) AS gaps,
              list_filter([{populated}], lambda x: x IS NOT NULL) AS populated,
              list_filter([CASE WHEN profile_state <> 'skipped' THEN 'clearbit' END,
                           CASE WHEN contact_state <> 'skipped' THEN 'lusha' END,
                           CASE WHEN emails_state <> 'skipped' THEN 'hunter' END,
                           CASE WHEN news_state <> 'skipped' THEN 'google_news' END],
                          lambda x: x IS NOT NULL) AS api_sources
            FROM {merged} m LEFT JOIN verdicts v USING (request_id))"""


def _final(gaps: str, only_needed: bool) -> str:
    """Final record; ``only_needed`` restricts fills to records with missing fields."""
    use = "f.usable AND g.missing_fields IS NOT NULL" if only_needed else "f.usable"
    fields = ", ".join(
        f"CASE WHEN NOT {falsy(f, 'g.')} THEN g.{f} "
        f"WHEN {use} AND f.{f} IS NOT NULL THEN f.{f} ELSE g.{f} END AS {f}"
        for f in FIELDS
    )
    return f"""
      SELECT g.request_id, g.missing_fields, g.api_sources, g.populated, {fields},
        f.request_id IS NOT NULL AS answered, f.errors AS fill_errors,
        coalesce({use}, false) AS had_fallback,
        CASE WHEN {use} THEN f.confidence_score END AS confidence_score,
        CASE WHEN {use} THEN f.sources_used END AS sources_used
      FROM {gaps} g LEFT JOIN fill_values f USING (request_id)"""


CTES["merged_leads"] = _merged("asked_leads")
CTES["merged_requests"] = _merged("asked_requests")
CTES["gaps_leads"] = _gaps("merged_leads")
CTES["gaps_requests"] = _gaps("merged_requests")
CTES["final_leads"] = _final("gaps_leads", False)
CTES["final_requests"] = _final("gaps_requests", True)
CTES["outcome"] = f"""
      SELECT x.*, r.errors, r.created_at, r.company_name AS asked_name, r.errors = '' AS valid,
        r.errors = '' AND missing_fields IS NOT NULL AS needs,
        CASE WHEN r.errors = '' AND missing_fields IS NOT NULL THEN
          CASE WHEN NOT answered THEN 'response:missing' WHEN fill_errors <> '' THEN fill_errors
          END END AS fill_error,
        {' + '.join(f'CAST(x.{f} IS NOT NULL AS INTEGER)' for f in FIELDS)}
          + CASE WHEN had_fallback THEN 4 ELSE 0 END AS total_fields
      FROM final_requests x JOIN requests r USING (request_id)"""


def sql(body: str) -> str:
    """``body`` with the CTEs it needs, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body


RECORD = ", ".join(f if f != "news_articles" else f"{shown(f)} AS news_articles" for f in FIELDS)
NOW = "TIMESTAMP '2024-06-01 00:00:00'"

_BODIES = {
    "s2_provider_source": """
      SELECT 'profile' AS role, count(*) AS n, count(*) FILTER (o_orderkey % 13 <> 0)
               AS n_configured, count(*) FILTER (o_orderkey % 13 <> 10) AS n_bodies,
             count(*) FILTER (o_orderkey % 13 = 10) AS n_errors FROM orders
      UNION ALL SELECT 'contact', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey),
               count(DISTINCT l_orderkey), 0 FROM lineitem
      UNION ALL SELECT 'emails', count(*), count(*) FILTER (o_orderkey % 10 <> 0), count(*), 0
               FROM orders
      UNION ALL SELECT 'news', count(*), count(*), count(*), 0 FROM documents""",
    "s3_log_sink": "SELECT id, request_id, step_name, status, payload, timestamp FROM logs",
    "s4_usage_sink": """SELECT id, request_id, model_name, input_tokens, output_tokens, total_tokens,
                               step_name, created_at FROM tokens""",
    "s5_embedding_sink": """
      SELECT vec_id AS lead_id, 'label ' || label || again AS content_summary,
             CAST(len(embedding) AS INTEGER) AS dim,
             round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
             round(CAST(embedding[-1] AS DOUBLE), 6) AS last_value
      FROM embeddings, (VALUES (''), (' again')) t(again)""",
    "s6_leads_sink": f"""
      SELECT request_id, CASE WHEN status = 'processing' THEN 'completed' ELSE status END AS status,
             CASE WHEN status = 'processing' THEN lower(company_name) ELSE enriched_data END
               AS enriched_data, created_at,
             CASE WHEN status = 'processing' THEN {NOW} ELSE updated_at END AS updated_at
      FROM leads""",
    "v1_validate_requests": """
      SELECT request_id, company_name, company_domain, context_priority, errors FROM requests""",
    "v2_validate_extractions": f"""
      SELECT request_id, errors, {RECORD}, confidence_score, {shown('sources_used')} AS sources_used
      FROM fill_values""",
    "v3_gap_lists": f"SELECT request_id, {shown('named')} AS missing_fields FROM verdicts",
    "v4_validate_changes": f"""
      SELECT o_orderkey AS seq, {text_list([
        "CASE o_orderkey % 7 WHEN 0 THEN 'key:missing' WHEN 1 THEN 'key:too_short' "
        "WHEN 3 THEN 'key:too_long' END",
        "CASE o_orderkey % 5 WHEN 0 THEN 'value:missing' WHEN 2 THEN 'value:too_long' END"])}
        AS errors FROM orders""",
    "v4_validate_queries": f"""
      SELECT doc_id, CAST(n AS INTEGER) AS "limit", {text_list([
        "CASE WHEN doc_id % 9 = 0 THEN 'query:too_short' WHEN doc_id % 9 = 1 THEN 'query:missing' "
        "WHEN len(text) > 1000 THEN 'query:too_long' END",
        "CASE WHEN n < 1 THEN 'limit:too_small' WHEN n > 50 THEN 'limit:too_large' END"])} AS errors
      FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 10 ELSE doc_id % 60 END AS n FROM documents)""",
    "v5_integrity": """
      SELECT 'duplicate' AS kind, l_orderkey || '/' || l_linenumber AS key, count(*) AS copies
      FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
      UNION ALL
      SELECT 'orphan', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem
      WHERE l_orderkey NOT IN (SELECT request_id FROM leads WHERE status <> 'pending')
      GROUP BY l_orderkey""",
    "v6_illegal_values": """
      SELECT o_orderkey AS request_id, 'status' AS field, 'paused' AS value FROM orders
      WHERE o_orderstatus = 'P'
      UNION ALL
      SELECT event_id, 'step', CASE WHEN event_type <> 'click' THEN event_type END FROM events
      WHERE event_type <> 'view'""",
    "n1_profile": """
      SELECT p.request_id, state, error, issues,
             CASE WHEN state = 'ok' AND k = 1 THEN l.company_name ELSE p.company_name END
               AS company_name, company_description, company_website, linkedin_company_url,
             employee_count, industry, founding_year, funding_raised
      FROM profile_values p JOIN leads l USING (request_id)""",
    "n2_contact": "SELECT request_id, state, error, ceo_name, ceo_email, linkedin_url FROM contact_values",
    "n3_domain_emails": """
      SELECT request_id, emails_state AS state, emails_error AS error,
             CASE WHEN emails_state = 'ok' THEN e.ceo_email END AS ceo_email
      FROM merged_leads m JOIN emails_found e USING (request_id)""",
    "n4_news": f"""
      SELECT request_id, state, error,
             CASE WHEN state = 'ok' THEN CAST(len(news_articles) AS INTEGER) ELSE NULL END AS n_articles,
             {shown('news_articles')} AS news_articles FROM news_values""",
    "n5_provider_states": """
      SELECT request_id, 'profile' AS role,
             CASE WHEN k = 0 THEN 'skipped' ELSE 'called' END AS state FROM profile
      UNION ALL SELECT request_id, 'contact', 'called' FROM contact
      UNION ALL SELECT request_id, 'emails', CASE WHEN emails_state = 'skipped' THEN 'skipped'
                       ELSE 'called' END FROM merged_leads
      UNION ALL SELECT request_id, 'news', 'called' FROM news_values""",
    "n6_provider_errors": """
      SELECT request_id, 'profile' AS role, error FROM profile WHERE error IS NOT NULL
      UNION ALL SELECT request_id, 'contact', error FROM contact WHERE error IS NOT NULL
      UNION ALL SELECT request_id, 'emails', emails_error FROM merged_leads
                WHERE emails_error IS NOT NULL
      UNION ALL SELECT request_id, 'news', error FROM news_values WHERE error IS NOT NULL""",
    "n7_provider_requests": """
      SELECT request_id, 'clearbit' AS provider,
             CASE WHEN company_domain IS NULL THEN 'name=' || company_name
                  ELSE 'domain=' || company_domain END AS params FROM leads
      UNION ALL SELECT request_id, 'lusha', 'company=' || company_name ||
             CASE WHEN company_domain IS NULL THEN '' ELSE '&domain=' || company_domain END FROM leads
      UNION ALL SELECT request_id, 'hunter', 'domain=' || company_domain FROM leads
             WHERE company_domain IS NOT NULL
      UNION ALL SELECT request_id, 'google_news', 'language=en&pageSize=5&q=' || company_name ||
             '&sortBy=relevancy' FROM leads""",
    "n8_reduce_attempts": """
      WITH ranked AS (
        SELECT user_id AS request_id, event_type AS provider, event_id % 3 = 0 AS good,
               event_id % 5 = 0 AS fatal, props, 'error ' || event_id AS err,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
      tries AS (SELECT *, (good OR fatal) AS final FROM ranked WHERE n <= 3),
      stop AS (SELECT request_id, provider,
                 coalesce(min(n) FILTER (final), max(n)) AS n FROM tries GROUP BY ALL)
      SELECT request_id, provider, CASE WHEN good THEN 'success' ELSE 'error' END AS outcome,
             CAST(n AS INTEGER) AS attempts_made, CASE WHEN good THEN props END AS body,
             CASE WHEN NOT good THEN err END AS error,
             CAST(CASE n WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS BIGINT) AS backoff_seconds
      FROM tries JOIN stop USING (request_id, provider, n)""",
    "m1_priority_merge": f"SELECT request_id, {RECORD} FROM merged_leads",
    "m2_sources": f"SELECT request_id, {shown('api_sources')} AS api_sources FROM gaps_leads",
    "m3_errors": f"""
      SELECT request_id, {text_list([
        "'clearbit=' || profile_error", "'lusha=' || contact_error", "'hunter=' || emails_error",
        "'google_news=' || news_error"])} AS api_errors, type_issues FROM merged_leads""",
    "m4_fields_populated": f"SELECT request_id, {shown('populated')} AS fields_populated FROM gaps_leads",
    "g1_detect_gaps": f"SELECT request_id, {shown('gaps')} AS gaps FROM gaps_leads",
    "g2_gap_verdict": f"SELECT request_id, {shown('missing_fields')} AS missing_fields FROM gaps_leads",
    "g3_branch": """
      SELECT request_id, CASE WHEN missing_fields IS NULL THEN 'skip' ELSE 'fill' END AS branch,
             CASE WHEN missing_fields IS NULL THEN 'No data gaps detected' END AS reason
      FROM gaps_leads""",
    "f1_prompts": """
      SELECT request_id, 'Company to look up: ' || asked_name AS first_line,
             'Fields still empty: ' || array_to_string(missing_fields, ', ') AS fields_line,
             'Answer with one JSON object in the agreed fourteen-field form.' AS last_line,
             true AS shows_data
      FROM gaps_leads WHERE missing_fields IS NOT NULL""",
    "f2_fill_responses": """
      SELECT g.request_id, CASE WHEN f.request_id IS NULL THEN 'response:missing'
             WHEN f.errors <> '' THEN f.errors END AS fill_error,
             coalesce(f.usable, false) AS usable
      FROM gaps_leads g LEFT JOIN fill_values f USING (request_id)
      WHERE g.missing_fields IS NOT NULL""",
    "f3_fields_filled": f"""
      SELECT request_id, {text_list(
        [f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in FIELDS if f != 'company_name'])}
        AS fields_filled FROM fill_values WHERE usable""",
    "f4_fill_merge": f"""
      SELECT request_id, {RECORD}, confidence_score, {shown('sources_used')} AS sources_used,
             confidence_score AS fallback_confidence_score,
             {shown('sources_used')} AS fallback_sources_used,
             {shown('api_sources')} AS api_sources, had_fallback FROM final_leads""",
    "f5_result_metrics": f"""
      SELECT request_id, {' + '.join(f'CAST({f} IS NOT NULL AS INTEGER)' for f in FIELDS)}
             + CASE WHEN had_fallback THEN 4 ELSE 0 END AS total_fields, had_fallback
      FROM final_leads""",
    "e1_complete_records": f"""
      SELECT request_id,
        CASE WHEN valid AND fill_error IS NULL THEN 'completed' ELSE 'failed' END AS status,
        {', '.join(
          f"CASE WHEN valid AND fill_error IS NULL THEN "
          f"{shown(f) if f == 'news_articles' else f} END AS {f}" for f in FIELDS)},
        CASE WHEN valid AND fill_error IS NULL THEN confidence_score END AS confidence_score,
        CASE WHEN valid AND fill_error IS NULL THEN {shown('sources_used')} END AS sources_used,
        CASE WHEN valid AND fill_error IS NULL THEN {shown('api_sources')} END AS api_sources,
        CASE WHEN valid AND fill_error IS NULL THEN had_fallback END AS had_fallback, created_at
      FROM outcome""",
    "x1_nearest": """
      SELECT vec_id AS lead_id, 'label ' || label AS content_summary,
             round(s, 4) AS similarity, printf('%.1f%%', round(s, 4) * 100) AS shown
      FROM (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
              (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s
            FROM embeddings)
      ORDER BY round(1 - s, 12), vec_id LIMIT 10""",
    "x2_nearest_batch": """
      SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(s, 4) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - s, 12), id) AS rank
        FROM (SELECT CAST(m.label AS BIGINT) AS query_id, vec_id AS id,
                list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean) AS s
              FROM embeddings CROSS JOIN nearest_means m) scored) ranked WHERE rank <= 10""",
    "x2_nearest_rows": """
      SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(s, 4) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - s, 12), id) AS rank
        FROM (SELECT CAST(q.vec_id AS BIGINT) AS query_id, e.vec_id AS id,
                list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s
              FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) scored
      ) ranked WHERE rank <= 10""",
    "x3_attach_vectors": """
      SELECT l.id AS lead_id, CAST(64 AS INTEGER) AS dim, e.vec_id IS NULL AS is_zero,
             round(coalesce(CAST(embedding[1] AS DOUBLE), 0), 6) AS first_value
      FROM leads l LEFT JOIN embeddings e ON l.id = e.vec_id""",
    "x5_bad_vectors": """
      SELECT vec_id, CAST(CASE vec_id % 5 WHEN 1 THEN 63 WHEN 2 THEN 65 END AS INTEGER) AS dim,
             vec_id % 5 = 0 AS is_null FROM embeddings WHERE vec_id % 5 IN (0, 1, 2)""",
    "q1_lookup": """
      SELECT 'one' AS part, request_id, company_name, status, created_at FROM leads
      WHERE request_id = 7
      UNION ALL SELECT 'many', request_id, company_name, status, created_at FROM leads
      WHERE request_id IN (SELECT doc_id FROM documents)""",
    "q2_page": """
      SELECT 'first' AS part, * FROM (
        SELECT request_id, company_name, status, created_at FROM leads
        ORDER BY created_at DESC, request_id LIMIT 50)
      UNION ALL SELECT 'completed', * FROM (
        SELECT request_id, company_name, status, created_at FROM leads WHERE status = 'completed'
        ORDER BY created_at DESC, request_id LIMIT 200 OFFSET 120)""",
    "q3_page_info": """
      SELECT part, count(l.status) AS total,
             CAST(greatest(1, ceil(count(l.status) / 20)) AS BIGINT) AS total_pages
      FROM (VALUES ('all'), ('pending'), ('processing'), ('completed'), ('failed'),
                   ('unheard of')) t(part)
      LEFT JOIN leads l ON part = 'all' OR l.status = part GROUP BY part""",
    "q4_status_counts": """
      SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending,
             count(*) FILTER (status = 'processing') AS processing,
             count(*) FILTER (status = 'completed') AS completed,
             count(*) FILTER (status = 'failed') AS failed FROM leads""",
    "q5_recent": """
      SELECT request_id, coalesce(company_name, 'Unknown') AS company, status, created_at
      FROM leads ORDER BY created_at DESC, request_id LIMIT 10""",
    "q6_runs": """
      SELECT r.request_id, company_name, r.status AS lead_status, created_at,
             count(l.request_id) OVER (PARTITION BY r.request_id) AS step_count, step_name,
             l.status AS log_status, payload, timestamp
      FROM (SELECT * FROM leads WHERE status IN ('processing', 'completed', 'failed')
            ORDER BY created_at DESC, request_id LIMIT 50) r
      LEFT JOIN logs l USING (request_id)""",
    "q7_detail": """
      SELECT request_id, 'lead' AS kind, created_at AS at, CAST(NULL AS BIGINT) AS id,
             company_name AS name, status, CAST(NULL AS BIGINT) AS total_tokens FROM leads
      UNION ALL SELECT request_id, 'log', timestamp, id, step_name, status, NULL FROM logs
             WHERE request_id IN (SELECT request_id FROM leads)
      UNION ALL SELECT request_id, 'usage', created_at, id, step_name, NULL, total_tokens FROM tokens
             WHERE request_id IN (SELECT request_id FROM leads)""",
    "q8_report": """
      SELECT company_name AS company, CAST(request_id AS VARCHAR) AS request_id,
             CASE WHEN len(CAST(request_id AS VARCHAR)) > 17
                  THEN left(CAST(request_id AS VARCHAR), 11) || '…'
                  ELSE CAST(request_id AS VARCHAR) END AS shown_id, status,
             CASE WHEN status IN ('completed', 'processing', 'failed') THEN status
                  ELSE 'pending' END AS status_group,
             strftime(created_at, '%Y-%m-%d %H:%M') AS created,
             strftime(created_at, '%b %d, %H:%M') AS created_short FROM leads""",
    "q8_usage_report": """
      SELECT left(lpad(CAST(request_id AS VARCHAR), 36, '0'), 11) || '…' AS shown_id, step_name,
             model_name, format('{:,}', input_tokens) AS input_tokens,
             format('{:,}', output_tokens) AS output_tokens,
             format('{:,}', total_tokens) AS total_tokens,
             strftime(created_at, '%m-%d %H:%M') AS time FROM tokens""",
    "q8_log_report": """
      SELECT request_id, step_name, status,
             CASE status WHEN 'success' THEN 'completed' WHEN 'started' THEN 'processing'
                  ELSE status END AS status_group,
             strftime(timestamp, '%H:%M:%S') AS time FROM step_events""",
    "a1_logs_for": """
      SELECT request_id, id, step_name, status, payload, timestamp,
             count(*) OVER (PARTITION BY request_id) AS total FROM logs
      WHERE request_id IN (SELECT doc_id FROM documents)""",
    "a2_lead_status": """
      SELECT l.request_id, CASE WHEN last_status IS NULL THEN 'pending'
             WHEN last_status = 'failed' THEN 'failed'
             WHEN last_step = 'save_final_lineage' AND last_status = 'success' THEN 'completed'
             ELSE 'processing' END AS status
      FROM leads l LEFT JOIN (
        SELECT request_id, arg_max(step_name, (timestamp, id)) AS last_step,
               arg_max(status, (timestamp, id)) AS last_status FROM logs GROUP BY 1) USING (request_id)""",
    "a3_step_spans": """
      SELECT request_id, step_name, started_at, ended_at, status,
             round((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0, 3) AS seconds FROM (
        SELECT request_id, step_name, min(timestamp) FILTER (status = 'started') AS started_at,
               max(timestamp) FILTER (status <> 'started') AS ended_at,
               arg_max(status, (timestamp, id)) AS status
        FROM step_events GROUP BY request_id, step_name)""",
    "a4_latest_step": """
      SELECT request_id, arg_max(step_name, (timestamp, id)) AS step,
             arg_max(status, (timestamp, id)) AS status, max(timestamp) AS timestamp
      FROM step_events GROUP BY request_id""",
    "t1_usage_for": """SELECT * FROM tokens WHERE request_id IN (SELECT doc_id FROM labels)""",
    "t2_token_summary": """
      SELECT CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
             CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
             CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
             count(DISTINCT request_id) AS total_requests FROM tokens""",
    "t3_recent_usage": "SELECT * FROM tokens ORDER BY created_at DESC, request_id, id LIMIT 100",
    "t4_usage_from_responses": f"""
      SELECT doc_id AS request_id, 'offline-model' AS model_name,
             CAST(20 + quality AS INTEGER) AS input_tokens, CAST(5 + toxic AS INTEGER) AS output_tokens,
             CAST(25 + quality + toxic AS INTEGER) AS total_tokens,
             'evaluate_intelligence_gate' AS step_name, {NOW} AS created_at
      FROM labels WHERE doc_id % 8 <> 2
      UNION ALL SELECT request_id, 'offline-model', p_size * 10, p_size, p_size * 11,
             'spawn_fallback_agent', {NOW} FROM fills WHERE k <> 3""",
    "u1_update_leads": f"""
      SELECT request_id, coalesce(u.status, l.status) AS status,
             coalesce(u.enriched_data, l.enriched_data) AS enriched_data, created_at,
             CASE WHEN u.status IS NULL THEN updated_at ELSE {NOW} END AS updated_at
      FROM leads l LEFT JOIN (
        SELECT request_id, CASE flag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed'
                           ELSE 'processing' END AS status,
               CASE WHEN flag = 'A' THEN 'part ' || part END AS enriched_data FROM (
          SELECT l_orderkey * 2 AS request_id,
                 arg_max(l_returnflag, (l_shipdate, l_partkey, l_linenumber)) AS flag,
                 arg_max(l_partkey, (l_shipdate, l_partkey, l_linenumber)) AS part
          FROM lineitem GROUP BY 1)) u USING (request_id)""",
    "u2_cascade_delete": """
      SELECT 'leads' AS table_name, request_id AS key, count(*) AS n FROM leads
      WHERE request_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2
      UNION ALL SELECT 'logs', request_id, count(*) FROM logs
      WHERE request_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IN (SELECT id FROM leads)) GROUP BY 2
      UNION ALL SELECT 'usage', request_id, count(*) FROM tokens
      WHERE request_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IN (SELECT id FROM leads)) GROUP BY 2
      UNION ALL SELECT 'embeddings', vec_id, count(*) FROM embeddings
      WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IN (SELECT id FROM leads)) GROUP BY 2""",
    "c1_sorted_listing": """
      SELECT id, setting_key, setting_value FROM config
      UNION ALL SELECT count(*), '(total)', NULL FROM config""",
    "c2_upsert": """
      SELECT coalesce(c.id, (SELECT max(id) FROM config) + rank) AS id,
             coalesce(c.setting_key, n.setting_key) AS setting_key,
             coalesce(n.setting_value, c.setting_value) AS setting_value
      FROM config c FULL JOIN changes n ON c.setting_key = n.setting_key
      LEFT JOIN (SELECT setting_key AS new_key, row_number() OVER (ORDER BY setting_key) AS rank
                 FROM changes WHERE setting_key NOT IN (SELECT setting_key FROM config))
             ON n.setting_key = new_key""",
    "c3_update_existing": """
      SELECT 'table' AS part, c.setting_key,
             coalesce(n.setting_value, c.setting_value) AS setting_value
      FROM config c LEFT JOIN changes n ON c.setting_key = n.setting_key
      UNION ALL SELECT 'not found', setting_key, NULL FROM changes
      WHERE setting_key NOT IN (SELECT setting_key FROM config)""",
    "c4_delete_keys": """
      SELECT 'table' AS part, setting_key, setting_value FROM config
      WHERE setting_key NOT IN (SELECT setting_key FROM changes)
      UNION ALL SELECT 'not found', setting_key, NULL FROM changes
      WHERE setting_key NOT IN (SELECT setting_key FROM config)""",
    "r1s_stream_intake": """
      SELECT o_orderkey AS request_id,
             CASE o_orderkey % 6 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Company ' || o_custkey END
               AS company_name, o_orderdate AS created_at,
             CASE o_orderkey % 6 WHEN 1 THEN 'company_name:too_short'
                  WHEN 2 THEN 'raw_input:not_an_object' ELSE '' END AS errors FROM orders""",
    "r2s_stream_dedup": "SELECT event_id AS request_id, ts AS created_at, event_type FROM events",
    "r4s_stream_status": """
      SELECT request_id, arg_max(step_name, (timestamp, id)) AS step,
             arg_max(status, (timestamp, id)) AS status, max(timestamp) AS timestamp
      FROM step_events GROUP BY request_id""",
    "r5s_stream_monitor": """
      SELECT request_id, id, step_name, status, timestamp, closed, run,
             row_number() OVER (PARTITION BY request_id, run ORDER BY timestamp, id) AS place,
             min(timestamp) OVER (PARTITION BY request_id, run) AS opened_at
      FROM (
        SELECT *, CAST(1 + coalesce(sum(CAST(closed AS INTEGER)) OVER (
                 PARTITION BY request_id ORDER BY timestamp, id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run
        FROM (
          SELECT *, status = 'failed'
                 OR (step_name = 'save_final_lineage' AND status = 'success') AS closed
          FROM step_events)) """,
    "r6s_stream_status_counts": "SELECT status, count(*) AS leads FROM leads GROUP BY status",
    "r6s_stream_usage_totals": """
      SELECT CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
             CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
             CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
             count(DISTINCT request_id) AS total_requests FROM tokens""",
}

# -- step logs: one branch per possible row, numbered within the request -----

_LOG_COLUMNS = ("company_name", "error", "has_gaps", "had_fallback", "total_fields", "reason",
                "sources_queried", "fields_populated", "missing_fields", "fields_filled")


def _log_rows() -> str:
    valid, needs = "valid", "needs"
    filled = "fill_error IS NULL"
    # (place, step, status, condition, payload columns)
    rows = [
        (0, "validate_input", "started", "true", {}),
        (1, "validate_input", "success", valid, {"company_name": "asked_name"}),
        (2, "validate_input", "failed", f"NOT {valid}", {"error": "errors"}),
        (3, "fetch_apis", "started", valid, {}),
        (4, "fetch_apis", "success", valid,
         {"sources_queried": shown("api_sources"), "fields_populated": shown("populated")}),
        (5, "evaluate_intelligence_gate", "started", valid, {}),
        (6, "evaluate_intelligence_gate", "success", f"{valid} AND {needs}",
         {"has_gaps": "'true'", "missing_fields": shown("missing_fields")}),
        (6, "evaluate_intelligence_gate", "success", f"{valid} AND NOT {needs}", {}),
        (7, "spawn_fallback_agent", "started", needs, {}),
        (8, "spawn_fallback_agent", "success", f"{needs} AND {filled}",
         {"fields_filled": "fields_filled"}),
        (9, "spawn_fallback_agent", "failed", f"{needs} AND NOT {filled}", {"error": "fill_error"}),
        (10, "spawn_fallback_agent", "skipped", f"{valid} AND NOT {needs}",
         {"reason": "'No data gaps detected'"}),
        (11, "save_final_lineage", "started", f"{valid} AND {filled}", {}),
        (12, "save_final_lineage", "success", f"{valid} AND {filled}",
         {"had_fallback": "CAST(had_fallback AS VARCHAR)",
          "total_fields": "CAST(total_fields AS VARCHAR)"}),
    ]
    parts = []
    for place, step, status, when, shown_columns in rows:
        columns = ", ".join(
            f"CAST({shown_columns.get(c, 'NULL')} AS VARCHAR) AS {c}" for c in _LOG_COLUMNS
        )
        parts.append(
            f"SELECT request_id, {place} AS place, '{step}' AS step_name, '{status}' AS status, "
            f"{'true' if shown_columns else 'false'} AS has_payload, {columns} "
            f"FROM told WHERE {when}"
        )
    return "\nUNION ALL ".join(parts)


CTES["filled_names"] = f"""
      SELECT request_id AS filled_id, {text_list(
        [f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in FIELDS if f != 'company_name'])}
        AS fields_filled FROM fill_values WHERE usable"""
CTES["told"] = """
      SELECT outcome.*, fields_filled FROM outcome
      LEFT JOIN filled_names ON request_id = filled_id"""
CTES["log_rows"] = _log_rows()
_BODIES["e2_step_logs"] = f"""
      SELECT request_id,
        CAST(place AS INTEGER) AS seq,
        step_name, status, has_payload, error AS traceback, {', '.join(_LOG_COLUMNS)}
      FROM log_rows"""

_SUMMARY = ("array_to_string(list_filter(["
            "CASE WHEN company_name <> '' THEN 'Company: ' || company_name END, "
            "CASE WHEN industry <> '' THEN 'Industry: ' || industry END, "
            "CASE WHEN company_description <> '' THEN company_description END, "
            "CASE WHEN ceo_name <> '' THEN 'CEO: ' || ceo_name END, "
            "CASE WHEN employee_count <> 0 THEN 'Employees: ' || employee_count END, "
            "CASE WHEN funding_raised <> '' THEN 'Funding: ' || funding_raised END, "
            "CASE WHEN founding_year <> 0 THEN 'Founded: ' || founding_year END], "
            "lambda x: x IS NOT NULL), ' | ')")
_BODIES["x0_content_summary"] = f"""
      SELECT request_id, CASE WHEN valid AND fill_error IS NULL THEN {_SUMMARY}
                              ELSE 'No enrichment data available' END AS content_summary
      FROM outcome"""
_BODIES["x4_embedding_never_fails"] = f"""
      SELECT request_id AS lead_id, {_SUMMARY} AS content_summary, vec_id IS NULL AS is_zero
      FROM outcome LEFT JOIN embeddings ON request_id = vec_id
      WHERE valid AND fill_error IS NULL"""
_CHECKSUM = "list_sum(list_transform(embedding, lambda v, i: i * CAST(floor(CAST(v AS DOUBLE) * 1048576) AS BIGINT)))"
_BODIES["e1_embeddings"] = f"""
      SELECT x.*, CAST(CASE WHEN is_zero THEN 0 ELSE {_CHECKSUM} END AS BIGINT) AS checksum
      FROM ({_BODIES["x4_embedding_never_fails"]}) x LEFT JOIN embeddings ON lead_id = vec_id"""
_BODIES["a2_status_of_completed"] = """
      SELECT request_id,
             CASE WHEN valid AND fill_error IS NULL THEN 'completed' ELSE 'failed' END AS status
      FROM outcome"""
_BODIES["e1_usage"] = """
      SELECT request_id, 'evaluate_intelligence_gate' AS step_name,
             CAST(20 + quality AS INTEGER) AS input_tokens,
             CAST(5 + toxic AS INTEGER) AS output_tokens
      FROM gaps_requests JOIN requests r USING (request_id) JOIN labels ON doc_id = request_id
      WHERE r.errors = '' AND len(gaps) > 0 AND doc_id % 8 <> 2
      UNION ALL
      SELECT request_id, 'spawn_fallback_agent', p_size * 10, p_size
      FROM fills f JOIN outcome USING (request_id) WHERE needs AND f.k <> 3"""
CTES["stream_requests"] = """
      SELECT o_orderkey AS request_id, o_orderkey % 6 NOT IN (1, 2) AS valid,
             CASE o_orderkey % 6 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Company ' || o_custkey END
               AS company_name, CAST(NULL AS VARCHAR) AS company_domain FROM orders"""
CTES["merged_stream"] = _merged("stream_requests")
CTES["gaps_stream"] = _gaps("merged_stream")
CTES["final_stream"] = _final("gaps_stream", True)
_BODIES["r3s_stream_enrich"] = f"""
      SELECT request_id, CASE WHEN good THEN 'completed' ELSE 'failed' END AS status,
             CASE WHEN good THEN company_name END AS company_name,
             CASE WHEN good THEN industry END AS industry,
             CASE WHEN good THEN {shown('api_sources')} END AS api_sources,
             CASE WHEN good THEN had_fallback END AS had_fallback
      FROM (SELECT f.*, r.valid AND (missing_fields IS NULL OR had_fallback) AS good
            FROM final_stream f JOIN stream_requests r USING (request_id))"""
_BODIES["s1_intake"] = f"""
      SELECT o_orderkey AS id, o_orderkey AS request_id, CASE o_orderkey % 23
        WHEN 1 THEN '{{"company_domain": "a.example.com"}}'
        WHEN 2 THEN '{{"company_name": null}}' WHEN 3 THEN '{{"company_name": ""}}'
        WHEN 4 THEN '{{"company_name": ' || o_custkey || '}}'
        WHEN 5 THEN '{{"company_name": "' || repeat('n', 256) || '"}}'
        WHEN 6 THEN '{{"company_name": "' || repeat('n', 257) || '"}}'
        WHEN 7 THEN '{{"company_name": "' || c_name || '", "company_domain": "' ||
                    repeat('d', 513) || '"}}'
        WHEN 8 THEN '{{"company_name": "' || c_name || '", "additional_context": ["x"]}}'
        WHEN 9 THEN '{{"company_name": "' || c_name || '", "additional_context": {{"priority": "'
                    || o_orderpriority || '"}}}}'
        WHEN 10 THEN 'request ' || o_orderkey WHEN 11 THEN '["' || c_name || '"]'
        WHEN 12 THEN '{{"company_name": "' || c_name || '", "company_domain": null}}'
        WHEN 13 THEN '{{"company_name": " "}}'
        WHEN 14 THEN '{{"company_name": "' || c_name || '", "company_domain": ""}}'
        ELSE '{{"company_name": "' || c_name || '"' ||
             coalesce(', "company_domain": "' || {DOMAIN} || '"', '') || '}}' END AS raw_input,
        'pending' AS status, {NOW} AS created_at
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
_BODIES["q5_recent_of_completed"] = f"""
      SELECT request_id, coalesce(CASE WHEN json_valid(raw_input)
               THEN json_extract_string(raw_input, '$.company_name') END, 'Unknown') AS company,
             CASE WHEN valid AND fill_error IS NULL THEN 'completed' ELSE 'failed' END AS status,
             outcome.created_at AS created_at
      FROM outcome JOIN ({_BODIES["s1_intake"]}) intake USING (request_id)
      ORDER BY outcome.created_at DESC, request_id LIMIT 10"""

_BODIES["a3_step_runs"] = """
      SELECT request_id, step_name, CAST(run AS BIGINT) AS run, started_at, ended_at, status,
             round((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0, 3) AS seconds FROM (
        SELECT request_id, step_name, run, min(timestamp) FILTER (status = 'started') AS started_at,
               max(timestamp) FILTER (status <> 'started') AS ended_at,
               arg_max(status, (timestamp, id)) AS status
        FROM (
          SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY request_id, step_name ORDER BY timestamp, id) AS run
          FROM (
            SELECT *, status = 'started' OR coalesce(lag(status) OVER (
                     PARTITION BY request_id, step_name ORDER BY timestamp, id), 'none') <> 'started' AS opens
            FROM step_events))
        GROUP BY request_id, step_name, run)"""
_BODIES["c2_upsert_in_folders"] = _BODIES["c2_upsert"]
_BODIES["t2_from_daily_partials"] = _BODIES["t2_token_summary"]
_BODIES["s3_repeated_runs"] = """
      SELECT request_id, 2 * count(*) AS rows, 2 * count(*) AS ids FROM logs GROUP BY request_id"""
_BODIES["e1_changed_only"] = _BODIES["e1_complete_records"]
_BODIES["q2_deep_page"] = """
      SELECT part, request_id, company_name, status, created_at FROM (
        SELECT 'middle' AS part, *, row_number() OVER (ORDER BY created_at DESC, request_id) AS place,
               count(*) OVER () // 2 AS before, 200 AS rows FROM leads
        UNION ALL
        SELECT 'completed', *, row_number() OVER (ORDER BY created_at DESC, request_id),
               count(*) OVER () * 3 // 4, 50 FROM leads WHERE status = 'completed')
      WHERE place > before AND place <= before + rows"""
_BODIES["x2_pruned_rows"] = _BODIES["x2_nearest_rows"]
_DONE = "CASE WHEN valid AND fill_error IS NULL THEN 'completed' ELSE 'failed' END"
_GIVEN_NAME = """CASE WHEN json_valid(raw_input) THEN json_extract_string(raw_input, '$.company_name') END"""
CTES["streamed_leads"] = f"""
      SELECT request_id, {_GIVEN_NAME} AS company_name, {_DONE} AS status, outcome.created_at AS created_at
      FROM outcome JOIN ({_BODIES["s1_intake"]}) intake USING (request_id)"""
_BODIES["r3s_runs_of_stream"] = """
      SELECT request_id, r.company_name, r.status AS lead_status,
             count(*) OVER (PARTITION BY request_id) AS step_count, step_name, l.status AS log_status,
             true AS has_id
      FROM (SELECT * FROM streamed_leads ORDER BY created_at DESC, request_id LIMIT 50) r
      JOIN log_rows l USING (request_id)"""
_BODIES["r3s_detail_of_stream"] = f"""
      SELECT request_id, 'lead' AS kind, company_name AS name, status, CAST(NULL AS BIGINT) AS total_tokens,
             CAST(NULL AS BIGINT) AS bearers FROM streamed_leads
      UNION ALL SELECT request_id, 'log', step_name, status, NULL, 1 FROM log_rows
      UNION ALL SELECT request_id, 'usage', step_name, NULL, input_tokens + output_tokens, 1
             FROM ({_BODIES["e1_usage"]})"""
_BODIES["r3s_usage_of_stream"] = f"""
      SELECT CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
             CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
             CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS total_tokens,
             count(DISTINCT request_id) AS total_requests FROM ({_BODIES["e1_usage"]})"""
_BODIES["r3s_nearest_of_stream"] = f"""
      SELECT lead_id, content_summary, round(s, 4) AS similarity
      FROM (SELECT lead_id, content_summary, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
              (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s
            FROM ({_BODIES["x4_embedding_never_fails"]}) JOIN embeddings ON lead_id = vec_id)
      ORDER BY round(1 - s, 12), lead_id LIMIT 10"""

ORACLES = {name: sql(body) for name, body in _BODIES.items()}
