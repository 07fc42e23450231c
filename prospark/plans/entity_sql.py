"""The entity views again as plain SQL, for the side-by-side check."""

from __future__ import annotations

_VIEWS = {
    "organizations": "SELECT CAST(n_nationkey AS BIGINT) AS organization_id, n_name AS name FROM nation",
    "campaigns": """
        SELECT s_suppkey AS campaign_id, CAST(s_nationkey AS BIGINT) AS organization_id, s_name AS name,
               CASE s_suppkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'PAUSED' ELSE 'ARCHIVED' END AS status,
               TIMESTAMP '2023-01-01' + to_hours(CAST(s_suppkey AS INT)) AS created_at
        FROM supplier""",
    "users": "SELECT c_custkey AS user_id, c_name AS full_name FROM customer",
    "members": """
        SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS organization_id, 'owner' AS role,
               TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 50 AS INT)) AS joined_at FROM customer
        UNION ALL
        SELECT c_custkey, c_custkey % 25, 'member', TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INT))
        FROM customer WHERE c_nationkey <> c_custkey % 25""",
    "leads": """
        SELECT c_custkey AS lead_id, c_custkey AS crawl_target_id,
               CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS organization_id,
               CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 40 END AS campaign_id,
               c_name AS company_name, 'c' || c_custkey || '.example.com' AS domain,
               c_mktsegment AS industry, n_name AS geography,
               CASE c_custkey % 4 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '51-200' ELSE 'Unknown' END
                   AS estimated_company_size,
               coalesce(p_name, '') AS value_proposition, coalesce(text, '') AS company_summary,
               CAST(floor(greatest(c_acctbal, 0.0) / 100) AS INT) AS icp_score,
               (c_custkey % 101) / 100.0::DOUBLE AS confidence_score,
               CASE c_custkey % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'QUALIFIED'
                    WHEN 3 THEN 'CONTACTED' ELSE 'REJECTED' END AS status,
               TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
             LEFT JOIN part ON p_partkey = c_custkey LEFT JOIN documents ON doc_id = c_custkey""",
    "lead_embeddings": "SELECT vec_id AS lead_id, embedding FROM embeddings",
    "jobs": """
        SELECT o_orderkey AS job_id, o_custkey AS lead_id, CAST(c_nationkey AS BIGINT) AS organization_id,
               o_custkey % 40 AS campaign_id,
               CASE WHEN o_orderstatus = 'O' THEN 'QUEUED' WHEN o_orderstatus = 'P' THEN 'RUNNING'
                    WHEN o_orderkey % 4 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
               CASE o_orderkey % 3 WHEN 0 THEN 'CRAWL' WHEN 1 THEN 'QUALIFY' ELSE 'CRAWL_AND_QUALIFY' END AS job_type,
               'crawl:' || o_custkey AS idempotency_key, o_orderkey % 6 + 1 AS pages_crawled,
               o_orderkey % 5 = 0 AS embedding_reused,
               o_orderdate AS created_at, o_orderdate + to_days(CAST(o_orderkey % 30 AS INT)) AS ended_at
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "audits": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS audit_id,
               o_custkey AS lead_id, l_linestatus AS provider,
               l_returnflag AS model, CAST(floor(l_extendedprice) AS BIGINT) AS input_tokens,
               CAST(floor(l_quantity * 10) AS BIGINT) AS output_tokens, l_tax * 1000 AS latency_ms,
               l_shipdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "job_events": """
        SELECT event_id, user_id AS job_id, user_id % 25 AS organization_id,
               CASE event_type WHEN 'signup' THEN 'job_created' WHEN 'view' THEN 'page_crawled'
                    WHEN 'click' THEN 'qualification_started' WHEN 'purchase' THEN 'job_completed'
                    WHEN 'error' THEN 'job_failed' END AS event_type,
               CAST(floor(value) AS INT) AS progress, ts AS "timestamp"
        FROM events""",
    "events_status": """
        SELECT event_id, job_id, organization_id, event_type, "timestamp",
               least(greatest(progress, 0), 100) AS progress,
               CASE event_type WHEN 'job_created' THEN 'QUEUED' WHEN 'job_completed' THEN 'COMPLETED'
                    WHEN 'job_failed' THEN 'FAILED' WHEN 'job_cancelled' THEN 'CANCELLED' ELSE 'RUNNING' END AS status
        FROM job_events""",
    "usage_events": """
        SELECT user_id % 25 AS organization_id, CAST(ts AS DATE) AS date,
               CAST(event_type = 'signup' AS BIGINT) AS crawls,
               CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS pages_crawled,
               CAST(event_type = 'signup' AS BIGINT) AS leads_created,
               CAST(event_type = 'click' AS BIGINT) AS ai_qualifications,
               CAST(event_type = 'click' AS BIGINT) AS embeddings_generated,
               CAST(event_type = 'purchase' AS BIGINT) AS jobs_completed,
               CAST(event_type = 'error' AS BIGINT) AS jobs_failed,
               CASE event_type WHEN 'click' THEN 0.0008::DOUBLE WHEN 'purchase' THEN 0.001::DOUBLE
                    ELSE 0.0::DOUBLE END AS estimated_ai_cost
        FROM events""",
    "usage_daily": """
        SELECT organization_id, date, CAST(sum(crawls) AS BIGINT) AS crawls,
               CAST(sum(pages_crawled) AS BIGINT) AS pages_crawled, CAST(sum(leads_created) AS BIGINT) AS leads_created,
               CAST(sum(ai_qualifications) AS BIGINT) AS ai_qualifications,
               CAST(sum(embeddings_generated) AS BIGINT) AS embeddings_generated,
               CAST(sum(jobs_completed) AS BIGINT) AS jobs_completed, CAST(sum(jobs_failed) AS BIGINT) AS jobs_failed,
               round(sum(estimated_ai_cost), 4) AS estimated_ai_cost
        FROM usage_events GROUP BY organization_id, date""",
    "request_log": "SELECT event_id, 'site' || user_id AS domain, ts FROM events",
    "crawled_pages": """
        SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS target_id, url, html FROM pages""",
    "crawl_targets": """
        SELECT DISTINCT target_id, target_id AS domain,
               CASE WHEN length(target_id) % 10 <> 0 THEN length(target_id) % 25 END AS organization_id
        FROM crawled_pages""",
    "doc_pages": """
        SELECT doc_id AS page_id, source AS target_id, doc_id // 4 AS site_id, source || '.example.com' AS domain,
               'https://' || source || '.example.com/p/' || doc_id AS url, CAST(doc_id % 4 AS INT) AS depth,
               'Page ' || doc_id AS title, text AS content, n_chars
        FROM documents""",
    "signals": """
        SELECT doc_id AS signal_id, doc_id // 2 AS lead_id, source AS target_id, source || '.example.com' AS domain,
               'signal ' || doc_id AS signal,
               CASE WHEN doc_id % 10 = 3 THEN 'https://other.example.org/p/' || doc_id
                    WHEN doc_id % 10 = 7 THEN 'https://' || source || '.example.com/p/none'
                    ELSE 'https://' || source || '.example.com/p/' || doc_id END AS source_url,
               CASE WHEN doc_id % 2 = 0 THEN substr(d.text, 10, 60) ELSE b.text END AS evidence,
               CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'Negative' ELSE 'neutral' END AS sentiment
        FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40""",
    "quotes": "SELECT item_id AS quote_id, text AS evidence FROM benchmark",
}

_NEEDS = {
    "events_status": ["job_events"],
    "usage_daily": ["usage_events"],
    "crawl_targets": ["crawled_pages"],
}


def over(views: str, body: str) -> str:
    """`body` with the named entity views (space separated) in front of it."""
    ordered: list[str] = []
    for name in views.split():
        for part in [*_NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in ordered) + "\n" + body
