"""Tenant scopes, lead lists, joins and reports as named queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from prospark import rules
from prospark.operators import analytics as an
from prospark.operators import leads as ld
from prospark.operators import scope as sc
from prospark.operators.scope import LeadFilter
from prospark.plans.entity_sql import over
from prospark.plans.registry import query
from prospark.session import cut_lineage

ORG = 3
FILTER = LeadFilter(min_icp_score=20, max_icp_score=95, industry="mach", organization_id=ORG)
FILTER_SQL = "(organization_id = 3 OR organization_id IS NULL) AND icp_score >= 20 AND icp_score <= 95 AND industry ILIKE '%mach%'"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def text_time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "scan_entities",
    over(
        "organizations campaigns users members leads lead_embeddings jobs audits job_events crawled_pages signals",
        """SELECT 'organizations' AS entity, count(*) AS n, CAST(sum(organization_id) AS BIGINT) AS key_sum FROM organizations
        UNION ALL SELECT 'campaigns', count(*), CAST(sum(campaign_id) AS BIGINT) FROM campaigns
        UNION ALL SELECT 'users', count(*), CAST(sum(user_id) AS BIGINT) FROM users
        UNION ALL SELECT 'members', count(*), CAST(sum(user_id) AS BIGINT) FROM members
        UNION ALL SELECT 'leads', count(*), CAST(sum(icp_score) AS BIGINT) FROM leads
        UNION ALL SELECT 'lead_embeddings', count(*), CAST(sum(lead_id) AS BIGINT) FROM lead_embeddings
        UNION ALL SELECT 'jobs', count(*), CAST(sum(job_id) AS BIGINT) FROM jobs
        UNION ALL SELECT 'audits', count(*), CAST(sum(input_tokens) AS BIGINT) FROM audits
        UNION ALL SELECT 'job_events', count(*), CAST(sum(job_id) AS BIGINT) FROM job_events
        UNION ALL SELECT 'crawled_pages', count(*), CAST(sum(page_id) AS BIGINT) FROM crawled_pages
        UNION ALL SELECT 'signals', count(*), CAST(sum(signal_id) AS BIGINT) FROM signals""",
    ),
)
def scan_entities(e):
    keys = {
        "organizations": "organization_id", "campaigns": "campaign_id", "users": "user_id", "members": "user_id",
        "leads": "icp_score", "lead_embeddings": "lead_id", "jobs": "job_id", "audits": "input_tokens",
        "job_events": "job_id", "crawled_pages": "page_id", "signals": "signal_id",
    }
    parts = [
        getattr(e, name)().agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(key).cast("bigint")).alias("key_sum"))
        .select(F.lit(name).alias("entity"), "n", "key_sum")
        for name, key in keys.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "scope_tenant_shared",
    over("leads", "SELECT lead_id, organization_id FROM leads WHERE organization_id = 3 OR organization_id IS NULL"),
)
def scope_tenant_shared(e):
    return sc.scope_tenant(e.leads(texts=False), ORG, shared=True).select("lead_id", "organization_id")


@query(
    "scope_tenant_strict",
    over("leads", "SELECT lead_id, organization_id FROM leads WHERE organization_id = 3"),
)
def scope_tenant_strict(e):
    return sc.scope_tenant(e.leads(texts=False), ORG, shared=False).select("lead_id", "organization_id")


@query("filter_leads", over("leads", f"SELECT lead_id, icp_score, industry FROM leads WHERE {FILTER_SQL}"))
def filter_leads(e):
    return sc.filter_leads(e.leads(texts=False), FILTER).select("lead_id", "icp_score", "industry")


@query(
    "search_leads_text",
    over(
        "leads",
        """SELECT lead_id, company_name FROM leads WHERE company_name ILIKE '%ring%' OR domain ILIKE '%ring%'
        OR industry ILIKE '%ring%' OR company_summary ILIKE '%ring%' OR value_proposition ILIKE '%ring%'""",
    ),
)
def search_leads_text(e):
    return sc.filter_leads(e.leads(), LeadFilter(search=" ring ")).select("lead_id", "company_name")


LIST_SQL = f"""SELECT lead_id, crawl_target_id, company_name, domain, industry, company_summary, value_proposition,
    icp_score, confidence_score, geography, estimated_company_size, status, {TS.format('created_at')} AS created_at"""


@query("project_lead_list", over("leads", f"{LIST_SQL} FROM leads"))
def project_lead_list(e):
    return e.leads().select(*[text_time(c) if c == "created_at" else c for c in ld.rules.LIST_COLUMNS])


@query(
    "list_leads",
    over(
        "leads",
        f"{LIST_SQL} FROM leads WHERE {FILTER_SQL} ORDER BY leads.icp_score DESC, lead_id LIMIT 10 OFFSET 10",
    ),
)
def list_leads(e):
    page = ld.list_leads(e.leads(), FILTER, "icp_score", "desc", page=2, page_size=10)
    return page.withColumn("created_at", text_time("created_at"))


@query(
    "leads_total",
    over(
        "leads",
        f"SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM leads WHERE {FILTER_SQL}",
    ),
)
def leads_total(e):
    return ld.leads_total(e.leads(texts=False), FILTER)


@query(
    "rank_relational",
    over(
        "leads",
        f"{LIST_SQL} FROM leads WHERE {FILTER_SQL} ORDER BY icp_score DESC, leads.created_at DESC, lead_id LIMIT 150",
    ),
)
def rank_relational(e):
    return ld.rank_relational(e.leads(), FILTER, k=150).withColumn("created_at", text_time("created_at"))


EXPORT_SQL = """SELECT company_name, domain, industry, geography, icp_score, confidence_score, status,
    company_summary, value_proposition FROM leads WHERE icp_score >= 10
    ORDER BY icp_score DESC, created_at DESC, lead_id LIMIT 1000"""


@query("export_leads_csv", over("leads", EXPORT_SQL))
def export_leads_csv(e):
    return ld.export_leads(e.leads(), LeadFilter(min_icp_score=10), rules.EXPORT_LIMIT)


@query(
    "export_leads_json",
    over(
        "leads",
        f"""SELECT '{{"company_name":' || to_json(company_name) || ',"domain":' || to_json(domain)
        || ',"industry":' || to_json(industry) || ',"geography":' || to_json(geography)
        || ',"icp_score":' || icp_score || ',"confidence_score":' || confidence_score
        || ',"status":' || to_json(status) || ',"company_summary":' || to_json(company_summary)
        || ',"value_proposition":' || to_json(value_proposition) || '}}' AS lead FROM ({EXPORT_SQL})""",
    ),
)
def export_leads_json(e):
    return ld.export_json(ld.export_leads(e.leads(), LeadFilter(min_icp_score=10), rules.EXPORT_LIMIT))


@query(
    "filter_active_jobs",
    over("jobs", "SELECT job_id, status, organization_id FROM jobs WHERE status IN ('QUEUED', 'RUNNING')"),
)
def filter_active_jobs(e):
    return sc.active_jobs(e.jobs()).select("job_id", "status", "organization_id")


AS_OF = "2024-02-10"


@query(
    "filter_recent_usage",
    over(
        "usage_daily",
        f"""SELECT organization_id, CAST(date AS VARCHAR) AS date, crawls, jobs_failed FROM usage_daily
        WHERE date >= DATE '{AS_OF}' - 30""",
    ),
)
def filter_recent_usage(e):
    daily = an.sum_usage(e.usage_events())
    rows = sc.recent_usage(daily, AS_OF)
    return rows.select("organization_id", F.col("date").cast("string").alias("date"), "crawls", "jobs_failed")


@query(
    "usage_timeline",
    over(
        "usage_daily",
        f"""SELECT organization_id, CAST(date AS VARCHAR) AS date, crawls, pages_crawled, leads_created,
        ai_qualifications, embeddings_generated, jobs_completed, jobs_failed, estimated_ai_cost
        FROM usage_daily WHERE date >= DATE '{AS_OF}' - 30""",
    ),
)
def usage_timeline(e):
    rows = an.usage_timeline(an.sum_usage(e.usage_events()), AS_OF)
    return rows.withColumn("date", F.col("date").cast("string"))


USAGE_COLS = """organization_id, CAST(date AS VARCHAR) AS date, crawls, pages_crawled, leads_created,
    ai_qualifications, embeddings_generated, jobs_completed, jobs_failed, estimated_ai_cost"""


@query("record_usage", over("usage_daily", f"SELECT {USAGE_COLS} FROM usage_daily"))
def record_usage(e):
    rows = e.usage_events()
    cut = F.lit("2024-01-15").cast("date")
    existing = an.sum_usage(rows.filter(F.col("date") < cut))
    return an.record_usage(existing, rows.filter(F.col("date") >= cut)).withColumn("date", F.col("date").cast("string"))


@query(
    "usage_rollup",
    over(
        "jobs",
        """SELECT organization_id, CAST(CAST(ended_at AS DATE) AS VARCHAR) AS date,
        count(*) FILTER (status = 'COMPLETED' AND job_type <> 'QUALIFY') AS crawls,
        CAST(coalesce(sum(pages_crawled) FILTER (status = 'COMPLETED' AND job_type <> 'QUALIFY'), 0) AS BIGINT) AS pages_crawled,
        count(*) FILTER (status = 'COMPLETED' AND job_type <> 'CRAWL') AS leads_created,
        count(*) FILTER (status = 'COMPLETED' AND job_type <> 'CRAWL') AS ai_qualifications,
        count(*) FILTER (status = 'COMPLETED' AND job_type <> 'CRAWL' AND NOT embedding_reused) AS embeddings_generated,
        count(*) FILTER (status = 'COMPLETED') AS jobs_completed, count(*) FILTER (status = 'FAILED') AS jobs_failed,
        round(coalesce(sum(CASE job_type WHEN 'QUALIFY' THEN 0.0008::DOUBLE WHEN 'CRAWL_AND_QUALIFY' THEN 0.001::DOUBLE
            ELSE 0.0 END) FILTER (status = 'COMPLETED'), 0), 4) AS estimated_ai_cost
        FROM jobs WHERE status IN ('COMPLETED', 'FAILED') AND organization_id IS NOT NULL
        GROUP BY organization_id, CAST(ended_at AS DATE)""",
    ),
)
def usage_rollup(e):
    return an.usage_rollup(e.jobs()).withColumn("date", F.col("date").cast("string"))


@query(
    "lookup_by_id",
    over(
        "jobs leads",
        """SELECT 'job' AS kind, job_id AS id, status FROM jobs WHERE job_id IN (5, 77, 901, 4000)
        AND (organization_id = 3 OR organization_id IS NULL)
        UNION ALL SELECT 'lead', lead_id, status FROM leads WHERE lead_id IN (3, 10, 20, 101)
        AND (organization_id = 3 OR organization_id IS NULL)""",
    ),
)
def lookup_by_id(e):
    job = sc.lookup(e.jobs(), "job_id", [5, 77, 901, 4000], ORG)
    lead = sc.lookup(e.leads(texts=False), "lead_id", [3, 10, 20, 101], ORG)
    return job.select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), "status").unionByName(
        lead.select(F.lit("lead").alias("kind"), F.col("lead_id").alias("id"), "status")
    )


@query(
    "join_lead_embedding",
    over(
        "leads lead_embeddings",
        "SELECT lead_id, industry, len(embedding) AS dimension FROM leads JOIN lead_embeddings USING (lead_id)",
    ),
)
def join_lead_embedding(e):
    from prospark.operators.search import join_lead_embedding as join

    return join(e.leads(texts=False), e.lead_embeddings()).select("lead_id", "industry", F.size("embedding").cast("bigint").alias("dimension"))


@query(
    "join_pages_target",
    over(
        "crawl_targets",
        """SELECT page_id, domain, organization_id FROM crawled_pages JOIN crawl_targets USING (target_id)
        WHERE organization_id IS NOT NULL""",
    ),
)
def join_pages_target(e):
    pages = e.crawled_pages().select("page_id", "target_id")
    joined = an.join_pages_target(pages, e.crawl_targets()).filter("organization_id IS NOT NULL")
    return joined.select("page_id", "domain", "organization_id")


@query(
    "join_audit_lead",
    over(
        "audits leads",
        """SELECT audit_id, lead_id, organization_id, input_tokens, output_tokens
        FROM audits JOIN leads USING (lead_id)""",
    ),
)
def join_audit_lead(e):
    rows = an.join_audit_lead(e.audits(), e.leads(texts=False))
    return rows.select("audit_id", "lead_id", "organization_id", "input_tokens", "output_tokens")


@query(
    "join_campaign_leads_outer",
    over(
        "campaigns leads",
        """SELECT c.campaign_id, count(lead_id) AS leads, CAST(coalesce(sum(icp_score), 0) AS BIGINT) AS score_sum
        FROM campaigns c LEFT JOIN leads l ON l.campaign_id = c.campaign_id GROUP BY c.campaign_id""",
    ),
)
def join_campaign_leads_outer(e):
    rows = an.join_campaign_leads_outer(e.campaigns(), e.leads(texts=False))
    return rows.groupBy("campaign_id").agg(
        F.count("lead_id").alias("leads"), F.coalesce(F.sum("icp_score"), F.lit(0)).alias("score_sum")
    )


@query(
    "join_membership",
    over(
        "users members organizations",
        f"""SELECT m.user_id, full_name, m.organization_id, o.name AS organization_name, role,
        {TS.format('joined_at')} AS joined_at,
        row_number() OVER (PARTITION BY m.user_id ORDER BY joined_at, m.organization_id) = 1 AS is_primary
        FROM members m JOIN users u USING (user_id) JOIN organizations o ON o.organization_id = m.organization_id""",
    ),
)
def join_membership(e):
    return an.memberships(e.users(), e.members(), e.organizations()).withColumn("joined_at", text_time("joined_at"))


@query(
    "lead_dossier",
    over(
        "leads signals doc_pages audits lead_embeddings",
        """SELECT lead_id, 'signals' AS section, CAST(0 AS BIGINT) AS part, count(*) AS n_items,
            string_agg(signal_id::VARCHAR, ',' ORDER BY signal_id) AS item_ids FROM signals
            WHERE lead_id IN (SELECT lead_id FROM leads) GROUP BY lead_id
        UNION ALL SELECT l.lead_id, 'pages', 0, count(*), string_agg(page_id::VARCHAR, ',' ORDER BY depth, page_id)
            FROM leads l JOIN doc_pages p ON p.site_id = l.crawl_target_id GROUP BY l.lead_id
        UNION ALL SELECT lead_id, 'audits', 0, count(*), string_agg(audit_id, ',' ORDER BY created_at DESC, audit_id)
            FROM audits WHERE lead_id IN (SELECT lead_id FROM leads) GROUP BY lead_id
        UNION ALL SELECT lead_id, 'embedding', 0, 1, len(embedding)::VARCHAR FROM lead_embeddings
            WHERE lead_id IN (SELECT lead_id FROM leads)
        UNION ALL SELECT lead_id, 'lead', 0, 1, lead_id::VARCHAR FROM leads""",
    ),
)
def lead_dossier(e):
    parts = ld.lead_dossier(e.leads(), e.signals(), e.doc_pages(), e.lead_embeddings(), e.audits())
    item_id = lambda x: F.coalesce(
        *[F.get_json_object(x, f"$.{k}") for k in ("signal_id", "page_id", "audit_id", "dimension", "lead_id")]
    )
    return parts.select(
        "lead_id",
        "section",
        "part",
        F.size("items").cast("bigint").alias("n_items"),
        F.array_join(F.transform("items", item_id), ",").alias("item_ids"),
    )


OVERVIEW_SQL = over(
    "organizations leads crawl_targets jobs audits",
    """SELECT o.organization_id, o.name, coalesce(total_leads, 0) AS total_leads,
        coalesce(qualified_leads, 0) AS qualified_leads, coalesce(total_crawls, 0) AS total_crawls,
        coalesce(pages_crawled, 0) AS pages_crawled, coalesce(jobs_completed, 0) AS jobs_completed,
        coalesce(jobs_failed, 0) AS jobs_failed, coalesce(estimated_ai_cost, 0.0) AS estimated_ai_cost,
        coalesce(round(qualified_leads * 100.0::DOUBLE / nullif(total_leads, 0), 1), 0.0) AS qualification_rate
    FROM organizations o
    LEFT JOIN (SELECT organization_id, count(*) AS total_leads, count(*) FILTER (icp_score >= 50) AS qualified_leads
               FROM leads GROUP BY 1) l USING (organization_id)
    LEFT JOIN (SELECT organization_id, count(*) AS total_crawls FROM crawl_targets GROUP BY 1) t USING (organization_id)
    LEFT JOIN (SELECT organization_id, count(*) AS pages_crawled FROM crawled_pages JOIN crawl_targets USING (target_id)
               GROUP BY 1) p USING (organization_id)
    LEFT JOIN (SELECT organization_id, count(*) FILTER (status = 'COMPLETED') AS jobs_completed,
               count(*) FILTER (status = 'FAILED') AS jobs_failed FROM jobs GROUP BY 1) j USING (organization_id)
    LEFT JOIN (SELECT organization_id, round(CAST(sum(input_tokens) AS BIGINT) * 0.00000015::DOUBLE
               + CAST(sum(output_tokens) AS BIGINT) * 0.0000006::DOUBLE, 4) AS estimated_ai_cost
               FROM audits JOIN leads USING (lead_id) GROUP BY 1) a USING (organization_id)""",
)


@query("org_overview", OVERVIEW_SQL)
def org_overview(e):
    return an.org_overview(
        e.organizations(), e.leads(texts=False), e.crawl_targets(), e.crawled_pages(), e.jobs(), e.audits()
    )


@query(
    "count_qualified",
    over(
        "leads",
        """SELECT organization_id, count(*) AS total_leads, count(*) FILTER (icp_score >= 50) AS qualified_leads
        FROM leads WHERE organization_id IS NOT NULL GROUP BY organization_id""",
    ),
)
def count_qualified(e):
    return an.count_qualified(e.leads(texts=False))


@query(
    "qualification_rate",
    over(
        "leads",
        """SELECT organization_id, round(count(*) FILTER (icp_score >= 50) * 100.0::DOUBLE / count(*), 1)
        AS qualification_rate FROM leads WHERE organization_id IS NOT NULL GROUP BY organization_id""",
    ),
)
def qualification_rate(e):
    return an.qualification_rate(e.leads(texts=False))


@query(
    "job_outcome_counts",
    over(
        "jobs",
        """SELECT organization_id, count(*) FILTER (status = 'COMPLETED') AS jobs_completed,
        count(*) FILTER (status = 'FAILED') AS jobs_failed FROM jobs WHERE organization_id IS NOT NULL
        GROUP BY organization_id""",
    ),
)
def job_outcome_counts(e):
    return an.job_outcomes(e.jobs())


@query(
    "job_success_rate",
    over(
        "jobs",
        """SELECT organization_id, coalesce(round(count(*) FILTER (status = 'COMPLETED') * 100.0::DOUBLE
        / nullif(count(*) FILTER (status IN ('COMPLETED', 'FAILED')), 0), 1), 100.0) AS job_success_rate
        FROM jobs WHERE organization_id IS NOT NULL GROUP BY organization_id""",
    ),
)
def job_success_rate(e):
    return an.job_success_rate(e.jobs())


@query(
    "ai_cost",
    over(
        "audits leads",
        """SELECT organization_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
        round(CAST(sum(input_tokens) AS BIGINT) * 0.00000015::DOUBLE
            + CAST(sum(output_tokens) AS BIGINT) * 0.0000006::DOUBLE, 4) AS estimated_ai_cost
        FROM audits JOIN leads USING (lead_id) WHERE organization_id IS NOT NULL GROUP BY organization_id""",
    ),
)
def ai_cost(e):
    return an.token_cost(e.audits(), e.leads(texts=False))


CAMPAIGN_SQL = """SELECT c.organization_id, c.campaign_id, c.name, c.status, strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
    count(lead_id) AS total_leads, count(*) FILTER (icp_score >= 50) AS qualified_leads,
    round(coalesce(avg(icp_score), 0.0), 1) AS avg_icp_score,
    coalesce(round(count(*) FILTER (icp_score >= 50) * 100.0::DOUBLE / nullif(count(lead_id), 0)), 0.0) AS qualified_pct
    FROM campaigns c LEFT JOIN leads l ON l.campaign_id = c.campaign_id
    GROUP BY c.organization_id, c.campaign_id, c.name, c.status, c.created_at"""


@query(
    "campaign_stats",
    over(
        "campaigns leads",
        f"""SELECT organization_id, campaign_id, name AS campaign_name, total_leads, avg_icp_score
        FROM ({CAMPAIGN_SQL})""",
    ),
)
def campaign_stats(e):
    return an.campaign_stats(e.campaigns(), e.leads(texts=False))


@query(
    "campaign_list",
    over(
        "campaigns leads",
        f"""SELECT organization_id, campaign_id, name, status, created_at, total_leads, qualified_leads
        FROM ({CAMPAIGN_SQL})""",
    ),
)
def campaign_list(e):
    rows = an.campaign_counts(e.campaigns(), e.leads(texts=False)).orderBy(F.desc("created_at"), "campaign_id")
    return rows.select(
        "organization_id", "campaign_id", "name", "status", text_time("created_at"), "total_leads", "qualified_leads"
    )


@query(
    "campaign_detail",
    over(
        "campaigns leads",
        f"""SELECT organization_id, campaign_id, name, total_leads, qualified_leads FROM ({CAMPAIGN_SQL})
        WHERE organization_id = 15 AND campaign_id = 0""",
    ),
)
def campaign_detail(e):
    one = sc.lookup(e.campaigns(), "campaign_id", [0], 15, shared=False)
    return an.campaign_counts(one, e.leads(texts=False)).select(
        "organization_id", "campaign_id", "name", "total_leads", "qualified_leads"
    )


@query("campaign_qual_rate", over("campaigns leads", f"SELECT campaign_id, qualified_pct FROM ({CAMPAIGN_SQL})"))
def campaign_qual_rate(e):
    return an.campaign_counts(e.campaigns(), e.leads(texts=False)).select("campaign_id", "qualified_pct")


@query(
    "industry_top10",
    over(
        "leads",
        """SELECT industry, count(*) AS leads FROM leads WHERE organization_id = 3
        GROUP BY industry ORDER BY leads DESC, industry LIMIT 10""",
    ),
)
def industry_top10(e):
    return an.industry_top(sc.scope_tenant(e.leads(texts=False), ORG, shared=False))


@query(
    "top_industries_per_org",
    over(
        "leads",
        """SELECT organization_id, industry, count(*) AS leads FROM leads WHERE organization_id IS NOT NULL
        GROUP BY organization_id, industry
        QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY count(*) DESC, industry) <= 5""",
    ),
)
def top_industries_per_org(e):
    return an.industry_top(e.leads(texts=False), n=5, per_org=True)


@query(
    "status_histogram",
    over(
        "leads",
        """SELECT organization_id, status, count(*) AS leads FROM leads WHERE organization_id IS NOT NULL
        GROUP BY organization_id, status""",
    ),
)
def status_histogram(e):
    return an.status_histogram(e.leads(texts=False))


@query(
    "quota_report",
    over(
        "organizations jobs usage_daily",
        f"""SELECT organization_id, coalesce(active_jobs, 0) AS active_jobs, coalesce(recent_crawls, 0) AS recent_crawls,
        coalesce(active_jobs, 0) >= 5 AS jobs_exceeded, coalesce(recent_crawls, 0) >= 100 AS crawls_exceeded
        FROM organizations
        LEFT JOIN (SELECT organization_id, count(*) AS active_jobs FROM jobs WHERE status IN ('QUEUED', 'RUNNING')
                   GROUP BY 1) USING (organization_id)
        LEFT JOIN (SELECT organization_id, CAST(sum(crawls) AS BIGINT) AS recent_crawls FROM usage_daily
                   WHERE date >= DATE '{AS_OF}' - 30 GROUP BY 1) USING (organization_id)""",
    ),
)
def quota_report(e):
    return an.quota_report(e.organizations(), e.jobs(), an.sum_usage(e.usage_events()), AS_OF)


@query(
    "lead_kpis",
    over(
        "leads",
        f"""SELECT count(*) FILTER (icp_score >= 80) AS strong_fit,
        count(*) FILTER (status IN ('NEW', 'REVIEW')) AS in_review,
        CAST(coalesce(round(avg(icp_score)), 0) AS BIGINT) AS avg_fit FROM leads WHERE {FILTER_SQL}""",
    ),
)
def lead_kpis(e):
    return ld.lead_kpis(e.leads(texts=False), FILTER)


@query(
    "fit_histogram",
    over(
        "leads",
        """SELECT CASE WHEN icp_score >= 80 THEN 'Strong Fit' WHEN icp_score >= 60 THEN 'Moderate' ELSE 'Low Fit' END
        AS band, count(*) AS leads FROM leads GROUP BY 1""",
    ),
)
def fit_histogram(e):
    return ld.fit_histogram(e.leads(texts=False))


@query(
    "signal_sentiment",
    over(
        "signals",
        """SELECT lead_id, count(*) FILTER (lower(sentiment) = 'positive') AS positive,
        count(*) FILTER (lower(sentiment) = 'negative') AS negative,
        count(*) FILTER (lower(sentiment) NOT IN ('positive', 'negative')) AS neutral FROM signals GROUP BY lead_id""",
    ),
)
def signal_sentiment(e):
    return ld.signal_sentiment(e.signals())


@query(
    "token_usage",
    over(
        "audits",
        """SELECT provider, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(avg(latency_ms), 2) AS avg_latency_ms,
        round(max(latency_ms), 2) AS max_latency_ms,
        round(arg_max(latency_ms, row(created_at, audit_id)), 2) AS last_latency_ms
        FROM audits GROUP BY provider, model""",
    ),
)
def token_usage(e):
    return an.token_usage(e.audits())


#: Spans of days of the latency report; a missing end is open.
SPANS = [("all", None, None), ("year", "1995-01-01", "1995-12-31"), ("quarter", "1996-04-01", "1996-06-30")]


@query(
    "latency_percentiles",
    over(
        "audits",
        """SELECT span, provider, model, count(*) AS timed_calls, round(quantile_disc(latency_ms, 0.5), 2) AS p50_ms,
        round(quantile_disc(latency_ms, 0.95), 2) AS p95_ms
        FROM audits JOIN (VALUES ('all', DATE '0001-01-01', DATE '9999-12-31'), ('year', DATE '1995-01-01', DATE '1995-12-31'),
            ('quarter', DATE '1996-04-01', DATE '1996-06-30')) v(span, first_day, last_day)
        ON CAST(created_at AS DATE) BETWEEN first_day AND last_day GROUP BY span, provider, model""",
    ),
)
def latency_percentiles(e):
    """Latency quantiles of several spans from one stored table of day sketches."""
    days = cut_lineage(an.latency_sketches(e.audits()))
    reports = [an.latency_percentiles(days, a, b).withColumn("span", F.lit(name)) for name, a, b in SPANS]
    return reduce(lambda x, y: x.unionByName(y), reports)
