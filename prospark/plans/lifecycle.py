"""Snapshot changes, job life cycle and usage limits as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospark.operators import analytics as an
from prospark.operators import jobs as jb
from prospark.operators import lifecycle as lc
from prospark.plans.entity_sql import over
from prospark.plans.registry import query
from prospark.plans.tenants import text_time

STATUSES = "['new', 'Qualified', 'CONTACTED', 'archived', 'review']"


LEAD_NAMES = [
    "lead_id", "crawl_target_id", "organization_id", "campaign_id", "company_name", "industry", "geography",
    "icp_score", "confidence_score", "status", "created_at",
]


def known_leads(e):
    """The leads, and a shared lead beside every tenth one that a tenant owns."""
    leads = e.leads(texts=False).select(*LEAD_NAMES)
    shared = leads.filter((F.col("crawl_target_id") % 10 == 0) & F.col("organization_id").isNotNull()).withColumns(
        {"lead_id": F.col("lead_id") + 2000000, "organization_id": F.lit(None).cast("bigint"), "company_name": F.lit("Shared")}
    )
    return leads.unionByName(shared)


def incoming_leads(e):
    """Fresh qualifications, one or two per part: of tenant 7 or none, and of tenants all over the place."""
    key = F.col("p_partkey")
    owners = F.array(F.when(key % 5 != 0, F.lit(7)).cast("bigint"), (key % 25).cast("bigint"))
    rows = e.table("part").select("*", F.explode(F.array_distinct(owners)).alias("organization_id"))
    return rows.select(
        key.alias("crawl_target_id"),
        (key + 1000000).alias("lead_id"),
        "organization_id",
        F.lit(5).cast("bigint").alias("campaign_id"),
        F.concat(F.lit("Fresh "), F.coalesce(F.col("organization_id").cast("string"), F.lit("-")), F.lit(" "), "p_name").alias("company_name"),
        F.col("p_type").alias("industry"),
        F.col("p_brand").alias("geography"),
        F.col("p_size").alias("icp_score"),
        F.round(F.col("p_size") / 100.0, 2).alias("confidence_score"),
        F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00")).alias("created_at"),
    )


@query(
    "upsert_leads",
    over(
        "leads",
        """, ex AS (SELECT lead_id, crawl_target_id, organization_id, campaign_id, company_name, industry, geography, icp_score,
             confidence_score, status, created_at FROM leads
           UNION ALL SELECT lead_id + 2000000, crawl_target_id, NULL, campaign_id, 'Shared', industry, geography, icp_score,
             confidence_score, status, created_at FROM leads WHERE crawl_target_id % 10 = 0 AND organization_id IS NOT NULL),
        inc AS (SELECT DISTINCT p_partkey, org, p_name, p_type, p_brand, p_size FROM (
             SELECT *, CASE WHEN p_partkey % 5 <> 0 THEN 7 END AS org FROM part
             UNION ALL SELECT *, p_partkey % 25 FROM part)),
        seen AS (SELECT inc.*, lead_id, row_number() OVER (PARTITION BY p_partkey, org ORDER BY organization_id IS NULL) AS k
             FROM inc LEFT JOIN ex ON crawl_target_id = p_partkey AND (organization_id IS NULL OR organization_id = org)),
        hit AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY org DESC NULLS LAST) AS last FROM seen
             WHERE k = 1 AND lead_id IS NOT NULL)
        SELECT ex.lead_id, crawl_target_id, organization_id, campaign_id,
             CASE WHEN last = 1 THEN 'Fresh ' || coalesce(CAST(org AS VARCHAR), '-') || ' ' || p_name ELSE company_name END AS company_name,
             CASE WHEN last = 1 THEN p_type ELSE industry END AS industry, CASE WHEN last = 1 THEN p_brand ELSE geography END AS geography,
             CASE WHEN last = 1 THEN p_size ELSE icp_score END AS icp_score,
             CASE WHEN last = 1 THEN round(p_size / 100.0::DOUBLE, 2) ELSE confidence_score END AS confidence_score, status,
             strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
        FROM ex LEFT JOIN hit ON ex.lead_id = hit.lead_id AND last = 1
        UNION ALL SELECT p_partkey + 1000000, p_partkey, org, 5, 'Fresh ' || coalesce(CAST(org AS VARCHAR), '-') || ' ' || p_name, p_type, p_brand,
             p_size, round(p_size / 100.0::DOUBLE, 2), 'NEW', '2024-06-01 00:00:00' FROM seen WHERE lead_id IS NULL""",
    ).replace("\n,", ","),
)
def upsert_leads(e):
    return lc.upsert_leads(known_leads(e), incoming_leads(e)).withColumn("created_at", text_time("created_at"))


def crawl_requests(e):
    """(existing targets, requests): own and shared targets of one URL, and requests of three tenants or none for each."""
    url = F.concat(F.lit("https://"), "target_id", F.lit("/"))
    size = F.length("target_id").cast("bigint")
    sites = e.crawled_pages().select("target_id").distinct()
    base = sites.select(url.alias("url"), url.alias("normalized_url"), F.col("target_id").alias("domain"), size.alias("size"))
    owners = F.array(F.when(F.col("size") % 3 != 0, F.col("size")), F.when(F.col("size") % 2 == 0, F.lit(3).cast("bigint")))
    existing = base.withColumn("organization_id", F.explode(F.array_distinct(owners))).select(
        "url", "normalized_url", "domain", F.lit("failed").alias("status"), F.lit("timeout").alias("error_message"), "organization_id", F.lit(1).alias("campaign_id")
    )
    askers = F.array(F.col("size"), F.lit(4).cast("bigint"), F.when(F.col("size") % 4 != 0, F.lit(5).cast("bigint")))
    incoming = base.filter(F.col("size") % 7 != 0).withColumn("organization_id", F.explode(F.array_distinct(askers))).select(
        "url", "normalized_url", "domain", "organization_id", F.when(F.col("organization_id") != 5, F.lit(9)).alias("campaign_id")
    )
    return existing, incoming


TARGETS_SQL = """, b AS (SELECT DISTINCT 'https://' || target_id || '/' AS nu, target_id AS domain, length(target_id) AS size FROM crawled_pages),
        ex AS (SELECT DISTINCT nu, domain, CASE WHEN size % 3 <> 0 THEN size END AS org FROM b
             UNION SELECT nu, domain, CASE WHEN size % 2 = 0 THEN 3 END FROM b),
        inc AS (SELECT nu, domain, org, CASE WHEN org <> 5 THEN 9 END AS camp FROM (SELECT nu, domain, size AS org FROM b WHERE size % 7 <> 0
             UNION SELECT nu, domain, 4 FROM b WHERE size % 7 <> 0
             UNION SELECT nu, domain, CASE WHEN size % 4 <> 0 THEN 5 END FROM b WHERE size % 7 <> 0))"""


@query(
    "upsert_targets",
    over(
        "crawled_pages",
        TARGETS_SQL
        + """, own AS (SELECT inc.nu, inc.org, camp FROM inc JOIN ex ON inc.nu = ex.nu AND inc.org IS NOT DISTINCT FROM ex.org),
        rest AS (SELECT inc.* FROM inc ANTI JOIN own ON inc.nu = own.nu AND inc.org IS NOT DISTINCT FROM own.org),
        taker AS (SELECT nu, org, camp FROM (SELECT nu, org, camp FROM own WHERE org IS NULL
             UNION ALL SELECT rest.nu, rest.org, camp FROM rest JOIN ex ON ex.nu = rest.nu AND ex.org IS NULL)
             QUALIFY row_number() OVER (PARTITION BY nu ORDER BY org NULLS LAST) = 1),
        upd AS (SELECT nu, org AS at, org, camp FROM own WHERE org IS NOT NULL UNION ALL SELECT nu, NULL, org, camp FROM taker)
        SELECT ex.nu AS normalized_url, domain, CASE WHEN upd.nu IS NULL THEN 'failed' ELSE 'in_progress' END AS status,
             CASE WHEN upd.nu IS NULL THEN 'timeout' END AS error_message, coalesce(ex.org, upd.org) AS organization_id,
             coalesce(camp, 1) AS campaign_id
        FROM ex LEFT JOIN upd ON ex.nu = upd.nu AND ex.org IS NOT DISTINCT FROM upd.at
        UNION ALL SELECT nu, domain, 'in_progress', NULL, org, camp FROM rest
             ANTI JOIN taker ON rest.nu = taker.nu AND rest.org IS NOT DISTINCT FROM taker.org""",
    ).replace("\n,", ","),
)
def upsert_targets(e):
    return lc.upsert_targets(*crawl_requests(e)).drop("url")


@query(
    "admit_targets_stored",
    over(
        "crawled_pages",
        """, b AS (SELECT DISTINCT target_id AS host, length(target_id) AS size FROM crawled_pages),
        ex AS (SELECT 'https://' || host || '/' AS nu, CASE WHEN size % 3 <> 0 THEN size END AS org FROM b
             UNION SELECT 'https://' || host || '/', CASE WHEN size % 2 = 0 THEN 3 END FROM b),
        r AS (SELECT size, 'https://' || CASE size % 4 WHEN 0 THEN host || '.internal' WHEN 1 THEN '10.1.2.' || size ELSE host END || '/' AS nu,
             CASE size % 4 WHEN 0 THEN 'local hostname' WHEN 1 THEN 'private or reserved address' END AS reason FROM b),
        req AS (SELECT nu, 2 AS org, reason FROM r UNION SELECT nu, size, reason FROM r),
        own AS (SELECT nu, req.org FROM req JOIN ex USING (nu) WHERE reason IS NULL AND req.org = ex.org),
        rest AS (SELECT nu, org FROM req WHERE reason IS NULL AND NOT EXISTS (FROM own WHERE own.nu = req.nu AND own.org = req.org)),
        taker AS (SELECT nu, min(rest.org) AS org FROM rest JOIN ex USING (nu) WHERE ex.org IS NULL GROUP BY nu),
        upd AS (SELECT nu, org AS at, org FROM own UNION ALL SELECT nu, NULL, org FROM taker)
        SELECT ex.nu AS normalized_url, coalesce(ex.org, upd.org) AS organization_id, CASE WHEN upd.nu IS NULL THEN 1 ELSE 9 END AS campaign_id,
             CASE WHEN upd.nu IS NULL THEN 'failed' ELSE 'in_progress' END AS outcome
        FROM ex LEFT JOIN upd ON ex.nu = upd.nu AND ex.org IS NOT DISTINCT FROM upd.at
        UNION ALL SELECT nu, org, 9, 'in_progress' FROM rest WHERE NOT EXISTS (FROM taker WHERE taker.nu = rest.nu AND taker.org = rest.org)
        UNION ALL SELECT nu, org, 9, reason FROM req WHERE reason IS NOT NULL""",
    ).replace("\n,", ","),
)
def admit_targets_stored(e):
    """The gate before all stored targets: own and shared ones are taken over, the rest stay as they are."""
    size = F.length("target_id")
    host = F.when(size % 4 == 0, F.concat("target_id", F.lit(".internal"))).when(size % 4 == 1, F.concat(F.lit("10.1.2."), size.cast("string"))).otherwise(F.col("target_id"))
    url = F.concat(F.lit("https://"), host, F.lit("/"))
    askers = F.array(F.lit(2).cast("bigint"), size.cast("bigint"))
    requests = e.crawled_pages().select(
        url.alias("url"), url.alias("normalized_url"), host.alias("domain"), F.explode(askers).alias("organization_id"), F.lit(9).alias("campaign_id")
    ).distinct()
    existing, _ = crawl_requests(e)
    after, refused = lc.admit_targets(existing, requests)
    names = ["normalized_url", "organization_id", "campaign_id"]
    return after.select(*names, F.col("status").alias("outcome")).unionByName(refused.select(*names, F.col("reason").alias("outcome")))


def known_signals(e):
    return e.signals().select("lead_id", "signal", "evidence", "source_url", "sentiment")


def fresh_signals(e):
    """One new signal for every labelled lead."""
    return e.table("labels").select(
        F.col("doc_id").alias("lead_id"),
        F.lit("label").alias("signal"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("evidence"),
        F.lit(None).cast("string").alias("source_url"),
        F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("sentiment"),
    )


@query(
    "replace_signals",
    over(
        "signals",
        """SELECT lead_id, signal, evidence, source_url, sentiment FROM signals
            WHERE lead_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT doc_id, 'label', 'quality ' || quality, NULL,
            CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END FROM labels""",
    ),
)
def replace_signals(e):
    new = fresh_signals(e)
    return lc.replace_signals(known_signals(e), new, new)


@query(
    "embedding_refresh_plan",
    """SELECT doc_id AS lead_id, CASE WHEN vec_id IS NULL THEN 'insert' WHEN label % 2 = 0 THEN 'reuse' ELSE 'update' END
    AS action, sha256(text) AS content_hash FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
def embedding_refresh_plan(e):
    docs = e.table("documents").select(F.col("doc_id").alias("lead_id"), F.sha2("text", 256).alias("content_hash"))
    vectors = e.table("embeddings").select("vec_id", "label")
    stored = docs.join(vectors, docs.lead_id == vectors.vec_id).select(
        "lead_id",
        F.when(F.col("label") % 2 == 0, F.col("content_hash")).otherwise("stale").alias("content_hash"),
    )
    return lc.embedding_refresh_plan(docs, stored)


def _changes(e):
    """Every order asks for a status of its customer's lead; several per lead, some of them invalid."""
    names = F.array(*[F.lit(x) for x in ["new", "Qualified", "CONTACTED", "archived", "review"]])
    return e.table("orders").select(
        F.col("o_custkey").alias("lead_id"),
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("new_status"),
        text_time("o_orderdate").alias("changed_at"),
    )


CHANGES_SQL = f""", ch AS (SELECT o_custkey AS lead_id, {STATUSES}[o_orderkey % 5 + 1] AS new_status,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS changed_at FROM orders),
    newest AS (SELECT lead_id, max(row(changed_at, upper(new_status))) AS r FROM ch WHERE new_status <> 'archived' GROUP BY lead_id)"""


@query(
    "update_lead_status",
    over(
        "leads",
        CHANGES_SQL
        + """ SELECT lead_id, CASE WHEN ok THEN r[2] ELSE status END AS status,
        CASE WHEN ok THEN r[1] WHEN lead_id % 2 = 0 THEN '1990-02-02 00:00:00' END AS updated_at, 'lead' AS kind, NULL AS reason FROM (
            SELECT leads.*, r, r IS NOT NULL AND (organization_id IS NOT DISTINCT FROM 3 OR organization_id IS NULL) AS ok
            FROM leads LEFT JOIN newest USING (lead_id))
        UNION ALL SELECT lead_id, new_status, changed_at, 'refused',
            CASE WHEN new_status = 'archived' THEN 'invalid status' ELSE 'not found' END FROM ch
            WHERE new_status = 'archived' OR lead_id NOT IN (SELECT lead_id FROM leads
                WHERE organization_id = 3 OR organization_id IS NULL)""",
    ),
)
def update_lead_status(e):
    leads = e.leads(texts=False).withColumn("updated_at", F.when(F.col("lead_id") % 2 == 0, F.lit("1990-02-02 00:00:00")))
    after, refused = lc.update_lead_status(leads, _changes(e), org=3)
    none = F.lit(None).cast("string")
    return after.select(
        "lead_id", "status", "updated_at", F.lit("lead").alias("kind"), none.alias("reason")
    ).unionByName(
        refused.select(
            "lead_id",
            F.col("new_status").alias("status"),
            F.col("changed_at").alias("updated_at"),
            F.lit("refused").alias("kind"),
            "reason",
        )
    )


@query(
    "patch_campaigns",
    over(
        "campaigns",
        """SELECT c.campaign_id, coalesce(trim(p.name), c.name) AS name, coalesce(p.status, c.status) AS status
        FROM campaigns c LEFT JOIN (SELECT CAST(n_nationkey AS BIGINT) AS campaign_id, org,
            CASE WHEN n_nationkey % 2 = 0 THEN '  ' || n_name || ' ' END AS name,
            CASE WHEN n_nationkey % 3 = 0 THEN 'ARCHIVED' END AS status
            FROM nation JOIN (SELECT s_suppkey, s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS org
                FROM supplier) ON s_suppkey = n_nationkey) p
        ON c.campaign_id = p.campaign_id AND c.organization_id = p.org""",
    ),
)
def patch_campaigns(e):
    key = F.col("n_nationkey")
    owner = e.table("supplier").select(
        F.col("s_suppkey").alias("campaign_id"),
        (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0)).alias("organization_id"),
    )
    patches = e.table("nation").select(
        key.cast("bigint").alias("campaign_id"),
        F.when(key % 2 == 0, F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("name"),
        F.when(key % 3 == 0, F.lit("ARCHIVED")).alias("status"),
    ).join(owner, "campaign_id")
    return lc.patch_campaigns(e.campaigns(), patches).select("campaign_id", "name", "status")


@query(
    "delete_campaigns_cascade",
    over(
        "campaigns leads jobs",
        """, gone AS (SELECT campaign_id FROM campaigns WHERE status = 'ARCHIVED')
        SELECT 'campaigns' AS entity, campaign_id AS id, campaign_id FROM campaigns WHERE campaign_id NOT IN (FROM gone)
        UNION ALL SELECT 'leads', lead_id, CASE WHEN campaign_id IN (FROM gone) THEN NULL ELSE campaign_id END FROM leads
        UNION ALL SELECT 'jobs', job_id, CASE WHEN campaign_id IN (FROM gone) THEN NULL ELSE campaign_id END FROM jobs""",
    ),
)
def delete_campaigns_cascade(e):
    campaigns = e.campaigns()
    after = lc.delete_campaigns(
        {
            "campaigns": campaigns,
            "leads": e.leads(texts=False).select("lead_id", "campaign_id"),
            "jobs": e.jobs().select("job_id", "campaign_id"),
        },
        campaigns.filter(F.col("status") == "ARCHIVED"),
    )
    shape = lambda name, key: after[name].select(F.lit(name).alias("entity"), F.col(key).alias("id"), "campaign_id")
    return shape("campaigns", "campaign_id").unionByName(shape("leads", "lead_id")).unionByName(shape("jobs", "job_id"))


@query(
    "delete_org_cascade",
    over(
        "organizations campaigns leads jobs crawl_targets usage_daily",
        """, gone AS (SELECT organization_id FROM organizations WHERE name LIKE '%A%')
        SELECT 'organizations' AS entity, count(*) AS n FROM organizations WHERE organization_id NOT IN (FROM gone)
        UNION ALL SELECT 'campaigns', count(*) FROM campaigns WHERE organization_id NOT IN (FROM gone)
        UNION ALL SELECT 'leads', count(*) FROM leads WHERE organization_id IS NULL OR organization_id NOT IN (FROM gone)
        UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE organization_id IS NULL OR organization_id NOT IN (FROM gone)
        UNION ALL SELECT 'crawl_targets', count(*) FROM crawl_targets
            WHERE organization_id IS NULL OR organization_id NOT IN (FROM gone)
        UNION ALL SELECT 'usage', count(*) FROM usage_daily WHERE organization_id NOT IN (FROM gone)""",
    ),
)
def delete_org_cascade(e):
    from prospark.operators.analytics import record_usage

    usage = e.usage_events()
    orgs = e.organizations()
    after = lc.delete_orgs(
        {
            "organizations": orgs,
            "campaigns": e.campaigns(),
            "leads": e.leads(texts=False),
            "jobs": e.jobs(),
            "crawl_targets": e.crawl_targets(),
            "usage": record_usage(usage, usage.limit(0)),
        },
        orgs.filter(F.col("name").contains("A")),
    )
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("entity"), "n") for n, df in after.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "latest_active_job",
    over(
        "jobs",
        f"""SELECT idempotency_key, job_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM jobs
        WHERE status IN ('QUEUED', 'RUNNING')
        QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY jobs.created_at DESC, job_id DESC) = 1""",
    ),
)
def latest_active_job(e):
    return jb.latest_active_job(e.jobs()).withColumn("created_at", text_time("created_at"))


@query(
    "idempotent_submissions",
    over(
        "jobs",
        """, req AS (SELECT event_id AS request_id, 'crawl:' || user_id * 12 AS key, ts, event_type = 'error' AS force FROM events),
        act AS (SELECT idempotency_key AS key, job_id FROM jobs WHERE status IN ('QUEUED', 'RUNNING')
            QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at DESC, job_id DESC) = 1)
        SELECT request_id, req.key AS idempotency_key,
            CASE WHEN force THEN 'create' WHEN job_id IS NOT NULL THEN 'reuse_active'
                 WHEN row_number() OVER (PARTITION BY req.key ORDER BY ts, request_id) = 1 THEN 'create'
                 ELSE 'reuse_batch' END AS action,
            CASE WHEN NOT force THEN job_id END AS active_job_id
        FROM req LEFT JOIN act ON req.key = act.key""",
    ),
)
def idempotent_submissions(e):
    requests = e.table("events").select(
        F.col("event_id").alias("request_id"),
        jb.submission_key(F.lit("crawl"), F.lit(None), (F.col("user_id") * 12).cast("string")).alias("idempotency_key"),
        F.col("ts").alias("requested_at"),
        (F.col("event_type") == "error").alias("force"),
    )
    return jb.submissions(requests, e.jobs()).select("request_id", "idempotency_key", "action", "active_job_id")


@query(
    "gated_submissions_all",
    over(
        "jobs usage_daily",
        """, req AS (SELECT event_id AS request_id, user_id % 50 AS org, 'crawl:' || user_id * 12 AS key, ts, event_type = 'error' AS force FROM events),
        active AS (SELECT * FROM jobs WHERE status IN ('QUEUED', 'RUNNING')),
        act AS (SELECT idempotency_key AS key, job_id FROM active
            QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at DESC, job_id DESC) = 1),
        planned AS (SELECT req.*, job_id, CASE WHEN force THEN 'create' WHEN job_id IS NOT NULL THEN 'reuse_active'
                 WHEN row_number() OVER (PARTITION BY req.key ORDER BY ts, request_id) = 1 THEN 'create' ELSE 'reuse_batch' END AS action
            FROM req LEFT JOIN act ON req.key = act.key),
        counted AS (SELECT *, count(*) FILTER (action = 'create') OVER (PARTITION BY org ORDER BY ts, request_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made FROM planned),
        running AS (SELECT organization_id AS org, count(*) AS n FROM active GROUP BY 1),
        recent AS (SELECT organization_id AS org, sum(crawls) AS c FROM usage_daily WHERE date >= DATE '2024-02-10' - 30 GROUP BY 1)
        SELECT request_id, CASE WHEN r IS NULL THEN action ELSE 'rejected' END AS action, r AS reason,
            CASE WHEN r IS NULL AND action = 'reuse_active' THEN job_id END AS active_job_id
        FROM (SELECT *, CASE WHEN coalesce(n, 0) + made >= 45 THEN 'active job limit' WHEN coalesce(c, 0) >= 100 THEN 'monthly crawl quota' END AS r
            FROM counted LEFT JOIN running USING (org) LEFT JOIN recent USING (org))""",
    ).replace("\n,", ","),
)
def gated_submissions_all(e):
    """Requests held against all jobs; about half the tenants that ask have none yet and fill up by their own requests."""
    requests = e.table("events").select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") % 50).alias("organization_id"),
        jb.submission_key(F.lit("crawl"), F.lit(None), (F.col("user_id") * 12).cast("string")).alias("idempotency_key"),
        F.col("ts").alias("requested_at"),
        (F.col("event_type") == "error").alias("force"),
    )
    rows = jb.gated_submissions(requests, e.jobs(), an.sum_usage(e.usage_events()), "2024-02-10", max_jobs=45)
    return rows.select("request_id", "action", "reason", "active_job_id")


@query(
    "apply_moves",
    f"""WITH RECURSIVE m AS (SELECT event_id, user_id * 7 AS job_id, ['running', 'COMPLETED', 'CANCELLED', 'FAILED', 'QUEUED'][event_id % 5 + 1] AS raw,
        ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'RUNNING' ELSE 'QUEUED' END AS status FROM orders),
    s AS (SELECT job_id, CAST(0 AS BIGINT) AS k, status, CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS TIMESTAMP) AS ended, CAST(NULL AS BIGINT) AS refused FROM j
      UNION ALL
      SELECT s.job_id, m.k, CASE WHEN ok THEN upper(raw) ELSE s.status END, CASE WHEN ok AND upper(raw) = 'RUNNING' AND started IS NULL THEN ts ELSE started END,
        CASE WHEN ok AND upper(raw) IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN ts ELSE ended END, CASE WHEN NOT ok THEN event_id END
      FROM s JOIN m ON m.job_id = s.job_id AND m.k = s.k + 1, LATERAL (SELECT s.status || '>' || upper(raw) IN {{MOVES}} AS ok))
    SELECT job_id AS id, status AS outcome, strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(ended, '%Y-%m-%d %H:%M:%S') AS completed_at
        FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k DESC) = 1
    UNION ALL SELECT refused, 'move not allowed', NULL, NULL FROM s WHERE refused IS NOT NULL
    UNION ALL SELECT event_id, 'not found', NULL, NULL FROM m WHERE job_id NOT IN (SELECT job_id FROM j)""".replace(
        "{MOVES}", "('QUEUED>RUNNING', 'QUEUED>CANCELLED', 'RUNNING>COMPLETED', 'RUNNING>FAILED', 'RUNNING>CANCELLED')"
    ),
)
def apply_moves(e):
    """Jobs in two states and moves of all kinds, several per job and some of unknown jobs."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("timestamp_ntz")
    jobs = e.table("orders").select(
        key.alias("job_id"), F.when(key % 3 == 0, "RUNNING").otherwise("QUEUED").alias("status"), none.alias("started_at"), none.alias("completed_at")
    )
    kinds = F.array(*[F.lit(x) for x in ["running", "COMPLETED", "CANCELLED", "FAILED", "QUEUED"]])
    moves = e.table("events").select(
        F.col("event_id").alias("move_id"), (F.col("user_id") * 7).alias("job_id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("new_status"), F.col("ts").alias("moved_at")
    )
    after, refused = jb.apply_moves(jobs, moves)
    text = F.lit(None).cast("string")
    return after.select(
        F.col("job_id").alias("id"), F.col("status").alias("outcome"), text_time("started_at").alias("started_at"), text_time("completed_at").alias("completed_at")
    ).unionByName(refused.select(F.col("move_id").alias("id"), F.col("reason").alias("outcome"), text.alias("started_at"), text.alias("completed_at")))


@query(
    "job_event_tail",
    over(
        "events_status",
        """SELECT event_id, job_id, event_type, progress, status FROM events_status
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY "timestamp" DESC, event_id DESC) <= 10""",
    ),
)
def job_event_tail(e):
    rows = jb.event_tail(jb.normalize_events(e.job_events()))
    return rows.select("event_id", "job_id", "event_type", "progress", "status")


MOVES = "('QUEUED>RUNNING', 'QUEUED>CANCELLED', 'RUNNING>COMPLETED', 'RUNNING>FAILED', 'RUNNING>CANCELLED')"
TRANSITIONS_SQL = f"""SELECT job_id, event_id, previous_status, status,
    previous_status || '>' || status IN {MOVES} AS allowed FROM (SELECT *,
    lag(status) OVER (PARTITION BY job_id ORDER BY "timestamp", event_id) AS previous_status FROM events_status)
    WHERE previous_status <> status"""


@query("job_transition_audit", over("events_status", TRANSITIONS_SQL))
def job_transition_audit(e):
    return jb.transition_audit(jb.normalize_events(e.job_events())).drop("timestamp")


@query(
    "job_durations",
    over(
        "events_status",
        """SELECT job_id, round((epoch_us(c) - epoch_us(s)) / 1000000.0::DOUBLE, 3) AS seconds,
        s IS NOT NULL AS started, c IS NOT NULL AS completed FROM (SELECT job_id,
            min("timestamp") FILTER (status = 'RUNNING') AS s,
            min("timestamp") FILTER (status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS c
            FROM events_status GROUP BY job_id)""",
    ),
)
def job_durations(e):
    rows = jb.job_durations(jb.normalize_events(e.job_events()))
    return rows.select(
        "job_id",
        "seconds",
        F.col("started_at").isNotNull().alias("started"),
        F.col("completed_at").isNotNull().alias("completed"),
    )


@query(
    "politeness_gaps",
    over(
        "request_log",
        """SELECT event_id, domain, round((epoch_us(ts) - epoch_us(p)) / 1000000.0::DOUBLE, 6) AS gap_seconds FROM (
            SELECT *, lag(ts) OVER (PARTITION BY domain ORDER BY ts, event_id) AS p FROM request_log)
        WHERE (epoch_us(ts) - epoch_us(p)) / 1000000.0::DOUBLE < 3600""",
    ),
)
def politeness_gaps(e):
    return jb.politeness_gaps(e.request_log(), min_gap=3600.0).select("event_id", "domain", "gap_seconds")


@query(
    "domain_overlap",
    over(
        "jobs",
        """SELECT job_id, domain, strftime(busy_until, '%Y-%m-%d %H:%M:%S') AS busy_until FROM (
            SELECT job_id, lead_id % 200 AS domain, created_at, max(ended_at) OVER (PARTITION BY lead_id % 200
                ORDER BY created_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM jobs)
        WHERE busy_until > created_at""",
    ),
)
def domain_overlap(e):
    spans = e.jobs().select(
        "job_id", (F.col("lead_id") % 200).alias("domain"), F.col("created_at").alias("started_at"), "ended_at"
    )
    return jb.domain_overlap(spans).select("job_id", "domain", text_time("busy_until"))


@query(
    "retry_plan",
    """SELECT doc_id, CASE WHEN lower(text) SIMILAR TO '.*(not found|forbidden|unauthorized|bad request).*' OR doc_id % 5 = 1
        THEN 'permanent' WHEN doc_id % 5 IN (0, 2) OR regexp_matches(lower(text), '(500|502|503|504|429|timeout|network|connection)')
        THEN 'transient' ELSE 'other' END AS error_class,
    CASE WHEN error_class = 'transient' AND doc_id % 7 < 3 THEN least(30.0, 2.0 ** (doc_id % 7))::DOUBLE END AS delay_seconds
    FROM documents""",
)
def retry_plan(e):
    key = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ["ReadTimeout", "ValidationError", "ConnectError", "KeyError", "RuntimeError"]])
    failures = e.table("documents").select(
        "doc_id",
        F.element_at(kinds, (key % 5 + 1).cast("int")).alias("error_type"),
        F.col("text").alias("message"),
        (key % 7).alias("retry_count"),
    )
    return jb.retry_plan(failures).select("doc_id", "error_class", "delay_seconds")
