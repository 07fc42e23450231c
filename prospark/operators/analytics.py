"""Tenant, campaign, cost, quota and usage reports, for all tenants in one plan.

Each fact table is aggregated on its own key before it meets another one, so
the joins run over one row per tenant or campaign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions.skew import first_per_key
from prospark.operators.scope import active_jobs, recent_usage


def rate(part: Column, whole: Column, digits: int, empty: float = 0.0) -> Column:
    """Percentage, half rounded up; `empty` where there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(empty))


def ai_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in * rules.PRICE_IN + tokens_out * rules.PRICE_OUT, 4)


def _keyed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("organization_id").isNotNull())


def count_qualified(leads: DataFrame, threshold: int = rules.QUALIFIED_SCORE) -> DataFrame:
    return (
        _keyed(leads)
        .groupBy("organization_id")
        .agg(
            F.count("lead_id").alias("total_leads"),
            F.count_if(F.col("icp_score") >= threshold).alias("qualified_leads"),
        )
    )


def qualification_rate(leads: DataFrame, threshold: int = rules.QUALIFIED_SCORE) -> DataFrame:
    return count_qualified(leads, threshold).select(
        "organization_id", rate(F.col("qualified_leads"), F.col("total_leads"), 1).alias("qualification_rate")
    )


def job_outcomes(jobs: DataFrame) -> DataFrame:
    return (
        _keyed(jobs)
        .groupBy("organization_id")
        .agg(
            F.count_if(F.col("status") == "COMPLETED").alias("jobs_completed"),
            F.count_if(F.col("status") == "FAILED").alias("jobs_failed"),
        )
    )


def job_success_rate(jobs: DataFrame) -> DataFrame:
    done, bad = F.col("jobs_completed"), F.col("jobs_failed")
    return job_outcomes(jobs).select("organization_id", rate(done, done + bad, 1, 100.0).alias("job_success_rate"))


def join_audit_lead(audits: DataFrame, leads: DataFrame) -> DataFrame:
    return audits.join(leads.select("lead_id", "organization_id"), "lead_id")


def token_cost(audits: DataFrame, leads: DataFrame) -> DataFrame:
    """Tokens and cost per tenant.

    Tokens are summed per lead first: the join then moves one row per lead and
    a lead with very many calls is combined on the map side.
    """
    per_lead = audits.groupBy("lead_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    sums = (
        _keyed(join_audit_lead(per_lead, leads))
        .groupBy("organization_id")
        .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    )
    return sums.withColumn("estimated_ai_cost", ai_cost(F.col("input_tokens"), F.col("output_tokens")))


def join_pages_target(pages: DataFrame, targets: DataFrame) -> DataFrame:
    return pages.join(targets, "target_id")


def pages_per_org(pages: DataFrame, targets: DataFrame) -> DataFrame:
    per_target = pages.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        _keyed(join_pages_target(per_target, targets)).groupBy("organization_id").agg(F.sum("n").alias("pages_crawled"))
    )


def org_overview(
    orgs: DataFrame,
    leads: DataFrame,
    targets: DataFrame,
    pages: DataFrame,
    jobs: DataFrame,
    audits: DataFrame,
    threshold: int = rules.QUALIFIED_SCORE,
) -> DataFrame:
    crawls = _keyed(targets).groupBy("organization_id").agg(F.count(F.lit(1)).alias("total_crawls"))
    facts = [
        count_qualified(leads, threshold),
        crawls,
        pages_per_org(pages, targets),
        job_outcomes(jobs),
        token_cost(audits, leads).select("organization_id", "estimated_ai_cost"),
    ]
    out = orgs.select("organization_id", "name")
    for fact in facts:
        out = out.join(fact, "organization_id", "left")
    counts = ["total_leads", "qualified_leads", "total_crawls", "pages_crawled", "jobs_completed", "jobs_failed"]
    out = out.fillna(0, subset=counts).fillna(0.0, subset=["estimated_ai_cost"])
    return out.withColumn("qualification_rate", rate(F.col("qualified_leads"), F.col("total_leads"), 1))


def join_campaign_leads_outer(campaigns: DataFrame, leads: DataFrame) -> DataFrame:
    return campaigns.join(leads.select("campaign_id", "lead_id", "icp_score"), "campaign_id", "left")


def campaign_counts(campaigns: DataFrame, leads: DataFrame, threshold: int = rules.QUALIFIED_SCORE) -> DataFrame:
    """Campaigns with their lead counts, mean score and qualified share; empty campaigns stay.

    Leads are joined by campaign alone: a lead counts for the campaign it names,
    whichever tenant holds it.
    """
    per_campaign = (
        leads.filter(F.col("campaign_id").isNotNull())
        .groupBy("campaign_id")
        .agg(
            F.count("lead_id").alias("total_leads"),
            F.count_if(F.col("icp_score") >= threshold).alias("qualified_leads"),
            F.avg("icp_score").alias("_avg"),
        )
    )
    return (
        campaigns.join(per_campaign, "campaign_id", "left")
        .fillna(0, subset=["total_leads", "qualified_leads"])
        .withColumn("avg_icp_score", F.round(F.coalesce("_avg", F.lit(0.0)), 1))
        .withColumn("qualified_pct", rate(F.col("qualified_leads"), F.col("total_leads"), 0))
        .drop("_avg")
    )


def campaign_stats(campaigns: DataFrame, leads: DataFrame) -> DataFrame:
    return (
        campaign_counts(campaigns, leads)
        .select("organization_id", "campaign_id", F.col("name").alias("campaign_name"), "total_leads", "avg_icp_score")
        .orderBy(F.desc("total_leads"), "campaign_id")
    )


def industry_top(leads: DataFrame, n: int = 10, per_org: bool = False) -> DataFrame:
    if per_org:
        counts = _keyed(leads).groupBy("organization_id", "industry").agg(F.count("lead_id").alias("leads"))
        return first_per_key(counts, ["organization_id"], [F.desc("leads"), F.asc("industry")], n)
    counts = leads.groupBy("industry").agg(F.count("lead_id").alias("leads"))
    return counts.orderBy(F.desc("leads"), "industry").limit(n)


def status_histogram(leads: DataFrame) -> DataFrame:
    return _keyed(leads).groupBy("organization_id", "status").agg(F.count("lead_id").alias("leads"))


def sum_usage(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in rules.USAGE_COUNTERS]
    cost = F.round(F.sum("estimated_ai_cost"), 4).alias("estimated_ai_cost")
    return rows.groupBy("organization_id", "date").agg(*sums, cost)


def record_usage(existing: DataFrame, deltas: DataFrame) -> DataFrame:
    """New daily table: old rows plus increments, one row per tenant and day."""
    return sum_usage(existing.unionByName(deltas))


def usage_timeline(usage: DataFrame, as_of: str, days: int = rules.USAGE_DAYS) -> DataFrame:
    return recent_usage(usage, as_of, days).orderBy(F.desc("date"), "organization_id")


def usage_deltas(jobs: DataFrame) -> DataFrame:
    """Usage increment of every finished job."""
    kind, ok = F.col("job_type"), F.col("status") == "COMPLETED"
    crawled = ok & kind.isin("CRAWL", "CRAWL_AND_QUALIFY")
    judged = ok & kind.isin("QUALIFY", "CRAWL_AND_QUALIFY")
    one = lambda c: c.cast("bigint")
    cost = F.lit(0.0)
    for name, price in rules.JOB_COST.items():
        cost = F.when(ok & (kind == name), price).otherwise(cost)
    return jobs.filter(F.col("status").isin("COMPLETED", "FAILED") & F.col("organization_id").isNotNull()).select(
        "organization_id",
        F.to_date("ended_at").alias("date"),
        one(crawled).alias("crawls"),
        F.when(crawled, F.col("pages_crawled")).otherwise(0).cast("bigint").alias("pages_crawled"),
        one(judged).alias("leads_created"),
        one(judged).alias("ai_qualifications"),
        one(judged & ~F.col("embedding_reused")).alias("embeddings_generated"),
        one(ok).alias("jobs_completed"),
        one(F.col("status") == "FAILED").alias("jobs_failed"),
        cost.alias("estimated_ai_cost"),
    )


def usage_rollup(jobs: DataFrame) -> DataFrame:
    return sum_usage(usage_deltas(jobs))


def quota_report(
    orgs: DataFrame,
    jobs: DataFrame,
    usage: DataFrame,
    as_of: str,
    max_jobs: int = rules.MAX_ACTIVE_JOBS,
    max_crawls: int = rules.MAX_MONTHLY_CRAWLS,
) -> DataFrame:
    running = active_jobs(jobs).groupBy("organization_id").agg(F.count(F.lit(1)).alias("active_jobs"))
    crawls = recent_usage(usage, as_of).groupBy("organization_id").agg(F.sum("crawls").alias("recent_crawls"))
    return (
        orgs.select("organization_id")
        .join(running, "organization_id", "left")
        .join(crawls, "organization_id", "left")
        .fillna(0, subset=["active_jobs", "recent_crawls"])
        .withColumn("jobs_exceeded", F.col("active_jobs") >= max_jobs)
        .withColumn("crawls_exceeded", F.col("recent_crawls") >= max_crawls)
    )


def token_usage(audits: DataFrame) -> DataFrame:
    """Tokens and latency per provider and model, with the latency of the newest call."""
    newest = F.max_by("latency_ms", F.struct("created_at", "audit_id"))
    return audits.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        F.round(F.max("latency_ms"), 2).alias("max_latency_ms"),
        F.round(newest, 2).alias("last_latency_ms"),
    )


def latency_sketches(audits: DataFrame, k: int = 800) -> DataFrame:
    """One quantile sketch of the latencies per provider, model and day, to be stored and merged for any span of days.

    A larger `k` makes a larger sketch; ranks of 800 are right within about 0.4 of 100 at high probability. Audits
    without a latency are in no sketch, and a day without any has none.
    """
    timed = audits.where(F.col("latency_ms").isNotNull())
    return timed.groupBy("provider", "model", F.to_date("created_at").alias("day")).agg(
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(k)).alias("latencies")
    )


def latency_percentiles(sketches: DataFrame, first_day: str | None = None, last_day: str | None = None, ranks: dict[str, float] | None = None) -> DataFrame:
    """Calls and latency quantiles per provider and model over a span of days, both ends included, from day sketches."""
    rows = sketches
    if first_day is not None:
        rows = rows.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        rows = rows.where(F.col("day") <= F.lit(last_day).cast("date"))
    whole = rows.groupBy("provider", "model").agg(F.kll_merge_agg_double("latencies").alias("_all"))
    quantile = lambda r: F.round(F.kll_sketch_get_quantile_double("_all", F.lit(float(r))), 2)
    ranks = {"p50_ms": 0.5, "p95_ms": 0.95} if ranks is None else ranks
    return whole.select("provider", "model", F.kll_sketch_get_n_double("_all").alias("timed_calls"), *[quantile(r).alias(name) for name, r in ranks.items()])


def memberships(users: DataFrame, members: DataFrame, orgs: DataFrame) -> DataFrame:
    """Organizations of each user, the earliest joined one marked as primary."""
    joined = members.join(users, "user_id").join(orgs.withColumnRenamed("name", "organization_name"), "organization_id")
    firsts = members.groupBy("user_id").agg(
        F.min(F.struct("joined_at", "organization_id"))["organization_id"].alias("_primary")
    )
    return (
        joined.join(firsts, "user_id")
        .withColumn("is_primary", F.col("organization_id") == F.col("_primary"))
        .drop("_primary")
    )
