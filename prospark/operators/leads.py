"""Lead lists, exports and per-lead records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions.skew import ordinal
from prospark.operators.scope import LeadFilter, at_least_one, filter_leads


def list_leads(
    leads: DataFrame,
    filters: LeadFilter = LeadFilter(),
    sort_by: str = "created_at",
    sort_order: str = "desc",
    page: int = 1,
    page_size: int = 25,
) -> DataFrame:
    """One page of the lead list; equal sort keys are ordered by lead id.

    A page far down brings all rows before it together in one task.
    """
    at_least_one(page=page, page_size=page_size)
    if sort_by not in rules.SORT_COLUMNS:
        raise ValueError(f"leads can't be sorted by {sort_by!r}")
    if sort_order.lower() not in ("asc", "desc"):
        raise ValueError(f"sort order {sort_order!r} is neither asc nor desc")
    key = F.desc(sort_by) if sort_order.lower() == "desc" else F.asc(sort_by)
    rows = filter_leads(leads, filters).orderBy(key, "lead_id").offset((page - 1) * page_size).limit(page_size)
    return rows.select(*rules.LIST_COLUMNS)


def leads_total(leads: DataFrame, filters: LeadFilter = LeadFilter(), page_size: int = 25) -> DataFrame:
    at_least_one(page_size=page_size)
    return (
        filter_leads(leads, filters)
        .agg(F.count("lead_id").alias("total"))
        .withColumn("pages", F.ceil(F.col("total") / page_size).cast("bigint"))
    )


def rank_relational(leads: DataFrame, filters: LeadFilter = LeadFilter(), k: int = 25) -> DataFrame:
    at_least_one(k=k)
    return (
        filter_leads(leads, filters)
        .orderBy(F.desc("icp_score"), F.desc("created_at"), "lead_id")
        .limit(k)
        .select(*rules.LIST_COLUMNS)
    )


def export_leads(leads: DataFrame, filters: LeadFilter = LeadFilter(), limit: int | None = None) -> DataFrame:
    """All passing leads, or the best `limit` of them, with the nine export columns, best first."""
    rows = filter_leads(leads, filters).orderBy(F.desc("icp_score"), F.desc("created_at"), "lead_id")
    if limit is not None:
        at_least_one(limit=limit)
        rows = rows.limit(limit)
    return rows.select(*rules.EXPORT_COLUMNS)


def export_json(exported: DataFrame) -> DataFrame:
    """Each exported row as one JSON object; absent values stay as null."""
    body = F.to_json(F.struct(*rules.EXPORT_COLUMNS), {"ignoreNullFields": "false"})
    return exported.select(body.alias("lead"))


def lead_kpis(leads: DataFrame, filters: LeadFilter = LeadFilter()) -> DataFrame:
    return filter_leads(leads, filters).agg(
        F.count_if(F.col("icp_score") >= rules.STRONG_SCORE).alias("strong_fit"),
        F.count_if(F.col("status").isin("NEW", "REVIEW")).alias("in_review"),
        F.coalesce(F.round(F.avg("icp_score")), F.lit(0.0)).cast("bigint").alias("avg_fit"),
    )


def fit_band(score: Column) -> Column:
    return (
        F.when(score >= rules.STRONG_SCORE, "Strong Fit")
        .when(score >= rules.MODERATE_SCORE, "Moderate")
        .otherwise("Low Fit")
    )


def fit_histogram(leads: DataFrame) -> DataFrame:
    return leads.groupBy(fit_band(F.col("icp_score")).alias("band")).agg(F.count(F.lit(1)).alias("leads"))


def signal_sentiment(signals: DataFrame) -> DataFrame:
    """Positive, negative and other signals of each lead, in one pass."""
    mood = F.lower("sentiment")
    return signals.groupBy("lead_id").agg(
        F.count_if(mood == "positive").alias("positive"),
        F.count_if(mood == "negative").alias("negative"),
        F.count_if(~mood.isin("positive", "negative") | mood.isNull()).alias("neutral"),
    )


#: A lead with at most so many full parts in a section is gathered in one row before it is cut.
WHOLE_PARTS = 10


def lead_dossier(
    leads: DataFrame,
    signals: DataFrame,
    pages: DataFrame,
    embeddings: DataFrame,
    audits: DataFrame,
    part_size: int = 1000,
) -> DataFrame:
    """Everything known about each lead, as ordered parts of bounded size.

    One row per (lead, section, part). A section with up to `part_size` items is
    one row; a longer one runs over several rows, so no single row or task ever
    has to hold all children of a very large lead (more than `WHOLE_PARTS` parts). Children are never joined to
    each other.
    """

    def section(name: str, df: DataFrame, item: Column, order: list[Column], bucket: Column) -> DataFrame:
        rows = df.withColumn("item", item)
        # A lead of a few parts is gathered at once, so its items are shuffled once; only larger ones are numbered by
        # buckets. These are at most one key per `WHOLE_PARTS` full parts of items, and each task gets them.
        sizes = df.groupBy("lead_id").agg(F.count(F.lit(1)).alias("n"))
        large = F.broadcast(sizes.filter(F.col("n") > WHOLE_PARTS * part_size).select("lead_id"))
        keyed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "item")
        gathered = rows.join(large, "lead_id", "left_anti").groupBy("lead_id").agg(F.sort_array(F.collect_list(keyed)).alias("all"))
        last = F.floor((F.size("all") - 1) / part_size)
        cut = gathered.select("lead_id", "all", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
        start = (F.col("part") * part_size + 1).cast("int")
        cut = cut.select("lead_id", "part", F.transform(F.slice("all", start, part_size), lambda x: x["item"]).alias("items"))
        numbered = ordinal(rows.join(large, "lead_id", "left_semi"), ["lead_id"], order, bucket, "position")
        parts_ = (
            numbered.groupBy("lead_id", F.floor((F.col("position") - 1) / part_size).alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("items"))
            .select("lead_id", "part", F.transform("items", lambda x: x["item"]).alias("items"))
        )
        return cut.unionByName(parts_).select("lead_id", F.lit(name).alias("section"), "part", "items")

    # Only the leads' keys are needed to attach pages through their crawl target.
    owned = leads.select("lead_id", F.col("crawl_target_id").alias("site_id"))
    month = F.date_trunc("month", F.col("created_at"))
    newest_first = -F.unix_seconds(F.col("created_at").cast("timestamp"))
    parts = [
        section(
            "signals",
            signals.join(leads.select("lead_id"), "lead_id", "left_semi"),
            F.to_json(F.struct("signal_id", "signal", "evidence", "source_url", "sentiment")),
            [F.col("signal_id")],
            F.floor(F.col("signal_id") / 10000),
        ),
        section(
            "pages",
            pages.join(owned, "site_id"),
            F.to_json(F.struct("page_id", "url", "title", "depth")),
            [F.col("depth"), F.col("page_id")],
            F.struct(F.col("depth"), F.floor(F.col("page_id") / 10000)),
        ),
        section(
            "audits",
            audits.join(leads.select("lead_id"), "lead_id", "left_semi"),
            F.to_json(F.struct("audit_id", "provider", "model", "input_tokens", "output_tokens", "latency_ms")),
            [newest_first, F.col("audit_id")],
            -F.unix_seconds(month.cast("timestamp")),
        ),
        # The vector itself is left out: only its size travels.
        embeddings.join(leads.select("lead_id"), "lead_id", "left_semi").select(
            "lead_id",
            F.lit("embedding").alias("section"),
            F.lit(0).cast("bigint").alias("part"),
            F.array(F.to_json(F.struct(F.size("embedding").alias("dimension")))).alias("items"),
        ),
        leads.select(
            "lead_id",
            F.lit("lead").alias("section"),
            F.lit(0).cast("bigint").alias("part"),
            F.array(F.to_json(F.struct(*rules.LIST_COLUMNS))).alias("items"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
