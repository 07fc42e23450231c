"""Snapshots after inserts, updates and deletes.

Plain Parquet has no row update, so each operator takes the stored rows and the
change rows and gives the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions.urls import safety
from prospark.operators.scope import scope_tenant

LEAD_REPLACED = [
    "company_name", "company_summary", "value_proposition", "industry", "target_audience", "business_model",
    "geography", "estimated_company_size", "technology_signals", "icp_score", "confidence_score",
    "qualification_reasoning", "qualification_json",
]


def _placed(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """`incoming` with `_place`: "own" if its tenant has a row of this key, "shared" if only no tenant has one, or "new".

    Rows of other tenants are never a match; a request of no tenant sees shared rows alone, which are its own.
    """
    org = "organization_id"
    rows = existing.groupBy(key, org).agg(F.lit(True).alias("_own"))
    own = rows.select(F.col(key).alias("_k"), F.col(org).alias("_o"), "_own")
    shared = rows.filter(F.col(org).isNull()).select(F.col(key).alias("_s"))
    out = incoming.join(own, (F.col(key) == F.col("_k")) & F.col(org).eqNullSafe(F.col("_o")), "left")
    out = out.join(shared, F.col(key) == F.col("_s"), "left")
    place = F.when(F.col("_own"), "own").when(F.col("_s").isNotNull(), "shared").otherwise("new")
    return out.withColumn("_place", place).select(*incoming.columns, "_place")


def _per_row(placed: DataFrame, key: str, first) -> DataFrame:
    """Of the requests that meet in one stored row, the one whose tenant is `first`; `_to` is the row's tenant."""
    hits = placed.filter("_place <> 'new'").withColumn("_to", F.when(F.col("_place") == "own", F.col("organization_id")))
    chosen = hits.groupBy(F.col(key).alias("_k"), F.col("_to").alias("_t")).agg(first("organization_id").alias("_o"))
    same = (F.col(key) == F.col("_k")) & F.col("_to").eqNullSafe(F.col("_t")) & F.col("organization_id").eqNullSafe(F.col("_o"))
    return hits.join(chosen, same, "left_semi")


def upsert_leads(existing: DataFrame, incoming: DataFrame, key: str = "crawl_target_id") -> DataFrame:
    """New targets become NEW leads; known ones take the fresh qualification fields.

    `incoming` holds one row per (key, tenant). It matches the tenant's own lead, else the shared one, and never
    another tenant's. Where several tenants' answers meet in a shared lead, the one of the largest tenant id stays.
    Id, status, tenant, campaign and creation time of a known lead stay as they are.
    """
    placed = _placed(existing, incoming, key)
    hits = _per_row(placed, key, F.max)
    fresh = [c for c in LEAD_REPLACED if c in incoming.columns and c in existing.columns]
    new = hits.select(F.col(key).alias("_k"), F.col("_to").alias("_t"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fresh])
    kept = existing.join(new, (F.col(key) == F.col("_k")) & F.col("organization_id").eqNullSafe(F.col("_t")), "left").select(
        *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in existing.columns]
    )
    value = lambda c: F.lit("NEW") if c == "status" else F.col(c) if c in incoming.columns else F.lit(None)
    added = placed.filter("_place = 'new'").select(*[value(c).cast(existing.schema[c].dataType).alias(c) for c in existing.columns])
    return kept.unionByName(added)


def upsert_targets(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Crawl targets after a batch of crawl requests, one request per (tenant, normalized URL).

    A request matches the tenant's own target, else the shared one. The matched target goes back to in_progress and
    takes the campaign if the request names one; a shared target goes to the smallest tenant that asks for it. All
    other requests add a row of their tenant.
    """
    key = "normalized_url"
    placed = _placed(existing, incoming, key)
    hits = _per_row(placed, key, F.min)
    won = hits.select(F.col(key).alias("_k"), F.col("_to").alias("_t"), F.col("organization_id").alias("_o"), F.col("campaign_id").alias("_c"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    kept = existing.join(won, (F.col(key) == F.col("_k")) & F.col("organization_id").eqNullSafe(F.col("_t")), "left").select(
        "url",
        key,
        "domain",
        F.when(hit, "in_progress").otherwise(F.col("status")).alias("status"),
        F.when(~hit, F.col("error_message")).alias("error_message"),
        F.coalesce("organization_id", "_o").alias("organization_id"),
        F.coalesce("_c", "campaign_id").alias("campaign_id"),
    )
    taken = hits.select(F.col(key).alias("_k"), F.col("organization_id").alias("_o"))
    same = (F.col(key) == F.col("_k")) & F.col("organization_id").eqNullSafe(F.col("_o"))
    added = placed.filter("_place <> 'own'").join(taken, same, "left_anti").select(
        "url", key, "domain", F.lit("in_progress").alias("status"), F.lit(None).cast("string").alias("error_message"), "organization_id", "campaign_id"
    )
    return kept.unionByName(added)


def admit_targets(existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets after the safe requests, unsafe requests with the reason); an unsafe URL is never stored."""
    judged = requests.withColumn("reason", safety(F.col("normalized_url")))
    safe = F.coalesce(F.col("reason") == "safe", F.lit(False))
    return upsert_targets(existing, judged.filter(safe).drop("reason")), judged.filter(~safe)


def replace_signals(old: DataFrame, new: DataFrame, lead_ids: DataFrame) -> DataFrame:
    """All signals of the given leads are dropped and the new ones take their place."""
    return old.join(lead_ids.select("lead_id"), "lead_id", "left_anti").unionByName(new)


def embedding_refresh_plan(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """insert, update or reuse per lead, by presence and content hash of the stored vector."""
    stored = embeddings.select("lead_id", F.col("content_hash").alias("_stored"), F.lit(True).alias("_known"))
    action = (
        F.when(F.col("_known").isNull(), "insert")
        .when(~F.col("content_hash").eqNullSafe(F.col("_stored")), "update")
        .otherwise("reuse")
    )
    return docs.join(stored, "lead_id", "left").withColumn("action", action).drop("_stored", "_known")


def update_lead_status(leads: DataFrame, changes: DataFrame, org: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(leads after the status changes, changes that were refused with a reason).

    `changes`: lead_id, new_status, changed_at. The newest valid change of a lead counts. Leads without one keep their
    `updated_at`, or have none.
    """
    to = F.upper("new_status")
    valid = F.coalesce(to.isin(rules.LEAD_STATES), F.lit(False))
    newest = F.max(F.struct("changed_at", to.alias("to"))).alias("_new")
    wanted = changes.filter(valid).groupBy("lead_id").agg(newest)
    inside = F.lit(True) if org is None else (F.col("organization_id") == org) | F.col("organization_id").isNull()
    apply_it = F.coalesce(F.col("_new").isNotNull() & inside, F.lit(False))
    before = F.col("updated_at") if "updated_at" in leads.columns else F.lit(None)
    after = (
        leads.join(wanted, "lead_id", "left")
        .withColumn("updated_at", F.when(apply_it, F.col("_new.changed_at")).otherwise(before))
        .withColumn("status", F.when(apply_it, F.col("_new.to")).otherwise(F.col("status")))
        .drop("_new")
    )
    seen = scope_tenant(leads, org, shared=True).select("lead_id", F.lit(True).alias("_seen"))
    refused = (
        changes.join(seen, "lead_id", "left")
        .withColumn("reason", F.when(~valid, "invalid status").when(F.col("_seen").isNull(), "not found"))
        .filter(F.col("reason").isNotNull())
        .drop("_seen")
    )
    return after, refused


def patch_campaigns(campaigns: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial update: a missing value in the patch keeps the stored one; patches keep to their tenant."""
    c, p = campaigns.alias("c"), patches.alias("p")
    on = (F.col("c.campaign_id") == F.col("p.campaign_id")) & (
        F.col("c.organization_id") == F.col("p.organization_id")
    )
    out = []
    for name in campaigns.columns:
        if name in patches.columns and name not in ("campaign_id", "organization_id"):
            new = F.trim(f"p.{name}") if name in ("name", "description") else F.col(f"p.{name}")
            out.append(F.coalesce(new, F.col(f"c.{name}")).alias(name))
        else:
            out.append(F.col(f"c.{name}"))
    return c.join(p, on, "left").select(*out)


def _clear_link(children: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    marks = gone.select(F.col(column).alias("_gone")).distinct()
    cleared = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
    keep = [cleared if c == column else F.col(c) for c in children.columns]
    return children.join(marks, F.col(column) == F.col("_gone"), "left").select(*keep)


def delete_campaigns(entities: dict[str, DataFrame], ids: DataFrame, org: int | None = None) -> dict[str, DataFrame]:
    """Campaigns without the deleted ones; leads, targets and jobs lose the link, not the row."""
    gone = scope_tenant(
        entities["campaigns"].join(ids.select("campaign_id"), "campaign_id", "left_semi"), org, shared=False
    ).select("campaign_id")
    out = {"campaigns": entities["campaigns"].join(gone, "campaign_id", "left_anti")}
    for name, df in entities.items():
        if name != "campaigns":
            out[name] = _clear_link(df, "campaign_id", gone)
    return out


def delete_orgs(entities: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted tenants; rows of no tenant stay."""
    gone = ids.select("organization_id").distinct()
    return {name: df.join(gone, "organization_id", "left_anti") for name, df in entities.items()}
