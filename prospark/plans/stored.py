"""Stored tables that take batches: each query loads a table, changes it in two batches and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from prospark.operators import analytics as an
from prospark.operators import lifecycle as lc
from prospark.operators.scope import LeadFilter
from prospark.plans.entity_sql import over
from prospark.plans.lifecycle import crawl_requests, fresh_signals, incoming_leads, known_leads, known_signals
from prospark.plans.registry import ORACLES, query
from prospark.plans.tenants import text_time
from prospark.session import scratch_path
from prospark.sources.snapshots import change_snapshot, create_snapshots, read_snapshot
from prospark.sources.text_index import build_text_index, search_stored


def _halves(df, key: str):
    """Two batches of whole keys."""
    odd = F.pmod(F.xxhash64(key), F.lit(2)) == 1
    return df.filter(odd), df.filter(~odd)


def _after(e, rows, key: str, batches, change):
    path = scratch_path(e.spark, "stored")
    create_snapshots(rows, path, key, buckets=16)
    for batch in batches:
        change_snapshot(path, batch, change)
    return read_snapshot(e.spark, path)


@query("stored_leads", ORACLES["upsert_leads"])
def stored_leads(e):
    key = "crawl_target_id"
    return _after(e, known_leads(e), key, _halves(incoming_leads(e), key), lc.upsert_leads).withColumn("created_at", text_time("created_at"))


@query("stored_targets", ORACLES["upsert_targets"])
def stored_targets(e):
    existing, incoming = crawl_requests(e)
    key = "normalized_url"
    return _after(e, existing, key, _halves(incoming, key), lc.upsert_targets).drop("url")


@query("stored_usage", ORACLES["record_usage"])
def stored_usage(e):
    """Daily counters that grow by two batches of events."""
    rows, cuts = e.usage_events(), [F.lit(d).cast("date") for d in ("2024-01-15", "2024-01-22")]
    batches = [rows.filter((F.col("date") >= cuts[0]) & (F.col("date") < cuts[1])), rows.filter(F.col("date") >= cuts[1])]
    existing = an.sum_usage(rows.filter(F.col("date") < cuts[0]))
    return _after(e, existing, "organization_id", batches, an.record_usage).withColumn("date", F.col("date").cast("string"))


@query("stored_signals", ORACLES["replace_signals"])
def stored_signals(e):
    fresh = fresh_signals(e)
    return _after(e, known_signals(e), "lead_id", _halves(fresh, "lead_id"), lambda old, new: lc.replace_signals(old, new, new))


@query(
    "search_stored_leads",
    over(
        "leads",
        """SELECT search, lead_id, company_name FROM leads, (VALUES ('ring'), ('a%machinery'), ('no such text'), ('or_')) v(search)
        WHERE company_name ILIKE '%' || search || '%' OR domain ILIKE '%' || search || '%' OR industry ILIKE '%' || search || '%'
        OR company_summary ILIKE '%' || search || '%' OR value_proposition ILIKE '%' || search || '%'""",
    ),
)
def search_stored_leads(e):
    """Searches in stored leads through an index of three-letter runs; one of them has none and reads all rows."""
    table, index = scratch_path(e.spark, "leads"), scratch_path(e.spark, "runs")
    create_snapshots(e.leads(), table, "lead_id", buckets=16)
    build_text_index(read_snapshot(e.spark, table), index)
    found = [search_stored(e.spark, table, index, LeadFilter(search=f" {text} ")).select(F.lit(text).alias("search"), "lead_id", "company_name") for text in ("ring", "a%machinery", "no such text", "or_")]
    return reduce(lambda a, b: a.unionByName(b), found)
