"""Job-event streams as named queries: each runs the stream to its end and reads its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospark.operators.jobs import normalize_events
from prospark.plans.entity_sql import over
from prospark.plans.lifecycle import TRANSITIONS_SQL
from prospark.plans.registry import query
from prospark.session import scratch_path
from prospark.sources.entities import project_job_events
from prospark.sources.tables import TABLES, table_path
from prospark.streaming import events as st
from prospark.streaming.ordered import run_ordered_audit


def event_stream(e):
    # Written as a pattern, the path may be one file or a folder of files.
    path = table_path(e.sf_dir, "[e]vents")
    raw = st.read_events(e.spark, path, TABLES["events"])
    return project_job_events(raw)


def split_stream(e, files: int = 5, order: tuple[int, ...] | None = None):
    """The events written again as several files, one per micro-batch, so that state counts; in time order if none is given.

    With an order the stream ends with an event long after all others, which lets the watermark pass them.
    """
    folder = scratch_path(e.spark, "split")
    rows = e.table("events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(seconds), F.max(seconds)).head()
    slot = F.floor((seconds - low) * files / (high - low + 1))
    for k in order or range(files):
        rows.filter(slot == k).coalesce(1).write.mode("append").parquet(folder)
    if order:
        last = rows.limit(1).withColumns({"ts": F.timestamp_seconds(F.lit(high + 10_000_000)).cast("timestamp_ntz"), "user_id": F.lit(-1).cast("bigint")})
        last.coalesce(1).write.mode("append").parquet(folder)
    return project_job_events(st.read_events(e.spark, folder, TABLES["events"], files_per_batch=1))


@query(
    "stream_source_events",
    over("job_events", """SELECT event_id, job_id, organization_id, event_type, progress FROM job_events"""),
)
def stream_source_events(e):
    path = scratch_path(e.spark, "events")
    stream = event_stream(e)
    st.run_to_table(stream, path)
    rows = e.spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return rows.select("event_id", "job_id", "organization_id", "event_type", "progress")


@query(
    "stream_event_normalize",
    over("events_status", "SELECT event_id, job_id, event_type, progress, status FROM events_status"),
)
def stream_event_normalize(e):
    path = scratch_path(e.spark, "normalized")
    stream = normalize_events(event_stream(e)).select("event_id", "job_id", "event_type", "progress", "status")
    st.run_to_table(stream, path)
    return e.spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query(
    "stream_job_latest",
    over(
        "events_status",
        """SELECT job_id, event_id, event_type, status, progress, status IN ('COMPLETED', 'FAILED', 'CANCELLED') AS is_final
        FROM events_status QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY "timestamp" DESC, event_id DESC) = 1""",
    ),
)
def stream_job_latest(e):
    path = scratch_path(e.spark, "latest")
    stream = st.stream_job_latest(split_stream(e))
    st.run_upserts(stream, path, ["job_id"], compact_every=3)
    rows = st.read_upserts(e.spark, path, stream.schema, ["job_id"])
    return rows.select("job_id", "event_id", "event_type", "status", "progress", "is_final")


@query("stream_transition_audit", over("events_status", TRANSITIONS_SQL))
def stream_transition_audit(e):
    """The audit over several micro-batches; the last status of each job is kept in a table."""
    path = scratch_path(e.spark, "transitions")
    st.run_transition_audit(split_stream(e), path, bucket="day")
    return st.read_transitions(e.spark, path).drop("timestamp")


@query("stream_ordered_audit", over("events_status", TRANSITIONS_SQL))
def stream_ordered_audit(e):
    """The audit in event time although the files arrive in another order."""
    path = scratch_path(e.spark, "ordered")
    run_ordered_audit(split_stream(e, 3, order=(1, 0, 2)), path, "25 days")
    return st.read_transitions(e.spark, path).drop("timestamp")


@query(
    "stream_daily_usage",
    over(
        "job_events",
        """SELECT organization_id, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date,
        count(*) FILTER (event_type = 'job_completed') AS jobs_completed,
        count(*) FILTER (event_type = 'job_failed') AS jobs_failed,
        count(*) FILTER (event_type = 'page_crawled') AS pages_crawled,
        count(*) FILTER (event_type = 'qualification_started') AS ai_qualifications FROM job_events GROUP BY 1, 2""",
    ),
)
def stream_daily_usage(e):
    path = scratch_path(e.spark, "usage")
    stream = st.stream_daily_usage(split_stream(e))
    st.run_upserts(stream, path)
    rows = st.read_upserts(e.spark, path, stream.schema, ["organization_id", "date"])
    return rows.withColumn("date", F.col("date").cast("string"))


@query(
    "stream_active_jobs",
    over(
        "events_status",
        """SELECT organization_id, count(*) FILTER (status IN ('QUEUED', 'RUNNING')) AS active_jobs,
        count(*) FILTER (status IN ('QUEUED', 'RUNNING')) >= 5 AS exceeded FROM (FROM events_status
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY "timestamp" DESC, event_id DESC) = 1) GROUP BY organization_id""",
    ),
)
def stream_active_jobs(e):
    path = scratch_path(e.spark, "active")
    st.stream_active_jobs(split_stream(e), path)
    return st.read_active_jobs(e.spark, path)


@query(
    "stream_submit_dedupe",
    "SELECT DISTINCT 'crawl:' || user_id AS idempotency_key FROM events",
)
def stream_submit_dedupe(e):
    """Submission keys within the whole month of events, which one watermark span covers."""
    path = scratch_path(e.spark, "submits")
    requests = split_stream(e).select(
        F.concat(F.lit("crawl:"), F.col("job_id").cast("string")).alias("idempotency_key"),
        F.col("timestamp").alias("requested_at"),
    )
    stream = st.stream_submit_dedupe(requests, "60 days").select("idempotency_key")
    st.run_to_table(stream, path)
    return e.spark.read.schema(stream.schema).parquet(f"{path}/rows")
