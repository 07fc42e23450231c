"""Job-event streams with Structured Streaming.

Event time comes from the events themselves; every stream here runs the same
projections as its batch twin. Queries use the available-now trigger, so a
scheduled run takes up where the last one stopped, and their results are
Parquet tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prospark import rules
from prospark.functions.skew import first_per_key
from prospark.operators.jobs import normalize_events, transition_audit
from prospark.session import delete_path, path_exists

EVENT_SCHEMA = (
    "event_id bigint, job_id bigint, organization_id bigint, event_type string, progress int, data string, "
    "timestamp timestamp"
)


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Event stream from a folder of files; a Kafka source with the same columns is a drop-in."""
    return (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream over what is available and adds its rows to the table at `path`."""
    (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", f"{path}/_stream")
        .trigger(availableNow=True)
        .start(f"{path}/rows")
        .awaitTermination()
    )


def run_batches(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/_stream")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


#: Batches between two compactions of a table of batch folders.
COMPACT_EVERY = 20


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Batches up to which a table of batch folders has been compacted, oldest first."""
    if not path_exists(spark, f"{path}/manifest"):
        return []
    return sorted(r[0] for r in spark.read.schema("n int, upto bigint").parquet(f"{path}/manifest").select("upto").distinct().collect())


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a table of batch folders that count, with their batch: the newest base and the batches after it."""
    bases, own = _bases(spark, path), _with_batch(schema)
    if not path_exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], own)
    rows = spark.read.schema(own).parquet(f"{path}/rows").select(*own.names)
    if not bases:
        return rows
    base = spark.read.schema(own).parquet(f"{path}/base/upto={bases[-1]}")
    return base.unionByName(rows.filter(F.col("batch") > bases[-1]))


def compact_batches(spark: SparkSession, path: str, schema: T.StructType, batch: int, combine: Callable[[DataFrame], DataFrame]) -> None:
    """Puts the combined rows of all batches up to `batch` into one base and lets go of what the base before covers.

    `combine` maps rows with their batch to rows without. Readers follow the manifest, which names the base once it is
    whole; folders go one compaction later, so that a reader of the base before still finds its own.
    """
    bases = _bases(spark, path)
    if bases and batch <= bases[-1]:
        return
    combined = combine(read_batches(spark, path, schema)).withColumn("batch", F.lit(batch).cast("bigint"))
    combined.select(*_with_batch(schema).names).write.mode("overwrite").parquet(f"{path}/base/upto={batch}")
    spark.range(1).select(F.lit(1).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/upto={batch}")
    if bases:
        for k in range(bases[-2] + 1 if len(bases) > 1 else 0, bases[-1] + 1):
            delete_path(spark, f"{path}/rows/batch={k}")
        for old in bases[:-1]:
            delete_path(spark, f"{path}/manifest/upto={old}")
            delete_path(spark, f"{path}/base/upto={old}")


def run_upserts(stream: DataFrame, path: str, keys: list[str] | None = None, compact_every: int | None = None) -> None:
    """Runs an update-mode stream; each batch is its own folder.

    A batch that is run again after a failure replaces its folder, so every update lands exactly once. With `keys`
    every so many batches are compacted to the latest row of each key, and older folders are deleted: a reader reads
    one row per key and the updates since.
    """
    every = compact_every or COMPACT_EVERY

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        if keys and batch % every == every - 1:
            latest = lambda rows: first_per_key(rows, keys, [F.desc("batch")]).drop("batch")
            compact_batches(df.sparkSession, path, stream.schema, batch, latest)

    run_batches(stream, path, write)


def read_upserts(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Latest row of each key of a table written by `run_upserts`."""
    return first_per_key(read_batches(spark, path, schema), keys, [F.desc("batch")]).drop("batch")


def stream_job_latest(events: DataFrame) -> DataFrame:
    """Newest event of every job, with a flag for jobs that are over; update mode."""
    newest = F.max(F.struct("timestamp", "event_id", "event_type", "status", "progress")).alias("e")
    latest = normalize_events(events).groupBy("job_id", "organization_id").agg(newest)
    return latest.select(
        "job_id", "organization_id", "e.*", F.col("e.status").isin(rules.FINAL_STATES).alias("is_final")
    )


def stream_daily_usage(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Usage per organization and day, from events as jobs end; update mode.

    Events later than the watermark are dropped with their day already closed.
    """
    kind = F.col("event_type")
    return (
        events.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 day").alias("w"), "organization_id")
        .agg(
            F.count_if(kind == "job_completed").alias("jobs_completed"),
            F.count_if(kind == "job_failed").alias("jobs_failed"),
            F.count_if(kind == "page_crawled").alias("pages_crawled"),
            F.count_if(kind == "qualification_started").alias("ai_qualifications"),
        )
        .select(
            "organization_id",
            F.to_date("w.start").alias("date"),
            "jobs_completed",
            "jobs_failed",
            "pages_crawled",
            "ai_qualifications",
        )
    )


TRANSITION_SCHEMA = (
    "job_id bigint, event_id bigint, timestamp timestamp, previous_status string, status string, allowed boolean"
)


def stream_transition_audit(events: DataFrame, watermark: str = "1 hour", keep: str | None = None) -> DataFrame:
    """Every status change of every job, marked allowed or not; append mode.

    The state of a job is its last status only. With `keep` (such as "7 days")
    a job without events for that long is forgotten; without it jobs are kept.
    The events of a job within one micro-batch are ordered in one task; where a
    job may be very busy, `run_transition_audit` gives the same rows.
    """
    moves = set(rules.JOB_MOVES)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["timestamp", "event_id"])
        rows["previous_status"] = rows["status"].shift(1)
        rows.iloc[0, rows.columns.get_loc("previous_status")] = last
        state.update((rows["status"].iloc[-1],))
        if keep_ms is not None:
            latest = int(rows["timestamp"].iloc[-1].timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep_ms)
        changed = rows[rows["previous_status"].notna() & (rows["previous_status"] != rows["status"])].copy()
        changed["allowed"] = [p in moves for p in zip(changed["previous_status"], changed["status"])]
        if len(changed):
            yield changed[["job_id", "event_id", "timestamp", "previous_status", "status", "allowed"]]

    timeout = GroupStateTimeout.EventTimeTimeout if keep_ms is not None else GroupStateTimeout.NoTimeout
    rows = normalize_events(events).withWatermark("timestamp", watermark)
    return (
        rows.select("job_id", "event_id", "timestamp", "status")
        .groupBy("job_id")
        .applyInPandasWithState(follow, TRANSITION_SCHEMA, "status string", "append", timeout)
    )


# A full copy of the kept state every so many batches bounds how far back a batch reads.
STATE_SPAN = 20


def read_state(spark: SparkSession, path: str, schema: str, batch: int, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """State of every job as it was before `batch`: the newest row per job since the last full copy."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    start = (batch - 1) // STATE_SPAN * STATE_SPAN
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    rows = rows.filter((F.col("batch") >= start) & (F.col("batch") < batch))
    return first_per_key(rows, list(keys), [F.desc("batch")]).drop("batch")


def write_state(updates: DataFrame, before: DataFrame, path: str, batch: int, done=None, keys: tuple[str, ...] = ("job_id",)) -> None:
    """Stores the jobs changed in `batch`, or all jobs when a full copy is due.

    The folder belongs to the batch, so a batch that runs again replaces its own rows. A full copy leaves out the jobs
    for which `done` holds, so that finished jobs do not stay for ever.
    """
    if batch and batch % STATE_SPAN == 0:
        updates = updates.unionByName(before.join(updates.select(*keys), list(keys), "left_anti"))
        if done is not None:
            updates = updates.filter(~F.coalesce(done, F.lit(False)))
    updates.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run_transition_audit(events: DataFrame, path: str, bucket: str = "hour", keep: str | None = None) -> None:
    """The transition audit for streams in which one job may hold much of the traffic.

    Same rows as `stream_transition_audit`, but each micro-batch runs the batch
    audit, which spreads a hot job over many tasks. The last status of each job
    in the batch comes in as an event ahead of all others. With `keep` (such as
    "7 days") a finished job is forgotten once the batch's newest event is that
    much later. Across batches the order is that of arrival: an event that comes
    after a later one of its job is audited as the newer.
    """
    schema = "job_id bigint, event_id bigint, timestamp timestamp, status string"

    def write(df: DataFrame, batch: int) -> None:
        rows = df.select("job_id", "event_id", "timestamp", "status").persist()
        try:
            before = read_state(df.sparkSession, f"{path}/state", schema, batch)
            ahead = before.join(rows.select("job_id").distinct(), "job_id", "left_semi").withColumn(
                "timestamp", F.lit("1000-01-01 00:00:00").cast("timestamp")
            )
            audit = transition_audit(rows.unionByName(ahead.select(*rows.columns)), bucket)
            audit.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
            last = rows.groupBy("job_id").agg(F.max(F.struct("timestamp", "event_id", "status")).alias("e"))
            updates = last.select("job_id", "e.event_id", "e.timestamp", "e.status")
            done = None
            if keep is not None:
                newest = rows.agg(F.max("timestamp")).head()[0]
                done = F.col("status").isin(rules.FINAL_STATES) & (F.col("timestamp") < F.lit(newest) - F.expr(f"INTERVAL {keep}"))
            write_state(updates, before.select(*updates.columns), f"{path}/state", batch, done)
        finally:
            rows.unpersist()

    run_batches(normalize_events(events), path, write, mode="append")


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{TRANSITION_SCHEMA}, batch bigint").parquet(f"{path}/rows").drop("batch")


ACTIVE_SCHEMA = "organization_id bigint, delta bigint"


def active_job_changes(events: DataFrame, watermark: str = "1 hour", keep: str | None = None) -> DataFrame:
    """(organization_id, delta): +1 or -1 for every job that starts or stops being active in a micro-batch, and 0 for a
    new job that is not active; append mode.

    A job's newest event and whether it was active are kept in the state store. With `keep` (such as "7 days") a job
    that is over and without events for that long is forgotten; an older event that comes later is then a new job's.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = tuple(state.get) if state.exists else None
        # A new job is a change of its organization even if it is not active.
        was = newest[2] if newest else None
        for rows in batches:
            best = max(zip(rows["at"].tolist(), rows["event_id"].tolist(), rows["active"].tolist()))
            newest = best if newest is None or best[:2] > newest[:2] else newest
        state.update(newest)
        if keep_ms is not None and not newest[2]:
            state.setTimeoutTimestamp(max(newest[0] // 1000, state.getCurrentWatermarkMs()) + keep_ms)
        if newest[2] != was:
            yield pd.DataFrame({"organization_id": [key[1]], "delta": [newest[2] - (was or 0)]})

    timeout = GroupStateTimeout.EventTimeTimeout if keep_ms is not None else GroupStateTimeout.NoTimeout
    rows = normalize_events(events).withWatermark("timestamp", watermark)
    active = F.coalesce(F.col("status").isin(rules.ACTIVE_STATES), F.lit(False)).cast("bigint").alias("active")
    own = rows.select("job_id", "organization_id", "event_id", "timestamp", F.unix_micros("timestamp").alias("at"), active)
    return own.groupBy("job_id", "organization_id").applyInPandasWithState(follow, ACTIVE_SCHEMA, "at bigint, event_id bigint, active bigint", "append", timeout)


def stream_active_jobs(events: DataFrame, path: str, compact_every: int | None = None) -> None:
    """Stores, per batch, the change in running jobs per organization.

    The same changes as `active_job_changes`, by joins of a batch's newest event of each job with the one kept for it.
    """
    every, keys = compact_every or COMPACT_EVERY, ("job_id", "organization_id")
    schema = "job_id bigint, organization_id bigint, timestamp timestamp, event_id bigint, active bigint"
    total = lambda rows: rows.groupBy("organization_id").agg(F.sum("delta").alias("delta"))
    active = F.coalesce(F.col("status").isin(rules.ACTIVE_STATES), F.lit(False)).cast("bigint")

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        new = df.groupBy(*keys).agg(F.max(F.struct("timestamp", "event_id", active.alias("active"))).alias("new"))
        before = read_state(spark, f"{path}/state", schema, batch, keys)
        old = before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("timestamp", "event_id", "active").alias("old"))
        both = new.join(old, F.col("job_id").eqNullSafe(F.col("_job_id")) & F.col("organization_id").eqNullSafe(F.col("_organization_id")), "left")
        moment = lambda name: F.struct(f"{name}.timestamp", f"{name}.event_id")
        now = F.when(F.col("old").isNull() | (moment("new") > moment("old")), F.col("new")).otherwise(F.col("old"))
        # A new job is a change of its organization even if it is not active.
        delta = F.when(F.col("old").isNull(), now["active"]).when(now["active"] != F.col("old.active"), now["active"] - F.col("old.active"))
        rows = both.select(*keys, now.alias("now"), delta.alias("delta")).persist()
        try:
            total(rows.filter(F.col("delta").isNotNull())).write.mode("overwrite").parquet(f"{path}/counts/rows/batch={batch}")
            write_state(rows.select(*keys, "now.*"), before, f"{path}/state", batch, keys=keys)
        finally:
            rows.unpersist()
        if batch % every == every - 1:
            compact_batches(spark, f"{path}/counts", T.StructType.fromDDL(ACTIVE_SCHEMA), batch, total)

    run_batches(normalize_events(events), path, write, mode="append")


def read_active_jobs(spark: SparkSession, path: str, limit: int = rules.MAX_ACTIVE_JOBS) -> DataFrame:
    deltas = read_batches(spark, f"{path}/counts", T.StructType.fromDDL(ACTIVE_SCHEMA))
    counts = deltas.groupBy("organization_id").agg(F.sum("delta").alias("active_jobs"))
    return counts.withColumn("exceeded", F.col("active_jobs") >= limit)


def stream_submit_dedupe(requests: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First request of each key; repeats within the watermark are dropped.

    requests: idempotency_key, requested_at and further columns.
    """
    return requests.withWatermark("requested_at", watermark).dropDuplicatesWithinWatermark(["idempotency_key"])
