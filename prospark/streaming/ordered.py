"""The status changes of jobs in the order of event time, whatever the order of arrival.

Events wait in their job's state until the watermark has passed them, and are then audited oldest first. So an event
that arrives after a later one of its job, in the same micro-batch or many later, still takes its place, as long as it
is not later than the watermark allows; what comes after that is dropped, as in every watermarked stream.

The state of a job is its last audited status, the waiting events and one timer for the earliest of them. It needs the
RocksDB state store (`ordered_audit_conf`). The events of one job are ordered in one task; `run_transition_audit`
spreads a busy job, in the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prospark import rules
from prospark.operators.jobs import normalize_events, transition_audit
from prospark.session import delete_path
from prospark.streaming.events import read_state, run_batches, write_state

_AUDIT = "job_id bigint, event_id bigint, at bigint, previous_status string, status string, allowed boolean"
_NAMES = [c.split()[0] for c in _AUDIT.split(", ")]


@contextmanager
def ordered_audit_conf(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and lists need, for streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class OrderedAudit(StatefulProcessor):
    """Holds a job's events back until the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")
        self.due = handle.getValueState("due", "at_ms bigint")
        self.waiting = handle.getListState("waiting", "at bigint, event_id bigint, status string")

    def _wake(self, at_ms: int) -> None:
        """One timer, for the earliest waiting event."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or at_ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at_ms)
            self.due.update((at_ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for pdf in rows for x in zip(pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["status"].tolist())]
        self.waiting.appendList(new)
        self._wake(min(new)[0] // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted(tuple(x) for x in self.waiting.get())
        ready = [x for x in events if x[0] <= passed * 1000]
        left = events[len(ready) :]
        self.due.clear()
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self._wake(left[0][0] // 1000)
        status, out = self.last.get()[0] if self.last.exists() else None, []
        for at, event, now in ready:
            if status is not None and now != status:
                out.append((key[0], event, at, status, now, (status, now) in set(rules.JOB_MOVES)))
            status = now
        if ready:
            self.last.update((status,))
        return iter([pd.DataFrame(out, columns=_NAMES)] if out else [])

    def close(self) -> None:
        pass


def stream_ordered_audit(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Every status change of every job in the order of event time, marked allowed or not; append mode."""
    rows = normalize_events(events).withWatermark("timestamp", watermark)
    slim = rows.select("job_id", "event_id", "status", "timestamp", F.unix_micros("timestamp").alias("at"))
    made = slim.groupBy("job_id").transformWithStateInPandas(OrderedAudit(), _AUDIT, "append", "eventTime")
    return made.select("job_id", "event_id", F.timestamp_micros("at").alias("timestamp"), "previous_status", "status", "allowed")


def run_ordered_audit(events: DataFrame, path: str, watermark: str = "1 hour", bucket: str = "day") -> None:
    """`stream_ordered_audit` for many jobs: the same rows by joins and windows, read by `read_transitions`.

    After each micro-batch the events that the watermark has passed are audited in event time, behind the last status
    of their jobs; the others wait in the table of the next batch. Events that the watermark passed before they came
    are dropped. A batch that runs again replaces its own rows.
    """
    schema = "job_id bigint, event_id bigint, timestamp timestamp, status string"

    def write(df: DataFrame, batch: int) -> None:
        spark, delay = df.sparkSession, F.expr(f"INTERVAL {watermark}")
        rows = df.select("job_id", "event_id", "timestamp", "status").persist()
        try:
            own = rows.agg(F.max("timestamp").alias("high"))
            highest = lambda df: df.select(F.max("high").alias("high"), (F.max("high") - delay).alias("passed")).head()
            pool, late = rows, None
            if batch:
                seen = spark.read.schema("high timestamp").parquet(f"{path}/seen/batch={batch - 1}")
                late, own = highest(seen)["passed"], own.union(seen)
                fresh = rows if late is None else rows.filter(F.col("timestamp") > F.lit(late))
                pool = fresh.union(spark.read.schema(schema).parquet(f"{path}/waiting/batch={batch - 1}"))
            top = highest(own)
            passed = F.lit(False) if top["passed"] is None else F.col("timestamp") <= F.lit(top["passed"])
            ready = pool.filter(passed)
            before = read_state(spark, f"{path}/state", schema, batch)
            ahead = before.join(ready.select("job_id").distinct(), "job_id", "left_semi").withColumn(
                "timestamp", F.lit("1000-01-01 00:00:00").cast("timestamp")
            )
            audit = transition_audit(ready.unionByName(ahead.select(*rows.columns)), bucket)
            audit.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
            last = ready.groupBy("job_id").agg(F.max(F.struct("timestamp", "event_id", "status")).alias("e"))
            write_state(last.select("job_id", "e.event_id", "e.timestamp", "e.status"), before.select(*rows.columns), f"{path}/state", batch)
            pool.filter(~passed).write.mode("overwrite").parquet(f"{path}/waiting/batch={batch}")
            spark.createDataFrame([(top["high"],)], "high timestamp").coalesce(1).write.mode("overwrite").parquet(f"{path}/seen/batch={batch}")
            if batch > 1:
                delete_path(spark, f"{path}/waiting/batch={batch - 2}")
        finally:
            rows.unpersist()

    run_batches(normalize_events(events), path, write, mode="append")
