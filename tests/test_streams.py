"""Streams in several micro-batches against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospark.functions.skew import first_per_key
from prospark.operators import jobs as jb
from prospark.plans import catalog
from prospark.sources.entities import Entities
from prospark.streaming import events as st
from prospark.streaming import ordered as st_ordered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def event_dir(spark, tmp_path_factory):
    """The events in five files, written in time order."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = Entities(spark, SF).job_events()
    for day in range(5):
        part = rows.filter(F.floor((F.dayofmonth("timestamp") - 1) / 7) == day)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, event_dir):
    return st.read_events(spark, event_dir, files_per_batch=1)


def twin(spark):
    return jb.normalize_events(Entities(spark, SF).job_events())


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    assert sorted(map(key, a.select(*cols).collect())) == sorted(map(key, b.select(*cols).collect()))


@pytest.mark.parametrize("span", [20, 2])
def test_transitions_by_batch(spark, event_dir, tmp_path, monkeypatch, span):
    monkeypatch.setattr(st, "STATE_SPAN", span)
    path = str(tmp_path)
    st.run_transition_audit(stream(spark, event_dir), path)
    same(st.read_transitions(spark, path), jb.transition_audit(twin(spark)))


def test_transitions_by_state(spark, event_dir, tmp_path):
    path = str(tmp_path)
    out = st.stream_transition_audit(stream(spark, event_dir))
    st.run_to_table(out, path)
    same(spark.read.schema(out.schema).parquet(f"{path}/rows"), jb.transition_audit(twin(spark)))


def test_latest_and_active(spark, event_dir, tmp_path):
    out = st.stream_job_latest(stream(spark, event_dir))
    st.run_upserts(out, f"{tmp_path}/latest")
    latest = st.read_upserts(spark, f"{tmp_path}/latest", out.schema, ["job_id"])
    want = twin(spark).groupBy("job_id").agg(F.max(F.struct("timestamp", "event_id", "status")).alias("e"))
    same(latest.select("job_id", "event_id", "status"), want.select("job_id", "e.event_id", "e.status"))

    st.stream_active_jobs(stream(spark, event_dir), f"{tmp_path}/active")
    got = {r.organization_id: r.active_jobs for r in st.read_active_jobs(spark, f"{tmp_path}/active").collect()}
    busy = latest.groupBy("organization_id").agg(F.count_if(F.col("status").isin("QUEUED", "RUNNING")).alias("n"))
    assert got == {r.organization_id: r.n for r in busy.collect()}


def test_daily_usage(spark, event_dir, tmp_path):
    out = st.stream_daily_usage(stream(spark, event_dir))
    st.run_upserts(out, str(tmp_path))
    got = st.read_upserts(spark, str(tmp_path), out.schema, ["organization_id", "date"])
    day = F.to_date("timestamp").alias("date")
    want = twin(spark).groupBy("organization_id", day).agg(F.count_if(F.col("event_type") == "job_failed").alias("jobs_failed"))
    same(got.select("organization_id", "date", "jobs_failed"), want)


def test_submit_dedupe(spark, event_dir, tmp_path):
    requests = stream(spark, event_dir).select(
        F.col("job_id").cast("string").alias("idempotency_key"), F.col("timestamp").alias("requested_at")
    )
    out = st.stream_submit_dedupe(requests, "60 days")
    st.run_to_table(out, str(tmp_path))
    keys = [r[0] for r in spark.read.parquet(f"{tmp_path}/rows").select("idempotency_key").collect()]
    assert len(keys) == len(set(keys)) == twin(spark).select("job_id").distinct().count()


def test_finished_jobs_leave_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "STATE_SPAN", 2)
    days = [
        [(1, 1, "job_created"), (2, 2, "job_created"), (3, 1, "job_completed")],
        [(4, 2, "page_crawled"), (5, 3, "job_created")],
        [(6, 2, "page_crawled")],
        [(7, 4, "job_created"), (8, 4, "job_failed")],
        [(9, 2, "job_completed")],
    ]
    for day, events in enumerate(days):
        rows = [(i, j, 1, kind, 0, None, dt.datetime(2024, 1, 1 + 3 * day, 0, i)) for i, j, kind in events]
        spark.createDataFrame(rows, st.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    st.run_transition_audit(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", keep="5 days")
    state = {r.job_id: r.status for r in spark.read.parquet(f"{tmp_path}/out/state/batch=4").collect()}
    # Job 1 ended long before the newest event; 4 ended lately, 2 just now, and 3 is not over.
    assert state == {2: "COMPLETED", 3: "QUEUED", 4: "FAILED"}
    assert st.read_transitions(spark, f"{tmp_path}/out").count() == 4


def test_reading_upserts_leaves_the_schema_alone(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "job_id long, v long")
    df.write.parquet(f"{tmp_path}/rows/batch=0")
    schema = df.schema
    assert st.read_upserts(spark, str(tmp_path), schema, ["job_id"]).columns == ["job_id", "v"] == schema.names


def test_compaction_bounds_what_is_read(spark, tmp_path):
    """One row per key and the updates since, whatever the number of batches; a batch that runs again changes nothing."""
    path, schema = str(tmp_path), T.StructType.fromDDL("k long, v long")
    newest = lambda rows: first_per_key(rows, ["k"], [F.desc("batch")]).drop("batch")
    write = lambda b: spark.createDataFrame([(b % 3, b), (10, b)], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/rows/batch={b}")
    for b in range(28):
        write(b)
        if b % 7 == 6:
            st.compact_batches(spark, path, schema, b, newest)
    st.compact_batches(spark, path, schema, 27, newest)
    write(27)
    assert {tuple(r) for r in st.read_upserts(spark, path, schema, ["k"]).collect()} == {(0, 27), (1, 25), (2, 26), (10, 27)}
    assert st.read_batches(spark, path, schema).count() == 4
    kept = sorted(int(d.name.split("=")[1]) for d in (tmp_path / "rows").iterdir() if d.name.startswith("batch="))
    assert kept == list(range(21, 28)) and len([d for d in (tmp_path / "base").iterdir() if d.name.startswith("upto=")]) == 2
    write(28)
    assert {tuple(r) for r in st.read_upserts(spark, path, schema, ["k"]).collect()} == {(0, 27), (1, 28), (2, 26), (10, 28)}
    assert st.read_upserts(spark, f"{path}/none", schema, ["k"]).count() == 0


def test_streams_with_compaction_equal_those_without(spark, event_dir, tmp_path):
    out = st.stream_job_latest(stream(spark, event_dir))
    st.run_upserts(out, f"{tmp_path}/a")
    st.run_upserts(st.stream_job_latest(stream(spark, event_dir)), f"{tmp_path}/b", ["job_id"], compact_every=2)
    same(st.read_upserts(spark, f"{tmp_path}/a", out.schema, ["job_id"]), st.read_upserts(spark, f"{tmp_path}/b", out.schema, ["job_id"]))
    st.stream_active_jobs(stream(spark, event_dir), f"{tmp_path}/c")
    st.stream_active_jobs(stream(spark, event_dir), f"{tmp_path}/d", compact_every=2)
    same(st.read_active_jobs(spark, f"{tmp_path}/c"), st.read_active_jobs(spark, f"{tmp_path}/d"))


def test_active_jobs_with_late_events_and_forgetting(spark, tmp_path):
    """An older event that comes later changes nothing; a job that is over leaves the state."""
    files = [
        [(1, 1, "job_created", 1, 0), (2, 2, "job_created", 1, 0)],
        [(3, 1, "job_completed", 1, 9), (4, 2, "page_crawled", 1, 9)],
        [(5, 1, "page_crawled", 1, 5), (6, 3, "job_failed", 1, 10)],
        [(7, 2, "job_completed", 20, 0)],
        [(8, 4, "job_created", 20, 1)],
    ]
    for events in files:
        rows = [(i, j, 7, kind, 0, None, dt.datetime(2024, 1, day, hour)) for i, j, kind, day, hour in events]
        spark.createDataFrame(rows, st.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    path = f"{tmp_path}/out"
    changes = st.active_job_changes(stream(spark, f"{tmp_path}/in"), keep="2 days")
    st.run_batches(changes, path, lambda df, b: seen.append(sorted(r["delta"] for r in df.collect())), mode="append")
    assert seen[:5] == [[1, 1], [-1], [0], [-1], [1]]
    state = spark.read.format("statestore").load(f"{path}/_stream").select("key.job_id").collect()
    assert {r[0] for r in state} == {2, 4}


def test_ordered_audit_of_shuffled_files(spark, tmp_path):
    """Files of one hour each arrive in any order within the watermark; the audit is that of the whole table."""
    rows = Entities(spark, SF).job_events()
    rng = random.Random(5)
    order = sorted(range(24), key=lambda k: k + rng.uniform(0, 4))
    for k in order:
        rows.filter(F.floor(F.unix_seconds("timestamp") / 3600) % 24 == k).withColumn("timestamp", F.expr("timestamp_seconds(unix_seconds(timestamp) % 86400 + 1704067200)")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    day = rows.withColumn("timestamp", F.expr("timestamp_seconds(unix_seconds(timestamp) % 86400 + 1704067200)"))
    end = spark.createDataFrame([(-1, -1, -1, "page_crawled", 0, None, dt.datetime(2024, 1, 9))], st.EVENT_SCHEMA)
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = st_ordered.stream_ordered_audit(stream(spark, f"{tmp_path}/in"), "8 hours")
    with st_ordered.ordered_audit_conf(spark):
        st.run_to_table(out, f"{tmp_path}/out")
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out/rows")
    assert order != sorted(order)
    same(got, jb.transition_audit(jb.normalize_events(day)))


@pytest.mark.parametrize("name", ["stream_transition_audit", "stream_active_jobs", "stream_ordered_audit"])
def test_queries_of_streams_call_no_python_per_job(spark, name, monkeypatch):
    """What a job costs must not grow by calls of Python: state is joined, not followed job by job."""

    def per_job(*args, **more):
        raise AssertionError("a stateful Python operator")

    for kind in ("applyInPandasWithState", "transformWithStateInPandas"):
        monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.groupBy", _without(kind, per_job))
        assert catalog.QUERIES[name](spark, SF).count() > 0
        monkeypatch.undo()


def _without(kind, fails):
    from pyspark.sql.classic.dataframe import DataFrame

    grouped = DataFrame.groupBy

    def group_by(self, *cols):
        out = grouped(self, *cols)
        setattr(out, kind, fails)
        return out

    return group_by


def test_ordered_audit_by_joins(spark, tmp_path):
    """Shuffled files within the watermark, ties of time, and an event that comes too late."""
    rows = Entities(spark, SF).job_events()
    day = rows.withColumn("timestamp", F.expr("timestamp_seconds(unix_seconds(timestamp) % 86400 + 1704067200)"))
    for k in (2, 0, 1, 3):
        day.filter(F.floor(F.hour("timestamp") / 6) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([(-2, 1, 1, "job_failed", 0, None, dt.datetime(2023, 12, 1)), (-1, -1, -1, "page_crawled", 0, None, dt.datetime(2024, 1, 9))], st.EVENT_SCHEMA)
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    st_ordered.run_ordered_audit(stream(spark, f"{tmp_path}/in"), str(tmp_path / "out"), "18 hours")
    same(st.read_transitions(spark, str(tmp_path / "out")), jb.transition_audit(jb.normalize_events(day)))
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/out/waiting/batch=4").select("event_id").collect()] == [-1]
