"""Snapshot tables in buckets: equal to one whole change, small writes for small batches, safe when a batch fails."""

import os
import random

import pytest
from pyspark.sql import functions as F

from prospark.operators import lifecycle as lc
from prospark.sources.snapshots import change_snapshot, create_snapshots, expire_snapshots, manifest, read_snapshot

SCHEMA = "lead_id long, signal string, evidence string"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def replace(old, new):
    return lc.replace_signals(old, new, new)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_batches_equal_whole_changes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(300)]), f"s{i}", "x" * rng.randint(0, 30)) for i in range(2000)]
    table = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "t")
    create_snapshots(table, path, "lead_id", buckets=8)
    assert rows_of(read_snapshot(spark, path)) == rows_of(table)
    want = table
    for k in range(3):
        batch = spark.createDataFrame([(rng.choice([5 * k, 290 + k, 1000 + k]), "new", str(i)) for i in range(6)], SCHEMA)
        touched = change_snapshot(path, batch, replace)
        assert 1 <= len(touched) <= 3
        want = replace(want, batch)
        assert rows_of(read_snapshot(spark, path)) == rows_of(want) and manifest(spark, path).version == k + 1
    assert rows_of(read_snapshot(spark, path, batch).filter("lead_id = 1002")) == rows_of(want.filter("lead_id = 1002"))
    expire_snapshots(spark, path, keep=1)
    assert rows_of(read_snapshot(spark, path)) == rows_of(want) and os.listdir(f"{path}/manifest").count("version=3") == 1


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    create_snapshots(spark.range(40_000).select(F.col("id").alias("lead_id"), F.lit("s").alias("signal"), F.sha2(F.col("id").cast("string"), 256).alias("evidence")), path, "lead_id", buckets=64)
    whole = size(f"{path}/files/since=0")
    assert change_snapshot(path, spark.createDataFrame([(7, "n", "e")], SCHEMA), replace) != []
    assert size(f"{path}/files/since=1") < whole / 20
    assert read_snapshot(spark, path).count() == 40_000


def test_buckets_that_empty_and_batches_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", None), (None, "b", "x")], SCHEMA)
    create_snapshots(one, path, "lead_id", buckets=4)
    assert change_snapshot(path, one.limit(0), replace) == [] and manifest(spark, path).version == 0
    change_snapshot(path, one.filter("lead_id = 1"), lambda old, ids: old.join(ids.select("lead_id"), "lead_id", "left_anti"))
    assert [tuple(r) for r in read_snapshot(spark, path).collect()] == [(None, "b", "x")]
    create_snapshots(one.limit(0), str(tmp_path / "none"), "lead_id")
    assert read_snapshot(spark, str(tmp_path / "none")).count() == 0
    change_snapshot(str(tmp_path / "none"), one, replace)
    assert read_snapshot(spark, str(tmp_path / "none")).count() == 2


def test_failures_leave_the_table_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([(i, "a", "x") for i in range(50)], SCHEMA)
    create_snapshots(table, path, "lead_id", buckets=16)
    batch = table.filter("lead_id = 3")
    with pytest.raises(ValueError):
        change_snapshot(path, batch, lambda old, new: old.unionByName(new.withColumn("lead_id", F.explode(F.sequence(F.lit(100), F.lit(200))))))
    with pytest.raises(Exception):
        change_snapshot(path, batch, lambda old, new: old.withColumn("signal", F.raise_error(F.lit("no"))))
    assert rows_of(read_snapshot(spark, path)) == rows_of(table)
    change_snapshot(path, batch, replace)
    assert read_snapshot(spark, path).count() == 50 and manifest(spark, path).version == 1


def test_latency_percentiles_by_merged_days(spark):
    from prospark.operators import analytics as an

    rng = random.Random(1)
    rows = [("p", rng.choice("ab"), None if i % 50 == 0 else rng.expovariate(0.01), f"2024-01-{1 + i % 9:02d} 10:00:00") for i in range(9000)]
    audits = spark.createDataFrame(rows, "provider string, model string, latency_ms double, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    days = an.latency_sketches(audits)
    for first, last in ((None, None), ("2024-01-03", "2024-01-05"), (None, "2024-01-01")):
        for r in an.latency_percentiles(days, first, last, {"p50": 0.5, "p95": 0.95}).collect():
            own = sorted(x for _, m, x, d in rows if m == r["model"] and x is not None and (first or "") <= d[:10] <= (last or "9"))
            assert r["timed_calls"] == len(own)
            for name, q in (("p50", 0.5), ("p95", 0.95)):
                rank = sum(x <= r[name] + 0.005 for x in own) / len(own)
                assert abs(rank - q) <= 0.015
    assert an.latency_percentiles(days, "2030-01-01").count() == 0
