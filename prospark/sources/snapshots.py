"""Stored tables that take batches of changes and rewrite only what a batch touches.

Rows are dealt into a fixed number of buckets by a hash of their key. A change reads the live files of the buckets in
which the batch has keys, writes these buckets anew, and then adds a manifest, one small file that names the live files
of every bucket; readers follow the newest manifest. What a batch costs follows the buckets it touches and not the
table, and until its manifest stands nothing of a batch is seen: one that fails halfway can be run again.

One writer at a time: a second one that starts from the same version fails when it adds its manifest. Files that no
kept manifest names are deleted by `expire_snapshots` alone.

Defined cases: a null key is a key like any other; a batch without rows adds no version; a bucket without rows has no
files; a change that gives a row outside the batch's buckets raises and adds no version.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospark.session import cut_lineage, delete_path

_MANIFEST = "key string, buckets int, fields string, live array<struct<bucket:int, since:long>>, version long"


@dataclass(frozen=True)
class Manifest:
    """One version of a table: its key, its schema, and the version in which each bucket was last written."""

    version: int
    key: str
    buckets: int
    schema: T.StructType
    live: dict[int, int]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest version of the table at `path`."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    r = rows.orderBy(F.desc("version")).limit(1).head()
    if r is None:
        raise ValueError(f"no table at {path}")
    return Manifest(r["version"], r["key"], r["buckets"], T.StructType.fromJson(json.loads(r["fields"])), {x["bucket"]: x["since"] for x in r["live"]})


def _commit(spark: SparkSession, path: str, m: Manifest) -> None:
    live = [(b, s) for b, s in sorted(m.live.items())]
    one = spark.createDataFrame([(m.key, m.buckets, m.schema.json(), live)], _MANIFEST.rsplit(", ", 1)[0])
    one.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={m.version}")


def _write(rows: DataFrame, path: str, m: Manifest, version: int) -> set[int]:
    """Writes rows as files of a version and returns the buckets that have some."""
    folder = f"{path}/files/since={version}"
    own = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in m.schema.fields])
    # Rebalanced by bucket: a bucket with very many rows is split over tasks, small ones share one.
    own.withColumn("_bucket", _bucket(m.key, m.buckets)).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
    schema = T.StructType([*m.schema.fields, T.StructField("_bucket", T.IntegerType())])
    return {r[0] for r in rows.sparkSession.read.schema(schema).parquet(folder).select("_bucket").distinct().collect()}


def _read(spark: SparkSession, path: str, m: Manifest, buckets: list[int]) -> DataFrame:
    paths = [f"{path}/files/since={m.live[b]}/_bucket={b}" for b in buckets if b in m.live]
    if not paths:
        return spark.createDataFrame([], m.schema)
    return spark.read.schema(m.schema).parquet(*paths)


def create_snapshots(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Version 0 of a table of `rows`, in `buckets` buckets of `key`."""
    # Stored columns may be missing whatever the first rows say.
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    m = Manifest(0, key, buckets, schema, {})
    _commit(rows.sparkSession, path, Manifest(0, key, buckets, schema, dict.fromkeys(_write(rows, path, m, 0), 0)))


def read_snapshot(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The table at its newest version; with `keys` only the buckets in which they can be."""
    m = manifest(spark, path)
    wanted = m.live if keys is None else {r[0] for r in keys.select(_bucket(m.key, m.buckets)).distinct().collect()}
    return _read(spark, path, m, sorted(wanted))


def change_snapshot(path: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Applies `change(stored rows, batch)` to the buckets of the batch's keys; returns the rewritten buckets.

    `change` is any of the snapshot operators that take stored rows and change rows and give the next rows.
    """
    spark = batch.sparkSession
    m, batch = manifest(spark, path), cut_lineage(batch)
    touched = sorted(r[0] for r in batch.select(_bucket(m.key, m.buckets)).distinct().collect())
    if not touched:
        return []
    wrote = _write(change(_read(spark, path, m, touched), batch), path, m, m.version + 1)
    if not wrote <= set(touched):
        raise ValueError("a change must keep to the keys of its batch")
    live = {b: s for b, s in m.live.items() if b not in touched} | dict.fromkeys(wrote, m.version + 1)
    _commit(spark, path, Manifest(m.version + 1, m.key, m.buckets, m.schema, live))
    return touched


def expire_snapshots(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the newest `keep` manifests and the files that none of these names."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("version", "live").orderBy("version").collect()
    gone, kept = rows[:-keep], rows[-keep:]
    named = {(x["bucket"], x["since"]) for r in kept for x in r["live"]}
    for r in gone:
        delete_path(spark, f"{path}/manifest/version={r['version']}")
        for x in r["live"]:
            if (x["bucket"], x["since"]) not in named:
                delete_path(spark, f"{path}/files/since={x['since']}/_bucket={x['bucket']}")
