"""A stored index of three-letter runs for searches inside texts.

Every row's texts give their distinct runs of three characters (lower case). They are stored as postings in buckets of
runs, one row per run and block of rows with the keys of the rows that have it, and how many rows each run has. A search
looks up the runs of its literal parts, takes the few rarest, and intersects their postings: only rows that have all of
them can match, and these are verified by the search itself. Patterns keep the wildcards of ILIKE; one without three
literal ASCII characters in a row has no candidates to offer and is searched in all rows.

Defined cases: null and short texts have no runs; a run that no row has means that nothing can match; repeated rows
are one row in every answer of the index; an empty table gives an empty index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospark.operators.scope import LeadFilter, filter_leads
from prospark.sources.snapshots import read_snapshot

SEARCHED = ("company_name", "domain", "industry", "company_summary", "value_proposition")
BUCKETS = 64
SLICES = 4
#: Postings that a search intersects: the rarest of its runs.
MOST_RUNS = 4
#: Bytes of text whose runs are brought together at once; one longer row is a block of its own.
BLOCK_BYTES = 1 << 21
#: A run is one number of three code points.
POINT_BITS = 21


def _code(a, b, c):
    return a << 2 * POINT_BITS | b << POINT_BITS | c


def run_code(run: str) -> int:
    return _code(*map(ord, run))


def _bucket(run: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(buckets)).cast("int")


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in order, and how many each text has (null: none)."""
    given = [t or "" for t in texts.to_pylist()]
    return np.frombuffer("".join(given).encode("utf-32-le"), np.uint32), np.fromiter(map(len, given), np.int64, len(given))


def _block_runs(columns: Sequence[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(runs, ends, rows): distinct runs of some rows and, up to each end, the rows that have them."""
    found = []
    for texts in columns:
        points, sizes = _code_points(texts)
        row, last = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
        at = np.flatnonzero(np.arange(len(points)) + 2 < last)
        found.append((points[at], points[at + 1], points[at + 2], row[at]))
    first, second, third, row = (np.concatenate(x) for x in zip(*found))
    if not len(row):
        return
    # Characters are numbered in order of their code points, so that a run and its row fit one number to sort by.
    known = np.unique(np.concatenate([first, second, third]))
    bits, row_bits = max(int(len(known) - 1).bit_length(), 1), int(row.max()).bit_length()
    if 3 * bits + row_bits > 63:
        half = (int(row.max()) + 1) // 2
        for start, n in ((0, half), (half, len(columns[0]) - half)):
            yield from ((r, e, x + start) for r, e, x in _block_runs([c.slice(start, n) for c in columns]))
        return
    number = np.zeros(int(known[-1]) + 1, np.int64)
    number[known] = np.arange(len(known))
    packed = np.sort((number[first] << 2 * bits | number[second] << bits | number[third]) << row_bits | row)
    packed = packed[np.flatnonzero(np.diff(packed, prepend=-1))]
    run, row = packed >> row_bits, packed & ((1 << row_bits) - 1)
    ends = np.append(np.flatnonzero(np.diff(run)) + 1, len(run))
    run, mask, points = run[ends - 1], (1 << bits) - 1, known.astype(np.int64)
    yield _code(points[run >> 2 * bits], points[run >> bits & mask], points[run & mask]), ends, row


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, key, texts) as rows (run, keys), block by block."""
    for batch in batches:
        block = np.cumsum(batch.column(0).to_numpy(zero_copy_only=False)) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            for runs, ends, rows in _block_runs(part.columns[2:]):
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                keys = pa.ListArray.from_arrays(offsets, part.column(1).take(pa.array(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(runs), keys], ["run", "keys"])


def build_text_index(rows: DataFrame, path: str, key: str = "lead_id", columns: Sequence[str] = SEARCHED) -> None:
    """Writes postings and counts of all texts of `rows` below `path`."""
    spark = rows.sparkSession
    texts = [F.coalesce(F.lower(c), F.lit("")).alias(f"text_{i}") for i, c in enumerate(columns)]
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in columns])
    kind = rows.schema[key].dataType.simpleString()
    packed = rows.select(size.alias("size"), F.col(key).alias("key"), *texts).mapInArrow(_postings, f"run bigint, keys array<{kind}>")
    postings = packed.withColumn("bucket", _bucket(F.col("run")))
    # A bucket is written by a few tasks, by key, so that a run that very many rows have is not one task's.
    slice_ = F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(SLICES))
    postings.repartition("bucket", slice_).sortWithinPartitions("bucket", "run").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(postings.schema).parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "run").agg(F.sum(F.size("keys").cast("bigint")).alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "run").write.partitionBy("bucket").parquet(f"{path}/counts")


def literal_runs(text: str) -> list[str]:
    """Runs that every match of %text% has: of its parts between wildcards, in ASCII characters."""
    parts = re.split(r"\\.?|[%_]|[^\x00-\x7f]", text.strip().lower())
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


def candidates(spark: SparkSession, path: str, text: str, key_type: str = "bigint") -> DataFrame | None:
    """(key) of the rows that have the rarest runs of a search text; None if it has no run to look up."""
    wanted = literal_runs(text)
    if not wanted:
        return None

    codes = {run_code(r): r for r in wanted}

    def own(kind: str, schema: str, runs: list[int]) -> DataFrame:
        buckets = list(spark.range(1).select(*[_bucket(F.lit(r).cast("bigint")) for r in runs]).first())
        rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{kind}")
        return rows.where(F.col("bucket").isin(buckets) & F.col("run").isin(runs))

    counts = {codes[r["run"]]: r["n"] for r in own("counts", "run bigint, n bigint", list(codes)).collect()}  # at most one row per run
    if len(counts) < len(wanted):
        return spark.createDataFrame([], f"key {key_type}")
    rarest = [run_code(r) for r in sorted(wanted, key=lambda r: (counts[r], r))[:MOST_RUNS]]
    postings = own("postings", f"run bigint, keys array<{key_type}>", rarest)
    place = reduce(lambda other, i: other.when(F.col("run") == rarest[i], 1 << i), range(1, len(rarest)), F.when(F.col("run") == rarest[0], 1))
    found = postings.select(F.explode("keys").alias("key"), place.alias("place")).groupBy("key").agg(F.bit_or("place").alias("places"))
    return found.where(F.col("places") == (1 << len(rarest)) - 1).select("key")


def search_stored(spark: SparkSession, table: str, index: str, f: LeadFilter) -> DataFrame:
    """`filter_leads` over a snapshot table of leads by lead_id; texts are read in the candidates' buckets only."""
    found = candidates(spark, index, f.search or "")
    if found is None:
        return filter_leads(read_snapshot(spark, table), f)
    keys = found.withColumnRenamed("key", "lead_id")
    return filter_leads(read_snapshot(spark, table, keys).join(keys, "lead_id", "left_semi"), f)
