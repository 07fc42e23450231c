"""Vector work inside tasks: numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Distances closer than this many decimals count as equal and are ordered by id,
# so the summation order of the vector products never decides a rank.
TIE_DIGITS = 9


def unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def cosine_distance(query_vec: Sequence[float]):
    """Column function: cosine distance of a vector column to one given vector."""
    q = np.asarray(query_vec, dtype=np.float64)
    q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        return pd.Series(np.round(1.0 - unit_rows(v) @ q, TIE_DIGITS))

    return distance


def hyperplane_buckets(dim: int, bits: int, tables: int, seed: int = 7):
    """Column function: one bucket number per table, from the signs of random projections."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def buckets(v: pd.Series) -> pd.Series:
        signs = (unit_rows(v) @ planes > 0).reshape(len(v), tables, bits)
        return pd.Series(list((signs * weights).sum(axis=2).astype(np.int32)))

    return buckets


def nearest_in_block(k: int, skip_self: bool, chunk: int = 256):
    """Cogroup function: the `k` nearest corpus vectors of every query of one block pair."""

    def run(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(corpus):
            ids = corpus["lead_id"].to_numpy()
            c, q = unit_rows(corpus["embedding"]).T, unit_rows(queries["vector"])
            qids = queries["query_id"].to_numpy()
            for start in range(0, len(q), chunk):
                some = qids[start : start + chunk]
                d = np.round(1.0 - q[start : start + chunk] @ c, TIE_DIGITS)
                if skip_self:
                    d[some[:, None] == ids[None, :]] = np.inf
                n = min(k, d.shape[1])
                limit = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                row, col = np.nonzero((d <= limit) & np.isfinite(d))
                part = pd.DataFrame({"query_id": some[row], "lead_id": ids[col], "distance": d[row, col]})
                part = part.sort_values(["query_id", "distance", "lead_id"])
                found.append(part.groupby("query_id").head(k))
        if not found:
            return pd.DataFrame({"query_id": [], "lead_id": [], "distance": []}).astype(
                {"query_id": "int64", "lead_id": "int64", "distance": "float64"}
            )
        return pd.concat(found)

    return run


#: Numbers in a packed block of vectors (8 bytes each); candidates whose exact distance is taken at once.
BLOCK_NUMBERS = 1 << 20
_AT_ONCE = 1 << 17


class Nearest:
    """The `k` nearest so far of every query of one block, over any number of corpus blocks.

    Cosines in single precision leave out what can't be among the nearest; what is left gets its distance in double.
    """

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int, skip_self: bool):
        self.ids, self.unit, self.k, self.skip = ids, unit, k, skip_self
        self.near = np.full((len(ids), k), np.inf)
        self.who = np.zeros((len(ids), k), np.int64)
        self.single = unit.astype(np.float32)
        self.margin = 1e-6 + 2.4e-7 * unit.shape[1]

    def _floor(self, some: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Cosine below which no vector can be among the nearest of these queries."""
        low = 1.0 - self.near[some, -1]
        n, tried = self.k + self.skip, cosines[:, :1024]
        if tried.shape[1] >= n and not np.isfinite(low).all():
            low = np.maximum(low, np.partition(tried, tried.shape[1] - n, axis=1)[:, tried.shape[1] - n])
        return (low - self.margin).astype(np.float32)

    def add(self, ids: np.ndarray, unit: np.ndarray, rows: np.ndarray | None = None, chunk: int = 256) -> None:
        """Compares a corpus block with all queries, or with those at `rows`."""
        rows, single = np.arange(len(self.ids)) if rows is None else rows, unit.astype(np.float32).T
        step = max(1, min(len(rows), chunk * max(1, 16384 // max(1, len(ids)))))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            cosines = self.single[some] @ single
            at = np.flatnonzero(cosines >= self._floor(some, cosines)[:, None])
            row, col = np.divmod(at, len(ids))
            # Whole queries at a time, so that very many equal vectors do not fill the memory.
            upto = np.cumsum(np.bincount(row, minlength=len(some)))
            start = 0
            while start < len(some):
                before = upto[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(upto, before + _AT_ONCE, "right")))
                self._keep(some, row[before : upto[end - 1]], col[before : upto[end - 1]], ids, unit)
                start = end

    def add_parts(self, ids: np.ndarray, unit: np.ndarray, parts: np.ndarray, looks: np.ndarray) -> None:
        """Compares every part of a block, in order of `parts`, with the queries that look at it."""
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(parts)]):
            self.add(ids[start:end], unit[start:end], np.flatnonzero(looks[:, parts[start]]))

    def _keep(self, some, row, col, ids, unit) -> None:
        query, lead = some[row], ids[col]
        near = np.round(1.0 - np.einsum("ij,ij->i", self.unit[query], unit[col]), TIE_DIGITS)
        good = near <= self.near[query, -1]
        if self.skip:
            good &= self.ids[query] != lead
        query, lead, near = query[good], lead[good], near[good]
        if not len(query):
            return
        mine = np.unique(query)
        query = np.concatenate([query, np.repeat(mine, self.k)])
        near, lead = np.concatenate([near, self.near[mine].ravel()]), np.concatenate([lead, self.who[mine].ravel()])
        order = np.lexsort((lead, near, query))
        query, near, lead = query[order], near[order], lead[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        first = place < self.k
        self.near[query[first], place[first]], self.who[query[first], place[first]] = near[first], lead[first]

    def table(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.near))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.who[row, place]), pa.array(self.near[row, place])], ["query_id", "lead_id", "distance"])


def packed(vectors: DataFrame, key: str, column: str, block: Column, part: Column | None = None) -> DataFrame:
    """(block, ids, parts, numbers): one row per block, its unit vectors as bytes; `part` orders them. Vectors without a length are left out."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = unit_rows(pdf["vector"])
        has = np.isfinite(unit).all(axis=1)
        order = np.flatnonzero(has)[np.argsort(pdf["part"].to_numpy()[has], kind="stable")]
        made = [pdf["id"].to_numpy(np.int64)[order].tobytes(), pdf["part"].to_numpy(np.int64)[order].tobytes(), unit[order].tobytes()]
        return pd.DataFrame([[pdf["block"].iloc[0], *made]], columns=["block", "ids", "parts", "numbers"])

    given = vectors.filter(F.col(column).isNotNull())
    rows = given.select(block.cast("int").alias("block"), F.col(key).alias("id"), (F.lit(0) if part is None else part).cast("bigint").alias("part"), F.col(column).alias("vector"))
    return rows.groupBy("block").applyInPandas(pack, "block int, ids binary, parts binary, numbers binary")


def nearest_of_blocks(queries: DataFrame, corpus: DataFrame, blocks: tuple[int, int], k: int, skip_self: bool, probed=None) -> DataFrame:
    """(query_id, lead_id, distance): at most `k` per query and task, from every pair of packed blocks.

    Blocks are shuffled once, and a task reads the pairs of two groups of them, so what is shuffled follows the number
    of vectors. With `probed` (unit vectors to a table of queries and parts) a query meets the parts it looks at only.
    """
    q_blocks, c_blocks = blocks

    def run(batches):
        found: dict[int, Nearest] = {}
        looks: dict[int, np.ndarray] = {}
        for batch in batches:
            value = lambda name, i: batch.column(name)[i].as_buffer()
            for i, b in enumerate(batch.column("q_block").to_pylist()):
                ids = np.frombuffer(value("ids", i), np.int64)
                if b not in found:
                    own = np.frombuffer(value("q_ids", i), np.int64)
                    if not len(own):
                        continue
                    found[b] = Nearest(own.copy(), np.frombuffer(value("q_numbers", i)).reshape(len(own), -1).copy(), k, skip_self)
                    if probed is not None:
                        looks[b] = probed(found[b].unit)
                if not len(ids):
                    continue
                unit = np.frombuffer(value("numbers", i)).reshape(len(ids), -1)
                if probed is None:
                    found[b].add(ids, unit)
                    continue
                parts = np.frombuffer(value("parts", i), np.int64)
                found[b].add_parts(ids, unit, parts, looks[b])
        for near in found.values():
            yield near.table()

    left = queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers")).repartition(max(1, min(q_blocks, 64)), "q_block")
    right = corpus.repartition(max(1, min(c_blocks, 4), -(-c_blocks // 16)), "block").hint("shuffle_replicate_nl")
    return left.crossJoin(right).mapInArrow(run, "query_id bigint, lead_id bigint, distance double")


def dealt(rows: int, dim: int, block_rows: int) -> int:
    """Number of blocks: of at most BLOCK_NUMBERS numbers on average; up to 16 of at least `block_rows`, so that tasks are many."""
    return max(1, -(-rows * max(1, dim) // BLOCK_NUMBERS), min(16, -(-rows // max(1, block_rows))))
