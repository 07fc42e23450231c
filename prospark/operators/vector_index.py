"""Approximate nearest vectors: inverted lists, product-quantized codes, exact re-ranking.

A bounded sample of the vectors gives coarse centroids (one list each) and, for every slice of the dimensions, a
codebook for what is left after the centroid. Every vector is then indexed: its list and one byte per slice. A query
looks only at the lists whose centroids are nearest to it; cosines in single precision leave few of their vectors, and
answers are the nearest of those by exact distance. `share` tells what part the codes alone would leave.

How many lists and which share are needed depends on the vectors, so `fit` tries them on the sample against exact
search and takes the least that reach the wanted recall there. On vectors without clusters that means most lists and
still few exact distances.

Vectors that are null, zero or not finite have no distance and are in no answer.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospark.functions.skew import first_per_key
from prospark.functions.vectors import BLOCK_NUMBERS, Nearest, dealt, nearest_of_blocks, packed, unit_rows

SAMPLE_ROWS = 8192
MOST_LISTS = 1024
SLICE_CODES = 256
#: Query vectors of at most so many numbers are sent to every task.
SENT_NUMBERS = 4_000_000
_ANSWER = "query_id bigint, lead_id bigint, distance double"


@dataclass(frozen=True)
class VectorIndex:
    """Centroids (lists, dim), codebooks (slices, codes, dim / slices), lists to look at, share of exact distances."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int
    share: float

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of unit vectors."""
        own = np.argmax(unit @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1), axis=1)
        rest = (unit - self.centroids[own]).reshape(len(unit), len(self.books), -1)
        codes = [np.argmax(rest[:, j] @ b.T - 0.5 * (b**2).sum(axis=1), axis=1) for j, b in enumerate(self.books)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def probed(self, unit: np.ndarray) -> np.ndarray:
        """(queries, lists): which lists each query looks at."""
        near = unit @ self.centroids.T
        limit = -np.partition(-near, self.probes - 1, axis=1)[:, self.probes - 1 : self.probes]
        return near >= limit

    def scores(self, unit: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, vectors): approximate cosines, -inf for lists that a query does not look at."""
        out = np.where(self.probed(unit), unit @ self.centroids.T, -np.inf).astype(np.float32)[:, lists]
        table = np.einsum("qjw,jcw->jqc", unit.reshape(len(unit), len(self.books), -1), self.books).astype(np.float32)
        for j, t in enumerate(table):
            out += t[:, codes[:, j]]
        return out


def _means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means centroids; one that loses all its points stays where it is."""
    centers = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = np.argmax(points @ centers.T - 0.5 * (centers**2).sum(axis=1), axis=1)
        many = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, weights=points[:, d], minlength=len(centers)) for d in range(points.shape[1])], axis=1)
        centers[many > 0] = sums[many > 0] / many[many > 0, None]
    return centers


def fit_sample(unit: np.ndarray, total: int, slices: int = 16, k: int = 10, recall: float = 0.97, seed: int = 7) -> VectorIndex:
    """The index of a sample of unit vectors that stand for `total`."""
    rng = np.random.default_rng(seed)
    dim = unit.shape[1]
    slices = max(s for s in range(1, slices + 1) if dim % s == 0)
    lists = max(1, min(int(total**0.5), MOST_LISTS, len(unit) // 8 or 1))
    centroids = _means(unit, lists, rng)
    own = np.argmax(unit @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)
    rest = (unit - centroids[own]).reshape(len(unit), slices, -1)
    codes = min(SLICE_CODES, len(unit))
    index = VectorIndex(centroids, np.stack([_means(rest[:, j], codes, rng) for j in range(slices)]), len(centroids), 1.0)
    # Least lists, then least share, that find the exact neighbours of some sample vectors within the sample.
    asked = rng.permutation(len(unit))[:256]
    exact = unit[asked] @ unit.T
    exact[np.arange(len(asked)), asked] = -np.inf
    n = min(k, len(unit) - 1)
    if n < 1:
        return index
    truth = np.argpartition(-exact, n - 1, axis=1)[:, :n]
    lists_of, codes_of = index.place(unit)
    near = np.argsort(-(unit[asked] @ centroids.T), axis=1)
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, lists_of[truth], axis=1).reshape(-1))
    probes = int(needed[int(np.ceil((recall + 1) / 2 * len(needed))) - 1]) + 1
    index = replace(index, probes=probes)
    scores = index.scores(unit[asked], lists_of, codes_of)
    scores[np.arange(len(asked)), asked] = -np.inf
    rank = (scores[:, None, :] > np.take_along_axis(scores, truth, axis=1)[:, :, None]).sum(axis=2)
    rank[~np.isfinite(np.take_along_axis(scores, truth, axis=1))] = len(unit)
    worst = np.sort(rank.reshape(-1))[int(np.ceil(recall * rank.size)) - 1]
    return replace(index, share=min(1.0, (int(worst) + 1) / len(unit)))


def finite(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has a length."""
    square = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.where(F.col(column).isNotNull() & (square > 0) & (square < float("inf")))


def fit(embeddings: DataFrame, sample_rows: int = SAMPLE_ROWS, **more) -> VectorIndex | None:
    """The index fitted on the `sample_rows` vectors whose ids hash lowest; None without any vector."""
    rows = finite(embeddings, "embedding")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("lead_id"), "lead_id").limit(sample_rows).select("embedding").toPandas()
    return fit_sample(unit_rows(sample["embedding"]), total, **more) if total else None


def indexed(embeddings: DataFrame, index: VectorIndex) -> DataFrame:
    """(lead_id, embedding, list, codes) of every vector."""

    def run(batches):
        for pdf in batches:
            lists, codes = index.place(unit_rows(pdf["embedding"])) if len(pdf) else ([], np.zeros((0, 1), np.uint8))
            yield pdf.assign(list=lists, codes=[c.tobytes() for c in codes])

    rows = finite(embeddings, "embedding").select("lead_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(run, "lead_id bigint, embedding array<double>, list int, codes binary")


def search(corpus: DataFrame, queries: DataFrame, index: VectorIndex, k: int, skip_self: bool = False, block_rows: int = 4096) -> DataFrame:
    """(query_id, lead_id, distance): the `k` nearest of each query (query_id, vector) among `indexed` rows.

    Queries of at most SENT_NUMBERS numbers are sent to the corpus, which is scanned where it lies. More queries meet the
    lists they look at in pairs of packed blocks. Within a list the product of all vectors in single precision costs
    less than the look-ups of their codes and misses none, so the codes only serve the fit and readers of the index.
    """
    asked = finite(queries, "vector").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    if (asked.agg(F.sum(F.size("vector"))).head()[0] or 0) <= SENT_NUMBERS:
        sent = asked.toPandas()  # bounded by the check above

        def scan(batches):
            near = Nearest(sent["query_id"].to_numpy(np.int64), unit_rows(sent["vector"]), k, skip_self)
            looks = index.probed(near.unit) if len(sent) else None
            for rows in batches:
                if looks is None or not len(rows):
                    continue
                rows = rows.sort_values("list", kind="stable")
                near.add_parts(rows["lead_id"].to_numpy(), unit_rows(rows["embedding"]), rows["list"].to_numpy(), looks)
            yield near.table().to_pandas()

        found = corpus.mapInPandas(scan, _ANSWER)
    else:

        dim = len(index.centroids[0])
        q_rows, c_rows = asked.count(), corpus.count()
        blocks = tuple(dealt(n, dim, block_rows) for n in (q_rows, c_rows))
        deal = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(n))
        # A list stays together, and a long one is cut; one row per list, at most MOST_LISTS.
        cuts = F.broadcast(corpus.groupBy("list").agg(F.ceil(F.count(F.lit(1)) * dim / BLOCK_NUMBERS).alias("cuts")))
        cut = corpus.join(cuts, "list").withColumn("cut", F.pmod(F.xxhash64("lead_id"), F.col("cuts")))
        left = packed(asked, "query_id", "vector", deal(blocks[0], "query_id"))
        right = packed(cut, "lead_id", "embedding", deal(blocks[1], "list", "cut"), F.col("list"))
        found = nearest_of_blocks(left, right, blocks, k, skip_self, index.probed)
    return first_per_key(found, ["query_id"], [F.asc("distance"), F.asc("lead_id")], k)
