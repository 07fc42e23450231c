"""The vector index against exact search: recall, share of exact distances, both ways of searching."""

import numpy as np
import pytest

from prospark.functions import vectors as vec
from prospark.operators import search as se
from prospark.operators import vector_index as vi

SCHEMA = "lead_id long, embedding array<float>"
ASKED = "query_id long, vector array<float>"


def vectors(kind, n, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centers = rng.standard_normal((12, dim)) * 4
        return centers[rng.integers(0, 12, n)] + rng.standard_normal((n, dim))
    return rng.standard_normal((n, dim))


def exact(x, q, k, skip):
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x.astype(np.float32).astype(float), q.astype(np.float32).astype(float)))
    d = np.round(1 - q @ x.T, 9)
    if skip:
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
    return [sorted((v, i) for i, v in enumerate(row))[:k] for row in d]


@pytest.mark.parametrize("kind", ["random", "clusters"])
@pytest.mark.parametrize("sent", [True, False])
def test_recall_and_work(spark, kind, sent, monkeypatch):
    if not sent:
        monkeypatch.setattr(vi, "SENT_NUMBERS", 0)
    x = vectors(kind, 1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    index = vi.fit(df, k=5)
    # Few distances are exact, and vectors in clusters need few lists.
    assert index.share <= 0.1 and (kind == "random" or index.probes <= len(index.centroids) / 3)
    asked = x[:120]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], ASKED)
    rows = vi.search(vi.indexed(df, index), queries, index, k=5, skip_self=True, block_rows=60).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["lead_id"]] = r["distance"]
    truth = exact(x, asked, 5, True)
    hits = sum(i in got[q] for q, near in enumerate(truth) for _, i in near)
    assert len(got) == 120 and all(len(g) == 5 and q not in g for q, g in got.items())
    assert hits >= 0.9 * 600
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert all(abs(d - (1 - unit[q] @ unit[i])) < 2e-9 for q, g in got.items() for i, d in g.items())


def test_every_vector_is_indexed_once(spark):
    x = vectors("random", 400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    index = vi.fit(df, sample_rows=100)
    rows = vi.indexed(df, index).select("lead_id", "list", "codes").collect()
    assert sorted(r["lead_id"] for r in rows) == list(range(400))
    assert all(len(r["codes"]) == len(index.books) and 0 <= r["list"] < len(index.centroids) for r in rows)


def test_vectors_without_length_and_small_tables(spark):
    odd = [(1, None), (2, [0.0] * 4), (3, [float("nan")] * 4), (4, [1.0, 0.0, 0.0, 0.0]), (5, [1.0, 0.1, 0.0, 0.0]), (5, [1.0, 0.1, 0.0, 0.0])]
    df = spark.createDataFrame(odd, SCHEMA)
    index = vi.fit(df)
    queries = spark.createDataFrame([(4, [2.0, 0.0, 0.0, 0.0]), (9, None), (8, [0.0] * 4)], ASKED)
    got = vi.search(vi.indexed(df, index), queries, index, k=2).collect()
    assert {r["query_id"] for r in got} == {4} and got[0]["lead_id"] == 4 and got[0]["distance"] == 0.0
    assert vi.fit(df.limit(0)) is None and vi.fit(df.where("lead_id < 4")) is None
    one = vi.fit(df.where("lead_id = 4"))
    assert [r["lead_id"] for r in vi.search(vi.indexed(df, one), queries, one, k=9).collect()][0] == 4
    assert vi.search(vi.indexed(df, index), queries.limit(0), index, k=2).count() == 0


def test_pairs_of_blocks_are_exact_and_shuffle_each_vector_once(spark):
    """Blocks of a few vectors with very many equal ones: exact, and copies of vectors do not follow the number of blocks."""
    x = np.round(vectors("random", 400, dim=8), 1)
    x[100:300] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    rows = se.lookalikes(df, k=3, block_rows=30)
    got = {}
    for r in rows.orderBy("query_id", "distance", "lead_id").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["lead_id"]))
    truth = exact(x, x, 3, True)
    assert {q: [i for _, i in near] for q, near in got.items()} == {q: [i for _, i in near] for q, near in enumerate(truth)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan


def test_equal_vectors_come_in_pieces(monkeypatch):
    monkeypatch.setattr(vec, "_AT_ONCE", 50)
    x = np.repeat(vectors("random", 3, dim=8), 40, axis=0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = vec.Nearest(np.arange(120), unit, 4, True)
    for a in range(0, 120, 25):
        near.add(np.arange(a, min(a + 25, 120)), unit[a : a + 25])
    for q in range(120):
        same = [i for i in range(q // 40 * 40, q // 40 * 40 + 40) if i != q][:4]
        assert near.who[q].tolist() == same and (near.near[q] == 0).all()
