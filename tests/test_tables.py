"""Skew helpers, sinks, answers, retries and search against plain Python."""

import csv
import datetime as dt
import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospark.functions import skew
from prospark.operators import context as cx
from prospark.operators import jobs as jb
from prospark.operators import leads as ld
from prospark.operators import qualify as ql
from prospark.operators import search as se
from prospark.operators.scope import LeadFilter, filter_leads
from prospark.sources import sinks


def hot_rows(n=400, seed=3):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", rng.randint(0, 50), rng.randint(1, 90)) for i in range(n)]


def test_skew_helpers(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, k string, t int, v long")
    bucket = F.floor(F.col("t") / 10)
    lag = {r.id: r.p for r in skew.lag_within(df, ["k"], ["t", "id"], bucket, {"v": "p"}).collect()}
    top = {r.id: r.m for r in skew.running_max_before(df, ["k"], ["t", "id"], bucket, "v", "m").collect()}
    pos = {r.id: r.n for r in skew.ordinal(df, ["k"], [F.col("t"), F.col("id")], bucket, "n").collect()}
    upto = {
        r.id: r.b
        for r in skew.running_total_upto(df, ["k"], ["t", "id"], "v", 700, F.xxhash64("id"), 4, "b").collect()
    }
    for key in {r[1] for r in rows}:
        before = []
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            assert lag[r[0]] == (before[-1] if before else None)
            assert top[r[0]] == (max(before) if before else None)
            assert pos[r[0]] == len(before) + 1
            assert upto.get(r[0]) == (sum(before) if sum(before) <= 700 else None)
            before.append(r[3])


def test_prompt_budget_cut_rule(spark):
    rows = [("a", 1, 0, 900), ("a", 2, 1, 200), ("a", 3, 1, 5), ("b", 4, 0, 600), ("b", 5, 0, 600), ("b", 6, 0, 1), ("c", 7, 0, 1000)]
    df = spark.createDataFrame(rows, "target_id string, page_id long, depth int, n_chars long")
    got = {r.page_id: (r.kept_chars, r.is_cut) for r in cx.prompt_budget(df, max_chars=1000, min_tail=300, salts=2).collect()}
    assert got == {1: (900, False), 4: (600, False), 5: (400, True), 7: (1000, False)}


def test_context_numbers_and_metadata(spark):
    pages = [("t", i, f"https://t.test/{i}", 0, None if i == 1 else f"T{i}", f"body {i} " + "x" * 30, ["a@t.test"] if i == 1 else []) for i in range(1, 13)]
    df = spark.createDataFrame(pages, "target_id string, page_id long, url string, depth int, title string, content string, emails array<string>")
    targets = spark.createDataFrame([("t", "t.test", "https://t.test/")], "target_id string, domain string, url string")
    parts = {(r.section, r.part): r.text for r in cx.build_context(targets, df, urls_per_part=5).collect()}
    assert set(parts) == {(1, 0), (3, 0), (3, 1), (3, 2), (4, 0)}
    assert "[page-12]" in parts[(4, 0)] and "Headline: (none)\nMail: a@t.test\n" in parts[(4, 0)]
    assert parts[(3, 2)].split("\n") == ["- https://t.test/11", "- https://t.test/12"]


def test_answers(spark):
    import json

    good = {n: "x" for n in ql.REQUIRED_TEXTS} | {"icp_score": 85, "confidence_score": 0.5}
    sig = {"signal": "s", "evidence": "e"}
    cases = [
        (good, None), (good | {"icp_score": 101}, "icp_score not in 0..100"), (good | {"icp_score": -1}, "icp_score not in 0..100"),
        (good | {"icp_score": 85.5}, "icp_score not in 0..100"), (good | {"icp_score": "85"}, None),
        (good | {"confidence_score": 1.2}, "confidence_score not in 0..1"),
        ({k: v for k, v in good.items() if k != "industry"}, "missing industry"),
        (good | {"signals": [sig]}, None), (good | {"signals": [sig | {"confidence": 2}]}, "bad signal"),
        (good | {"signals": [{"signal": "s"}]}, "bad signal"),
        (good | {"grounded_attributes": {"a": {"confidence": -1}}}, "bad attribute"),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "{nope")]
    valid, refused = ql.load_qualifications(spark.createDataFrame(rows, "id int, answer string"))
    got = {r.id: r.reason for r in refused.collect()} | {r.id: None for r in valid.select("id").collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)} | {99: "malformed json"}
    s = valid.filter("id = 7").head().signals[0]
    assert (s.sentiment, s.status, s.confidence) == ("positive", "observed", 1.0)


@pytest.mark.parametrize(
    "kind, message, want",
    [("ReadTimeout", "x", "transient"), ("ConnectError", "refused", "transient"), ("E", "HTTP 502", "transient"),
     ("E", "status 429", "transient"), ("E", "Invalid URL given", "permanent"), ("E", "SSRF protection: 502", "permanent"),
     ("E", "unsupported scheme", "permanent"), ("E", "blocked_by_robots", "permanent"), ("KeyError", "boom", "other")],
)
def test_retry_class(spark, kind, message, want):
    df = spark.createDataFrame([(kind, message, 1)], "error_type string, message string, retry_count int")
    row = jb.retry_plan(df).head()
    assert row.error_class == want and row.delay_seconds == (2.0 if want == "transient" else None)


def test_backoff(spark):
    df = spark.createDataFrame([(0,), (2,), (10,)], "n int")
    got = [r[0] for r in df.select(jb.backoff_delay(F.col("n"), cap=20.0)).collect()]
    assert got == [1.0, 4.0, 20.0]


def test_transitions(spark):
    t = dt.datetime(2024, 1, 1)
    seqs = {1: ["QUEUED", "RUNNING", "RUNNING", "COMPLETED"], 2: ["QUEUED", "COMPLETED", "RUNNING"], 3: ["RUNNING", "CANCELLED"]}
    rows = [(j, i, s, t + dt.timedelta(hours=20 * i)) for j, ss in seqs.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "job_id long, event_id long, status string, timestamp timestamp")
    got = sorted((r.job_id, r.previous_status, r.status, r.allowed) for r in jb.transition_audit(df).collect())
    assert got == [
        (1, "QUEUED", "RUNNING", True), (1, "RUNNING", "COMPLETED", True), (2, "COMPLETED", "RUNNING", False),
        (2, "QUEUED", "COMPLETED", False), (3, "RUNNING", "CANCELLED", True),
    ]


LEADS = [(1, "A, Inc", 'says "hi"\nthere', 90), (2, "B", "plain", 20), (3, "C", " padded ", 55)]


def leads(spark):
    df = spark.createDataFrame(LEADS, "lead_id long, company_name string, company_summary string, icp_score int")
    return df.select(
        "*", F.lit("d").alias("domain"), F.lit("Machinery").alias("industry"), F.lit("Oslo").alias("geography"),
        F.lit(0.5).alias("confidence_score"), F.lit("NEW").alias("status"), F.lit("v").alias("value_proposition"),
        F.lit(None).cast("long").alias("organization_id"), F.lit(1).alias("campaign_id"), F.col("lead_id").alias("crawl_target_id"),
        F.lit("1-10").alias("estimated_company_size"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )


def test_csv_export(spark, tmp_path):
    sinks.write_export_csv(ld.export_leads(leads(spark)), str(tmp_path / "csv"))
    (part,) = glob.glob(str(tmp_path / "csv" / "part-*.csv"))
    with open(part, newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ld.rules.EXPORT_COLUMNS
    assert [r[0] for r in rows[1:]] == ["A, Inc", "C", "B"]
    assert rows[1][7] == 'says "hi"\nthere' and rows[2][7] == " padded "


def test_list_arguments(spark):
    df = leads(spark)
    for wrong in ({"page": 0}, {"page_size": 0}, {"sort_by": "drop table"}, {"sort_order": "up"}):
        with pytest.raises(ValueError):
            ld.list_leads(df, **wrong)
    for call in (lambda: ld.rank_relational(df, k=0), lambda: ld.leads_total(df, page_size=0), lambda: ld.export_leads(df, limit=0)):
        with pytest.raises(ValueError):
            call()
    assert ld.list_leads(df, page_size=1000).count() == 3 and ld.leads_total(df, page_size=1000).head().pages == 1
    assert [r.lead_id for r in ld.list_leads(df, sort_by="icp_score", sort_order="asc").collect()] == [2, 3, 1]
    assert filter_leads(df, LeadFilter(search="   ", industry=" mach ", status=" new ")).count() == 3
    assert filter_leads(df, LeadFilter(organization_id=9)).count() == 3
    assert ld.leads_total(df.limit(0)).head().pages == 0


def test_append_keeps_old_fetches(spark, tmp_path):
    df = spark.createDataFrame([("t", "https://t.test/", dt.datetime(2024, 5, 1))], "crawl_target_id string, url string, fetched_at timestamp")
    path = str(tmp_path / "pages")
    sinks.append_pages(df, path, writers=2)
    sinks.append_pages(df, path, writers=2)
    assert spark.read.parquet(path).count() == 2


def vectors(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 10, dim))
    v = np.repeat(base, 10, axis=0) + 0.2 * rng.standard_normal((n, dim))
    v[5] = v[6] = v[7]  # copies
    return v.astype(np.float32)


def exact(v, k):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(v)), d[i]))[:k]] for i in range(len(v))}


def test_lookalikes_and_recall(spark):
    v = vectors()
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "lead_id long, embedding array<float>")
    want = exact(v, 5)
    got = {}
    for r in se.lookalikes(df, k=5, block_rows=64).orderBy("query_id", "distance", "lead_id").collect():
        got.setdefault(r.query_id, []).append(r.lead_id)
    assert got == want
    queries = df.select(F.col("lead_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = se.ann_candidates(df, queries, k=5, dim=16, bits=4, tables=8, skip_self=True, block_rows=50).collect()
    hits = sum(r.lead_id in want[r.query_id] for r in near)
    assert len({(r.query_id, r.lead_id) for r in near}) == len(near)
    assert hits / (5 * len(v)) >= 0.9


def test_embed_with(spark):
    plan = spark.createDataFrame([(1, "h1", "aa", "insert"), (2, "h2", "b", "reuse"), (3, "h3", "ccc", "update")], "lead_id long, content_hash string, content string, action string")
    got = {r.lead_id: r.embedding for r in se.embed_with(plan, lambda ts: [[len(t), 1] for t in ts]).collect()}
    assert got == {1: [2.0, 1.0], 3: [3.0, 1.0]}


def test_hybrid_without_text_ranks_by_fit(spark):
    vectors_df = spark.createDataFrame([(1, [1.0, 0.0])], "lead_id long, embedding array<float>")
    rows = se.hybrid_search(leads(spark), vectors_df, "  ", [1.0, 0.0], k=2).collect()
    assert [r.lead_id for r in rows] == [1, 3] and rows[0].score is None
    with pytest.raises(ValueError):
        se.hybrid_search(leads(spark), vectors_df, "x", [1.0, 0.0], k=0)


def test_hybrid_pool(spark):
    """All passing leads are ranked unless a pool is named; a zero vector has no distance."""
    vectors_df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "lead_id long, embedding array<float>")
    found = lambda **more: [r.lead_id for r in se.hybrid_search(leads(spark), vectors_df, "there", [1.0, 0.0], weights=(0.1, 0.0, 0.9), k=5, **more).collect()]
    assert found() == [1, 2] and found(pool=1) == [2]


def test_job_moves_of_a_hot_job(spark):
    """Moves one after another in plain Python; a job with most moves, equal moves, unknown jobs and missing values."""
    rng = random.Random(11)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(40)) if rng.random() < 0.95 else None
    jobs = [(j, rng.choice(["QUEUED", "QUEUED", "RUNNING", "FAILED", None]), at() if rng.random() < 0.3 else None, at() if rng.random() < 0.2 else None, f"x{j}") for j in range(200)]
    jobs[0] = (0, "QUEUED", None, None, "hot")
    kinds = ["running", "COMPLETED", "Cancelled", "FAILED", "queued", None, "odd"]
    moves = [(i if rng.random() < 0.97 else None, 0 if rng.random() < 0.4 else rng.choice([None, *range(230)]), rng.choice(kinds), at()) for i in range(3000)]
    moves += [m for m in moves if rng.random() < 0.2]
    allowed = {("QUEUED", "RUNNING"), ("QUEUED", "CANCELLED"), ("RUNNING", "COMPLETED"), ("RUNNING", "FAILED"), ("RUNNING", "CANCELLED")}
    order = lambda m: (m[3] is not None, m[3] or dt.datetime.min, m[0] is not None, m[0] or 0, m[2] is not None, (m[2] or "").upper())
    want, refused = [], []
    for job, status, start, end, name in jobs:
        for i, _, kind, when in sorted((m for m in moves if m[1] == job), key=order):
            to = kind and kind.upper()
            if (status, to) not in allowed:
                refused.append((i, "move not allowed"))
                continue
            status = to
            if to == "RUNNING" and start is None:
                start = when
            elif to != "RUNNING":
                end = when
        want.append((job, status, start, end, name))
    refused += [(m[0], "not found") for m in moves if m[1] is None or m[1] >= 200]
    schema = "job_id long, status string, started_at timestamp_ntz, completed_at timestamp_ntz, name string"
    after, barred = jb.apply_moves(spark.createDataFrame(jobs, schema), spark.createDataFrame(moves, "move_id long, job_id long, new_status string, moved_at timestamp_ntz"))
    assert sorted(map(repr, map(tuple, after.collect()))) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, barred.collect()))) == sorted(map(repr, refused))
    for df in (after, barred):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_gate_over_all_jobs(spark):
    """Active jobs of any number are reused, and tenants are full, fill up or have room."""
    from prospark.plans.catalog import QUERIES

    rows = QUERIES["gated_submissions_all"](spark, "/root/testdata/sf0.001").collect()
    assert {r.action for r in rows} == {"create", "reuse_active", "reuse_batch", "rejected"}
    assert any(r.active_job_id is not None and r.active_job_id % 97 for r in rows)


def test_gate_before_stored_targets(spark):
    """Stored targets that nobody asks for stay, others are taken over, and unsafe URLs are refused."""
    from prospark.plans.catalog import QUERIES

    rows = QUERIES["admit_targets_stored"](spark, "/root/testdata/sf0.001").collect()
    assert {r.outcome for r in rows} >= {"failed", "in_progress", "private or reserved address"}
