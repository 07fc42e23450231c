"""Dossiers of small, middling and large leads."""

import json

from pyspark.sql import functions as F

from prospark import rules
from prospark.operators.leads import lead_dossier


def test_parts_and_shuffles(spark):
    """Parts are in order and full whatever a lead's size; items of a lead of few parts are shuffled once."""
    sizes = {1: 1, 2: 3, 3: 4, 4: 30, 5: 31, 6: 100}
    leads = spark.createDataFrame([(i, i) for i in sizes], "lead_id long, crawl_target_id long")
    leads = leads.select("*", *[F.lit(None).cast("string").alias(c) for c in rules.LIST_COLUMNS if c not in leads.columns])
    items = [(lead * 100_000 + j * 997, lead) for lead, n in sizes.items() for j in range(n)]
    signals = spark.createDataFrame([(i, lead, "s", "e", "u", "m") for i, lead in reversed(items)], "signal_id long, lead_id long, signal string, evidence string, source_url string, sentiment string")
    pages = spark.createDataFrame([(i, lead, "u", "t", i % 3) for i, lead in items], "page_id long, site_id long, url string, title string, depth int")
    audits = spark.createDataFrame([(f"a{i}", lead, "p", "m", 1, 1, 1.0, i) for i, lead in items], "audit_id string, lead_id long, provider string, model string, input_tokens long, output_tokens long, latency_ms double, at long").withColumn("created_at", F.timestamp_seconds("at")).drop("at")
    vectors = spark.createDataFrame([], "lead_id long, embedding array<float>")
    out = lead_dossier(leads, signals, pages, vectors, audits, part_size=3)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["part"]):
        got.setdefault((r["section"], r["lead_id"]), []).append([json.loads(x) for x in r["items"]])
    for lead, n in sizes.items():
        own = [i for i, owner in items if owner == lead]
        for section, key, want in (("signals", "signal_id", own), ("pages", "page_id", sorted(own, key=lambda i: (i % 3, i))), ("audits", "audit_id", [f"a{i}" for i in reversed(own)])):
            assert [[x[key] for x in part] for part in got[section, lead]] == [want[i : i + 3] for i in range(0, n, 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
