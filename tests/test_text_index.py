"""Searches through the index of three-letter runs, and robots rules met by prefix, against plain versions."""

import random
import time
import urllib.robotparser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospark.operators import crawl as cr
from prospark.operators.scope import LeadFilter, filter_leads, has_text
from prospark.sources.snapshots import create_snapshots
from prospark.sources.text_index import _block_runs, build_text_index, candidates, literal_runs, run_code, search_stored

SCHEMA = "lead_id long, company_name string, domain string, industry string, company_summary string, value_proposition string, organization_id long, icp_score int"


def leads(spark):
    rng = random.Random(4)
    words = ["Ring", "machinery", "spring", "ÉCLAIR", "50% off", "a_b", "x\\y", "Kelvin", "red", "ox", "İstanbul"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))])
    return spark.createDataFrame([(i, text(), text(), text(), text(), text(), rng.choice([None, 3, 4]), i % 100) for i in range(300)], SCHEMA)


def test_searches_equal_a_whole_scan(spark, tmp_path):
    rows = leads(spark)
    table, index = str(tmp_path / "t"), str(tmp_path / "i")
    create_snapshots(rows, table, "lead_id", buckets=8)
    build_text_index(rows, index)
    for text in ("ring", "RING mach", "spr%red", "a_b", "50\\% off", "éclair", "ox", "%", "no such", "ring  ", "x\\\\y", "ıstanbul", "kelvin ring"):
        f = LeadFilter(search=text, organization_id=3, min_icp_score=20)
        got = sorted(r["lead_id"] for r in search_stored(spark, table, index, f).collect())
        assert got == sorted(r["lead_id"] for r in filter_leads(rows, f).collect()), text


def test_candidates_are_few(spark, tmp_path):
    """Only rows that have the rarest runs are looked at."""
    rows = spark.range(3000).select(F.col("id").alias("lead_id"), *[F.concat(F.lit("common words "), F.when(F.col("id") % 500 == 7, "needle")).alias(c) if c == "company_summary" else F.lit("common").alias(c) for c in ("company_name", "domain", "industry", "company_summary", "value_proposition")])
    build_text_index(rows, str(tmp_path))
    assert sorted(r["key"] for r in candidates(spark, str(tmp_path), "words needle").collect()) == [7, 507, 1007, 1507, 2007, 2507]
    assert candidates(spark, str(tmp_path), "nxqd").count() == 0 and candidates(spark, str(tmp_path), "no") is None
    build_text_index(rows.limit(0), str(tmp_path / "none"))
    assert candidates(spark, str(tmp_path / "none"), "common").count() == 0


def test_inner_wildcards_take_linear_time(spark):
    """A long text that almost matches, once per place of the first part; ILIKE itself needs hours for it."""
    text = "a machiner " * 300_000
    rows = spark.createDataFrame([(1, text), (2, text + "MACHINERY"), (3, None)], "id long, t string")
    start = time.time()
    assert [r["id"] for r in rows.where(has_text(F.col("t"), "a%machinery")).collect()] == [2]
    assert time.time() - start < 30


def test_inner_wildcards_equal_ilike(spark):
    rng = random.Random(8)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    texts = ["", None, "aSa\nb", "Σας ΑΣ", "a\\E%b", "É\U0001f600b"] + [draw("aAbB%_\\\né\U0001f600Σ.*", 12) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(1).cache()
    parts = ["%", "a%b", "a%", "%%b%%a", "a_%_b", "_%_", "é%ΑΣ", "\\%%\\_", "\\\\%a", "\\\\E%b", ".*%a", "😀%b"] + [draw("aB%%__é", 6) for _ in range(30)]
    got = rows.select(*[F.struct(has_text(F.col("t"), p).alias("a"), F.col("t").ilike(f"%{p}%").alias("b")) for p in parts]).collect()
    assert [(texts[i], p) for i, r in enumerate(got) for p, x in zip(parts, r) if x["a"] != x["b"]] == []
    with pytest.raises(Exception):
        rows.where(has_text(F.col("t"), "a%\\b")).collect()


def test_blocks_of_very_many_characters(spark, tmp_path, monkeypatch):
    """Rows whose characters together are too many to number a run and its row at once are taken in halves."""
    texts = ["".join(chr(0x4E00 + (i * 9173 + j) % 20_000) for j in range(3_000)).encode().decode() + chr(0x10000 + i) * 3 for i in range(70)]
    want = sorted({(run_code(t[j : j + 3]), i) for i, t in enumerate(texts) for j in range(len(t) - 2)})
    pad = [""] * (1 << 20)  # 2^20 rows take 20 bits beside 3 of 15
    got = [(int(r), int(x)) for runs, ends, rows in _block_runs([pa.array(texts + pad + [texts[0]])]) for r, xs in zip(runs, np.split(rows, ends[:-1])) for x in xs]
    n = len(texts) + len(pad)
    assert sorted(g for g in got if g[1] < n) == want and sorted(r for r, x in got if x == n) == sorted(r for r, x in want if x == 0)


@pytest.mark.parametrize("text, runs", [("  ab ", []), ("Abcd", ["abc", "bcd"]), ("ab%cde_f", ["cde"]), ("a\\%bcd", ["bcd"]), ("abéxyz", ["xyz"])])
def test_literal_runs(text, runs):
    assert literal_runs(text) == runs


def test_robots_of_ten_thousand_rules(spark):
    """A host with very many rules, one with few, one without: as the standard library reads them."""
    rng = random.Random(9)
    part = lambda: "/" + "/".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4)))
    body = lambda n: "User-agent: *\n" + "".join(f"{rng.choice(['Disallow', 'Allow'])}: {part()}\n" for _ in range(n)) + "\nUser-agent: prospectbot\n" + "".join(f"{rng.choice(['Disallow', 'Allow'])}: {part()}\n" for _ in range(n // 2))
    bodies = {"big.test": body(10_000), "small.test": body(20), "all.test": "User-agent: *\nDisallow: /\n", "free.test": ""}
    robots = spark.createDataFrame([(h, 200, b) for h, b in bodies.items()] + [("gone.test", 404, None), ("no.test", 403, None)], "host string, status_code int, body string")
    urls = [(i, f"https://{rng.choice([*bodies, 'gone.test', 'no.test', 'other.test'])}{rng.choice(['', part(), part() + '?q=' + part()])}") for i in range(400)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: (r["allowed"], r["robots_reason"]) for r in cr.robots_filter(df, robots, "ProspectBot/1.0").collect()}
    packed = {r["page_id"]: (r["allowed"], r["robots_reason"]) for r in cr.robots_filter(df, robots, "ProspectBot/1.0", packed_rules=10**9).collect()}
    prefixed = {r["page_id"]: (r["allowed"], r["robots_reason"]) for r in cr.robots_filter(df, robots, "ProspectBot/1.0", packed_rules=0).collect()}
    assert got == packed == prefixed and len(got) == 400
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(bodies["all.test"].splitlines())
    assert all(not got[i][0] for i, u in urls if "//all.test" in u or "//no.test" in u) and all(got[i][0] for i, u in urls if "gone.test" in u or "free.test" in u or "other.test" in u)
