"""Evidence cases on a small site, and the corpus search against brute force."""

import random
import re

from pyspark.sql import functions as F

from prospark.functions.spans import Runs, among
from prospark.operators import grounding as gr
from prospark.operators import quotes
from prospark.operators.quotes import quotes_in_corpus
from prospark.session import cut_lineage

PAGES = [
    # target, page_id, url, title, content, depth
    ("acme", 1, "https://acme.test/", "Acme", "Acme builds *industrial* pumps, since 1990. Team of 40 people.", 0),
    ("acme", 2, "https://acme.test/About/", "About", "We run Kafka and Spark. Offices in Oslo - Norway.", 1),
    ("beta", 3, "https://beta.test/", "Beta", "Quotes to Scrape: a demo sandbox for scraping.", 0),
]
PAGE_SCHEMA = "target_id string, page_id long, url string, title string, content string, depth int"


def pages(spark):
    return spark.createDataFrame(PAGES, PAGE_SCHEMA)


def test_signals(spark):
    cases = [
        ("https://acme.test/", "Acme builds industrial pumps since 1990", "observed", None),
        ("https://acme.test", '"ACME builds *industrial* pumps"', "observed", None),
        ("HTTPS://ACME.test/About", "offices in oslo norway", "observed", None),
        ("https://acme.test/about", "big offices in oslo norway opened last year", "observed", None),
        ("https://acme.test/", "Acme sells rockets to everyone", "observed", gr.NO_QUOTE),
        ("https://acme.test/", "we run", "observed", gr.NO_QUOTE),
        ("https://acme.test/careers", "Acme", "observed", gr.NOT_CRAWLED),
        ("https://beta.test/", "Quotes to Scrape", "observed", gr.OTHER_DOMAIN),
        (None, "anything", "observed", gr.NO_URL),
        (None, "anything", "unknown", None),
        ("https://acme.test/", "  ", "observed", gr.NO_QUOTE),
        ("https://acme.test/", "{}", "observed", None),
        ("https://acme.test/", "*,*", "observed", gr.NO_QUOTE),
    ]
    rows = [(i, "acme", "acme.test", u, q, s) for i, (u, q, s, _) in enumerate(cases)]
    signals = spark.createDataFrame(
        rows, "signal_id int, target_id string, domain string, source_url string, evidence string, status string"
    )
    checked = gr.ground_signals(signals, pages(spark))
    got = {r.signal_id: r.reason for r in checked.collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
    kept, refused = gr.split_grounded(checked)
    assert kept.count() + refused.count() == len(cases)


def test_facts_and_attributes(spark):
    claim = lambda v, s, e, u: {"value": v, "status": s, "confidence": 0.8, "evidence": e, "source_url": u}
    facts = ["Pumps (https://acme.test/).", "See https://acme.test/none)", "No link", "Other https://beta.test/x."]
    attrs = {
        "ok": claim("40", "observed", "team of 40 people", "https://acme.test/"),
        "other": claim("x", "observed", "Quotes to Scrape", "https://beta.test/"),
        "quote": claim("y", "inferred", "never said this here", "https://acme.test/"),
        "plain": claim("z", "observed", "nothing", None),
    }
    schema = (
        "qual_id int, target_id string, domain string, observed_facts array<string>, grounded_attributes "
        "map<string, struct<value: string, status: string, confidence: double, evidence: string, source_url: string>>"
    )
    quals = spark.createDataFrame([(1, "acme", "acme.test", facts, attrs), (2, "acme", "acme.test", [], {})], schema)
    got = {r.qual_id: r.observed_facts for r in gr.ground_facts(quals, pages(spark)).collect()}
    assert got == {1: [facts[0], facts[2]], 2: []}
    a = {r.qual_id: r.grounded_attributes for r in gr.ground_attributes(quals, pages(spark)).collect()}
    assert a[1]["ok"].value == "40" and a[1]["plain"].value == "z" and a[2] == {}
    for name in ("other", "quote"):
        assert (a[1][name].value, a[1][name].status, a[1][name].confidence, a[1][name].source_url) == (
            "Unknown", "unknown", 0.0, None,
        )


QUAL_SCHEMA = (
    "target_id string, estimated_company_size string, technology_signals array<string>, "
    "products_or_services array<string>, geography string, business_model string, target_audience string, "
    "value_proposition string, unknown_attributes array<string>"
)


def test_claims_and_sandbox(spark):
    rows = [
        ("acme", "11-50", ["Kafka", "Oracle"], ["Industrial pumps", "pumps industrial line", "Space rockets"], "Norway", "SaaS", "All", "V", []),
        ("beta", "500+", ["Rust"], ["Gold plan"], "Mars", "Subscription", "All", "V", ["zeta"]),
    ]
    quals = spark.createDataFrame(rows, QUAL_SCHEMA)
    got = {r.target_id: r for r in gr.ground_claims(quals, pages(spark), salts=3).collect()}
    acme, beta = got["acme"], got["beta"]
    assert acme.estimated_company_size == "11-50" and acme.geography == "Norway" and acme.business_model == "Unknown"
    assert acme.technology_signals == ["Kafka"] and acme.products_or_services == ["Industrial pumps"]
    assert acme.unknown_attributes == ["business_model"]
    assert (beta.estimated_company_size, beta.geography, beta.technology_signals) == ("Unknown", "Unknown", [])
    assert "zeta" in beta.unknown_attributes and "products_or_services" in beta.unknown_attributes
    demo = {r.target_id: r for r in gr.ground_sandbox(quals, pages(spark)).collect()}
    assert demo["acme"].products_or_services == rows[0][3] and demo["acme"].unknown_attributes == []
    assert demo["beta"].products_or_services == [] and demo["beta"].target_audience == "Unknown"
    assert demo["beta"].business_model == "Unknown / Non-Commercial" and len(demo["beta"].unknown_attributes) == 7


def test_cross_target_leak(spark):
    rows = [(1, "acme", "https://acme.test/"), (2, "acme", "https://beta.test"), (3, "acme", "https://no.test/"), (4, "acme", None)]
    signals = spark.createDataFrame(rows, "signal_id int, target_id string, source_url string")
    got = {(r.signal_id, r.owner_target) for r in gr.cross_target_leak(signals, pages(spark)).collect()}
    assert got == {(2, "beta"), (3, None)}


def plain(text):
    text = re.sub(r"[*_#`\"'\(\)\[\]:,.-]", " ", text.lower())
    return re.sub(r"\s+", " ", text).strip()


def test_corpus_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["pump", "oslo", "red", "kafka", "it", "a", "valve", "x-ray", "team's", "q\xa0r", "über"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)] + [(60, "*** -- ...")]
    asked = []
    for i in range(120):
        text = rng.choice(docs)[1]
        start = rng.randint(0, max(0, len(text) - 3))
        asked.append((i, text[start : start + rng.randint(1, 40)]))
    asked += [(200, "***"), (201, "-- ."), (202, '""'), (203, "  "), (204, "zzz kafka red pump it a"), (205, ".")]
    q = spark.createDataFrame(asked, "quote_id int, evidence string")
    d = spark.createDataFrame(docs, "page_id int, content string")
    got = {(r.quote_id, r.page_id) for r in gr.ground_quotes_corpus(q, d).collect()}

    want = set()
    for qid, quote in asked:
        bare = quote.strip()
        if not bare:
            continue
        if bare[0] == bare[-1] and bare[0] in "\"'":
            bare = bare[1:-1].strip()
        for pid, text in docs:
            page = f" {text} {{}}"
            if bare.lower() in page.lower() or (plain(bare) and plain(bare) in plain(page)):
                want.add((qid, pid))
    assert got == want


def test_corpus_search_in_many_passes(spark):
    """Blocks of few keys and few bytes find what one pass finds; pages without any text and repeated rows are harmless."""
    rng = random.Random(8)
    words = ["pump", "oslo", "red", "kafka", "valve", "crew", "dock", "north", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(80)] + [(80, None), (81, ""), (3, "pump")]
    asked = [(i, rng.choice(docs[:80])[1][rng.randint(0, 9) :][: rng.randint(1, 60)]) for i in range(150)]
    asked += [(500, None), (0, asked[0][1]), (501, "no such words stand here"), (502, "{}")]
    q, d = spark.createDataFrame(asked, "quote_id int, evidence string"), spark.createDataFrame(docs, "page_id int, content string")
    once = {tuple(r) for r in quotes_in_corpus(q, gr.searchable(d)).collect()}
    rows = [tuple(r) for r in quotes_in_corpus(q, gr.searchable(d), keys_per_pass=9, short_bytes=40).collect()]
    want = {(i, p) for i, t in asked if t and t.strip() for p, c in docs if t.strip() in f" {c or ''} {{}}"}
    assert len(rows) == len(set(rows)) and set(rows) == once == want
    assert quotes_in_corpus(q.limit(0), gr.searchable(d)).count() == quotes_in_corpus(q, gr.searchable(d.limit(0))).count() == 0


def test_only_keys_that_a_quote_has_leave_a_page(spark, monkeypatch):
    """Pages hand on the keys of quotes and nothing else, whatever their length."""
    kept = []
    monkeypatch.setattr(quotes, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    d = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 977}" for j in range(3000))) for i in range(1, 20)] + [(99, "the red pump of oslo runs")], "page_id int, content string")
    q = spark.createDataFrame([(1, "the red pump of oslo"), (2, "zq"), (3, "never red pump of this")], "quote_id int, evidence string")
    assert [tuple(r) for r in quotes_in_corpus(q, gr.searchable(d)).collect()] == [(1, 99)]
    found = kept[-1].collect()
    # "red pump of" is the key of the first and the third quote.
    assert [(r["page_id"], len(r["keys"]), r["piece"], r["marks"]) for r in found] == [(99, 1, [], [])]


def test_runs_of_words(spark):
    import numpy as np
    import pyarrow as pa

    texts = ["a b c", None, "", "über b c", "a b c d", "b"]
    runs = Runs(pa.array(texts))
    for n in (1, 2, 3):
        row, name = runs.of_size(n)
        want = [(r, " ".join(w[i : i + n])) for r, t in enumerate(texts) for w in [(t or "").split()] for i in range(len(w) - n + 1)]
        assert row.tolist() == [r for r, _ in want]
        by = {}
        for (_, text), x in zip(want, name.tolist()):
            assert by.setdefault(text, x) == x
        assert len(set(by.values())) == len(by)
    assert among(np.array([1, 5, 7]), np.array([5, 6])).tolist() == [False, True, False]
