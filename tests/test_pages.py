"""One hand-written company page and small sites."""

from pyspark.sql import functions as F

from prospark.operators import crawl as cr
from prospark.operators import html as ht
from prospark.operators import pages as pg

PAGE = """<!DOCTYPE html><html lang="en"><head><title> Northwind Robotics | Picking arms </title>
<meta content="Arms that pick parcels." name="Description">
<link href="https://northwind.test/home" rel="canonical">
<meta property="og:title" content="Northwind"><meta property="OG:type" content="website">
<script type="application/ld+json">{"@type": "Corporation", "name": "Northwind", "telephone": "+1-800-555-0142"}</script>
<script type='application/ld+json'>[{"@type": "Recipe"}, {"@graph": [{"@type": ["Person", "X"]}, {"name": "typeless"}]}]</script>
<script type="application/ld+json">{broken</script><style>.x{}</style></head>
<body><nav><a href="/">Home</a><a href="/about">About</a><a href='/pricing/'>Prices</a></nav>
<div id="cookie-box" class="modal"><p>We use cookies <button>OK</button></p></div>
<div role="dialog">Subscribe now</div>
<main><h1>Parcel picking</h1><p>Northwind moves <b>9 million</b> parcels.</p><h2>What we sell</h2>
<ul><li>Arms</li><li>Grippers &amp; cameras</li></ul>
<p>Mail <a href="mailto:sales@northwind.test?subject=Hi">sales@northwind.test</a>, press.eu@northwind.test or
<a href="tel:+18005550142">+1 (800) 555-0142</a>. Not logo@2x.png, not me@example.com. On 2024-10-02.</p>
<address>12 Harbour <b>Street</b>, Suite 4</address></main>
<footer><a href="https://www.linkedin.com/company/northwind">L</a><a href="https://x.com/northwind">X</a>
<a href="https://twitter.com/second">T</a><a href="https://partner.test/a">P</a><a href="#top">t</a>
<a href="javascript:void(0)">j</a><a href="/files/plan.pdf">pdf</a></footer></body></html>"""


def page(spark):
    return spark.createDataFrame([(1, "https://northwind.test/", PAGE)], "page_id long, url string, html string")


def test_page_text(spark):
    row = ht.page_text(page(spark)).head()
    lines = row.content.split("\n")
    assert "# Parcel picking" in lines and "## What we sell" in lines
    assert "* Arms" in lines and "* Grippers & cameras" in lines
    assert "Northwind moves **9 million** parcels." in lines
    for gone in ("cookies", "OK", "Subscribe", "Home", "LinkedIn", ".x{}", "Picking arms"):
        assert gone not in row.content
    assert len(row.content_hash) == 64 and "\n\n\n" not in row.content


def test_page_text_of_empty_and_unclosed(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "<p>a<p>b<div>c")], "page_id long, html string")
    got = {r.page_id: r.content for r in ht.page_text(df).collect()}
    assert got[1] == "" and got[2] in ("", None) and got[3].split() == ["a", "b", "c"]


def test_pages_do_not_reach_python_in_arrow_batches(spark):
    """An Arrow batch is up to 10 000 whole pages, so a worker's memory would follow their number."""
    for read in (ht.page_text, ht.page_metadata):
        plan = read(page(spark))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan and "InPandas" not in plan


def test_page_metadata(spark):
    r = ht.page_metadata(page(spark)).head()
    assert r.title == "Northwind Robotics | Picking arms" and r.language == "en"
    assert r.description == "Arms that pick parcels." and r.canonical_url == "https://northwind.test/home"
    assert r.open_graph == {"og:title": "Northwind", "og:type": "website"}


def test_jsonld(spark):
    got = {(r.entity_type, r.entity) for r in ht.jsonld_entities(page(spark)).collect()}
    assert {t for t, _ in got} == {"Corporation", '["Person","X"]', ""}


def test_contacts(spark):
    find = lambda kind: {r.contact for r in pg.contacts(page(spark), kind, by="url").collect()}
    assert find("emails") == {"sales@northwind.test", "press.eu@northwind.test"}
    phones = find("phones")
    assert "+18005550142" in phones and "+1 (800) 555-0142" in phones and "2024-10-02" not in phones
    assert "12 Harbour Street , Suite 4" in find("addresses")


def test_links(spark):
    rows = pg.link_graph(page(spark)).collect()
    assert {r.dst_url for r in rows if r.kind == "internal"} == {
        "https://northwind.test/", "https://northwind.test/about", "https://northwind.test/pricing",
    }
    assert "https://partner.test/a" in {r.dst_url for r in rows if r.kind == "external"}
    social = {r.platform: r.profile_url for r in pg.social_profiles(page(spark)).collect()}
    assert social == {
        "linkedin": "https://www.linkedin.com/company/northwind", "twitter": "https://x.com/northwind",
    }


def test_slugs(spark):
    df = spark.createDataFrame([(1, "A & B"), (2, "a-b!"), (3, "***"), (4, "A b")], "k long, name string")
    got = {r.k: r.slug for r in pg.slugs(df, "k").collect()}
    assert got == {1: "a-b", 2: "a-b-1", 3: "workspace", 4: "a-b-2"}


ROBOTS = [
    ("a.test", 200, "User-agent: *\nDisallow: /admin/\nAllow: /admin/open/\nDisallow: /private/ # x\n\nUser-agent: other\nDisallow: /o/\n"),
    ("b.test", 404, None), ("c.test", 403, None), ("d.test", 500, "x"),
    ("e.test", 200, "User-agent: ProspectBot\nDisallow: /x\n\nUser-agent: *\nDisallow: /x\nDisallow: /y\n"),
    ("f.test", 200, "User-agent: ProspectBot\nDisallow: /x\n"),
    ("g.test", 200, "User-agent: *\nDisallow:\n"),
]


def test_robots(spark):
    cases = {
        "https://a.test/": True, "https://a.test/about": True, "https://a.test/admin/x": False,
        "https://a.test/admin/open/x": False, "https://a.test/private/d": False, "https://a.test/o/1": True,
        "https://b.test/x": True, "https://c.test/x": False, "https://d.test/x": True, "https://unknown.test/p": True,
        "https://e.test/x1": False, "https://e.test/y": True, "https://f.test/x": True, "https://g.test/z": True,
    }
    urls = spark.createDataFrame([(u,) for u in cases], "url string")
    robots = spark.createDataFrame(ROBOTS, "host string, status_code int, body string")
    got = {r.url: r.allowed for r in cr.robots_filter(urls, robots, "ProspectBot/1.0").collect()}
    assert got == cases


def test_contacts_end_at_ascii_words_as_their_sql_reads_them(spark):
    """Letters beyond ASCII are no word letters, and only ASCII blanks and digits count."""
    texts = [
        "12 das ist die Stück", "é12 abc def Road", "12 abc def ſt x", "12 a\u212abcd Lane", "12 abİcd Road", "12 ab cd efg St", "12 ab\x0bcd efg St",
        "ébob@acme.orgé x", "call 030 1234 567é", "٣٤٥ 1234 5678", "030 1234 5678",
    ]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "domain string, html string")
    find = lambda kind: {(r["domain"], r["contact"]) for r in pg.contacts(rows, kind, links=False).collect()}
    assert find("addresses") == {("0", "12 das ist die St"), ("1", "12 abc def Road"), ("2", "12 abc def ſt"), ("3", "12 a\u212abcd Lane")}
    assert find("emails") == {("7", "bob@acme.org")}
    assert find("phones") == {("8", "030 1234 567")}
