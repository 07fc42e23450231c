from pyspark.sql import functions as F

from prospark.functions import urls as U


def values(spark, fn, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, url string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("url"))).collect()]


CASES = {
    "shop.test": "https://shop.test/",
    "  HTTPS://SHOP.Test/About ": "https://shop.test/About",
    "https://shop.test/about#team": "https://shop.test/about",
    "https://shop.test/?utm_source=g&ref=1&keep=true": "https://shop.test/?keep=true",
    "https://shop.test/contact/": "https://shop.test/contact",
    "https://shop.test": "https://shop.test/",
    "http://shop.test:80/a": "http://shop.test/a",
    "https://shop.test:443/a": "https://shop.test/a",
    "https://shop.test:8443/a": "https://shop.test:8443/a",
    "https://shop.test//a///b//": "https://shop.test/a/b",
    "https://shop.test/a?b=2&a=1&b=3&c=&d": "https://shop.test/a?b=2&b=3&a=1",
    "https://shop.test/a?q=x%20y+z*~": "https://shop.test/a?q=x+y+z%2A~",
    "https://shop.test/a?q=100%zz": "https://shop.test/a?q=100%25zz",
    "https://shop.test/a/;v=1": "https://shop.test/a;v=1",
    "https:shop.test/x": "https://shop.test/x",
    "https://shop.test/a b|c": "https://shop.test/a b|c",
    "": None,
    "   ": None,
    "file:///etc/hosts": None,
    "ftp://shop.test": None,
    "shop.test:8080/x": None,
    "https:///x": None,
}


def test_canonical(spark):
    assert values(spark, U.canonical, CASES) == list(CASES.values())


def test_safety(spark):
    unsafe = [
        "http://localhost/x", "http://127.0.0.1:8000", "http://192.168.1.10/a", "http://10.0.0.1/", "http://172.16.0.1/",
        "http://169.254.169.254/latest", "http://[::1]/", "http://[fe80::1]/", "http://[::ffff:10.0.0.1]/", "http://0.0.0.0",
        "http://printer.local/", "http://224.0.0.1/", "/no-host",
    ]
    safe = ["https://shop.test", "http://8.8.8.8/", "http://172.32.0.1", "http://[2606:4700::1111]/", "http://256.1.1.1/"]
    assert "safe" not in values(spark, U.safety, unsafe)
    assert set(values(spark, U.safety, safe)) == {"safe"}


def test_same_domain(spark):
    same = lambda u: U.same_domain(u, F.lit("shop.test"))
    urls = ["https://shop.test/a", "https://www.shop.test", "https://blog.shop.test/x", "https://other.test", "https://myshop.test"]
    assert values(spark, same, urls) == [True, True, True, False, False]
    assert values(spark, U.domain, ["https://sub.shop.test:8080/p", "noscheme/x"]) == ["sub.shop.test", ""]


def test_crawlable_and_priority(spark):
    bad = ["/docs/m.pdf", "/login", "/cart", "/wp-admin", "/payments", "/authors", "/a.JPG"]
    good = ["/about-us", "/services", "/", "/search"]
    at = lambda ps: ["https://shop.test" + p for p in ps]
    assert values(spark, U.crawlable, at(bad)) == [False] * len(bad)
    assert values(spark, U.crawlable, at(good)) == [True] * len(good)
    ranked = at(["/", "", "/about-us", "/services", "/pricing.html", "/x/careers", "/misc", "/team/about"])
    assert values(spark, U.priority, ranked) == [100, 100, 90, 85, 75, 65, 10, 90]


def test_resolve(spark):
    from urllib.parse import urljoin

    base = "https://shop.test/a/b.html?x=1"
    hrefs = ["/c", "c", "../c", "./c", "//cdn.test/x", "https://o.test/y", "?q=2", "../../../c", "c/..", "d/./e"]
    got = values(spark, lambda h: U.resolve(F.lit(base), h), hrefs)
    assert got == [urljoin(base, h) for h in hrefs]
