"""URL, link, contact and content jobs as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospark import rules
from prospark.functions import urls as U
from prospark.operators import pages as pg
from prospark.plans.entity_sql import over
from prospark.plans.registry import query

SUFFIXES = ["", "/about", "/pricing/plan.html", "/login", "/files/a.PDF", "/careers/", "/team/x;v=1", "//blog//tag/y"]
TRACK = "|".join(rules.TRACKING_PARAMS)
NORM_SQL = f"""(CASE WHEN regexp_matches(base, '^[a-z]+://[^/]+/?$') THEN rtrim(base, '/') || '/' ELSE rtrim(base, '/') END
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END)"""
NORM_PAGES = f"""norm AS (SELECT page_id, url, {NORM_SQL} AS n FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS base,
    list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '=.')
        AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^({TRACK})$')) AS kept FROM pages))"""
EXT = "|".join(x.replace(".", "\\.") for x in rules.DENIED_EXTENSIONS)
DENY = f"(({EXT})$)|({'|'.join(rules.DENIED_PATHS)})"
VARIED_SQL = f"""varied AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || {SUFFIXES!r}[page_id % 8 + 1] AS url,
    lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, {SUFFIXES!r}[page_id % 8 + 1] AS path FROM pages)"""


def varied(e):
    """Page hosts with a spread of path shapes."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("page_id") % 8 + 1).cast("int"))
    return e.table("pages").select(
        "page_id", F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), suffix).alias("url")
    )


@query(
    "canonical_urls",
    f"""WITH {NORM_PAGES} SELECT n AS normalized_url, count(*) AS pages, min(page_id) AS first_page_id FROM norm GROUP BY n""",
)
def canonical_urls(e):
    return pg.canonical_urls(e.table("pages").select("page_id", "url"))


@query(
    "url_domains",
    "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS domain, count(*) AS pages FROM pages GROUP BY 1",
)
def url_domains(e):
    return pg.url_domains(e.table("pages"))


BASE = ["example.com", "www.example.com", "example.org", "www.thther.example.org"]


@query(
    "same_domain",
    f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
        regexp_replace({BASE!r}[page_id % 4 + 1], '^www\\.', '') AS base FROM pages)
    SELECT page_id, regexp_replace(host, '^www\\.', '') = base
        OR ends_with(regexp_replace(host, '^www\\.', ''), '.' || base) AS same FROM h""",
)
def same_domain(e):
    base = F.element_at(F.array(*[F.lit(s) for s in BASE]), (F.col("page_id") % 4 + 1).cast("int"))
    return e.table("pages").select("page_id", U.same_domain(F.col("url"), base).alias("same"))


@query(
    "crawlable_urls",
    f"WITH {VARIED_SQL} SELECT page_id, url FROM varied WHERE NOT regexp_matches(lower(regexp_replace(path, ';.*', '')), '{DENY}')",
)
def crawlable_urls(e):
    return varied(e).filter(U.crawlable(F.col("url")))


@query(
    "url_priority",
    f"""WITH {VARIED_SQL} SELECT host AS domain, page_id, url, CASE path WHEN '' THEN 100 WHEN '/about' THEN 90
        WHEN '/pricing/plan.html' THEN 75 WHEN '/careers/' THEN 65 WHEN '/team/x;v=1' THEN 65 ELSE 10 END AS priority
    FROM varied QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority DESC, url, page_id) <= 6""",
)
def url_priority(e):
    return pg.url_priority(varied(e), 6)


@query(
    "url_safety",
    """WITH u AS (SELECT c_custkey AS id, c_custkey * 7 % 256 AS a, c_custkey * 13 % 256 AS b, c_custkey % 256 AS c FROM customer)
    SELECT id, CASE WHEN a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
        OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19))
        OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)
        THEN 'private or reserved address' ELSE 'safe' END AS safety FROM u
    UNION ALL SELECT -1 - page_id, CASE WHEN page_id % 3 = 0 THEN 'local hostname' ELSE 'safe' END FROM pages""",
)
def url_safety(e):
    key = F.col("c_custkey")
    octets = F.concat_ws(".", *[x.cast("string") for x in (key * 7 % 256, key * 13 % 256, key % 256)], F.lit("20"))
    ips = e.table("customer").select(key.alias("id"), F.concat(F.lit("http://u:p@"), octets, F.lit(":8080/x")).alias("url"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    local = F.when(F.col("page_id") % 3 == 0, F.lit(".internal")).otherwise("")
    names = e.table("pages").select((-1 - F.col("page_id")).alias("id"), F.concat(F.lit("https://"), host, local, F.lit("/")).alias("url"))
    return ips.unionByName(names).select("id", U.safety(F.col("url")).alias("safety"))


HREFS_SQL = f"""hr AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root,
        unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    lk AS (SELECT DISTINCT page_id, url AS src_url, CASE WHEN href = '/' THEN root || '/' ELSE root || rtrim(href, '/') END AS dst_url,
        'internal' AS kind FROM hr WHERE starts_with(href, '/') AND NOT regexp_matches(lower(href), '{DENY}')
      UNION SELECT page_id, url, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^(m|www|blog|shop|news)\\.', '')
        || '/top', 'internal' FROM pages)"""


def linked(e):
    """(pages with one more link to the top of their site, the site): sites are hosts without a common first label."""
    site = F.regexp_replace(U.domain(F.col("url")), r"^(m|www|blog|shop|news)\.", "")
    return e.table("pages").withColumn("html", F.concat("html", F.lit('<a href="https://'), site, F.lit('/top">Top</a>'))), site


@query("link_graph", f"WITH {HREFS_SQL} SELECT * FROM lk")
def link_graph(e):
    return pg.link_graph(*linked(e))


@query(
    "discovered_urls",
    f"""WITH {HREFS_SQL} SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS url FROM pages
    UNION SELECT dst_url FROM lk""",
)
def discovered_urls(e):
    return _discovered(e)


def _discovered(e):
    pages = e.table("pages")
    roots = pages.select(F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/")).alias("url"))
    return pg.discovered_urls(roots, pg.link_graph(*linked(e)))


@query(
    "uncrawled_urls",
    f"""WITH {HREFS_SQL}, {NORM_PAGES},
        d AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS url FROM pages UNION SELECT dst_url FROM lk
              UNION SELECT n FROM norm WHERE contains(n, '/en/'))
    SELECT url FROM d WHERE url NOT IN (SELECT n FROM norm)""",
)
def uncrawled_urls(e):
    pages = e.table("pages")
    seen = pages.select(U.canonical(F.col("url")).alias("url")).filter(F.col("url").contains("/en/"))
    return pg.uncrawled_urls(_discovered(e).union(seen).distinct(), pages.select("url"))


@query(
    "url_alias_set",
    f"""WITH {NORM_PAGES} SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS target_id, alias FROM
        (SELECT url, unnest([n, rtrim(lower(url), '/'), url]) AS alias FROM norm)""",
)
def url_alias_set(e):
    return pg.url_alias_set(e.crawled_pages().select("target_id", "url"))


EMAIL = rules.EMAIL_PATTERN
TEXTS_SQL = "t AS (SELECT source AS domain, text FROM documents UNION ALL SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), html FROM pages)"


def texts(e):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    docs = e.table("documents").select(F.col("source").alias("domain"), F.col("text").alias("html"))
    return docs.unionByName(e.table("pages").select(host.alias("domain"), "html"))


@query(
    "contact_emails",
    f"""WITH {TEXTS_SQL}, m AS (SELECT domain, unnest(list_distinct(list_transform(regexp_extract_all(text, '{EMAIL}'), lambda x: lower(x))))
        AS contact FROM t)
    SELECT domain, contact, count(*) AS pages FROM m WHERE len(string_split(contact, '@')) = 2
        AND NOT regexp_matches(contact, '\\.(png|jpg|jpeg|gif|webp|svg|css|js)$')
        AND split_part(contact, '@', 2) NOT IN ('example.com', 'domain.com', 'yoursite.com', 'yourdomain.com', 'email.com')
        AND length(split_part(contact, '@', 1)) >= 2 AND length(split_part(contact, '@', 2)) >= 4
    GROUP BY domain, contact""",
)
def contact_emails(e):
    return pg.contacts(texts(e), "emails")


@query(
    "contact_phones",
    f"""WITH {TEXTS_SQL}, m AS (SELECT domain, unnest(list_distinct(list_transform(regexp_extract_all(text, '{rules.PHONE_PATTERN}'),
        lambda x: trim(x)))) AS contact FROM t)
    SELECT domain, contact, count(*) AS pages FROM m WHERE length(regexp_replace(contact, '\\D', '', 'g')) BETWEEN 7 AND 15
        AND NOT regexp_matches(contact, '{rules.DATE_PATTERN}') GROUP BY domain, contact""",
)
def contact_phones(e):
    return pg.contacts(texts(e), "phones")


@query(
    "contact_addresses",
    f"""WITH t AS (SELECT source AS domain, text, NULL AS box FROM documents
        UNION ALL SELECT h, html || '<address>12 Harbour Works Street<br> <b>' || h || '</b></address>', '12 Harbour Works Street ' || h
        FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)),
    m AS (SELECT domain, unnest(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(text, '{rules.STREET_PATTERN}'),
        lambda x: trim(x)), lambda x: length(x) > 12), CASE WHEN box IS NULL THEN [] ELSE [box] END))) AS contact FROM t)
    SELECT domain, contact, count(*) AS pages FROM m GROUP BY domain, contact""",
)
def contact_addresses(e):
    """Pages extended by an address box with their host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    box = F.concat("html", F.lit("<address>12 Harbour Works Street<br> <b>"), host, F.lit("</b></address>"))
    docs = e.table("documents").select(F.col("source").alias("domain"), F.col("text").alias("html"))
    return pg.contacts(docs.unionByName(e.table("pages").select(host.alias("domain"), box.alias("html"))), "addresses")


@query(
    "social_profiles",
    """SELECT page_id, 'linkedin' AS platform, 'https://www.linkedin.com/company/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
        AS profile_url FROM pages
    UNION ALL SELECT page_id, 'twitter', regexp_extract(url, '^[a-z]+:', 0) || '//x.com/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
        FROM pages""",
)
def social_profiles(e):
    """Pages extended by a profile link built from their host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    first = F.concat(F.lit('<a href="https://www.linkedin.com/company/'), host, F.lit('">L</a><a href="//x.com/'), host, F.lit('">X</a>'))
    return pg.social_profiles(e.table("pages").withColumn("html", F.concat("html", first)))


@query(
    "content_hash",
    """SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1""",
)
def content_hash(e):
    return pg.duplicate_groups(e.table("documents"), "doc_id", "text")


@query(
    "dedupe_pages_hash",
    over(
        "doc_pages",
        r"""SELECT page_id, target_id, depth FROM doc_pages WHERE length(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 5
        QUALIFY row_number() OVER (PARTITION BY target_id, sha256(content) ORDER BY depth, page_id) = 1""",
    ),
)
def dedupe_pages_hash(e):
    return pg.dedupe_pages(e.doc_pages()).select("page_id", "target_id", "depth")


@query(
    "dedupe_crawl_hash",
    over(
        "doc_pages",
        r"""SELECT page_id, target_id, depth FROM doc_pages
        QUALIFY length(regexp_replace(content, '^\s+|\s+$', '', 'g')) <= 50
            OR row_number() OVER (PARTITION BY target_id, sha256(content) ORDER BY depth, page_id) = 1""",
    ),
)
def dedupe_crawl_hash(e):
    return pg.dedupe_pages(e.doc_pages(), only_longer_than=50).select("page_id", "target_id", "depth")


@query(
    "token_estimate",
    over(
        "doc_pages",
        "SELECT target_id, count(*) AS texts, CAST(sum(length(content) // 4) AS BIGINT) AS tokens FROM doc_pages GROUP BY target_id",
    ),
)
def token_estimate(e):
    return pg.token_estimate(e.doc_pages())


@query(
    "slugs",
    """WITH b AS (SELECT p_partkey, trim(lower(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g')), '-') AS base FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) - 1 AS k FROM b)
    SELECT p_partkey, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS slug FROM n""",
)
def slugs(e):
    return pg.slugs(e.table("part"), "p_partkey", "p_name")


def quals(e):
    """Company facts per lead, with lists that are sometimes empty."""
    key = F.col("lead_id")
    some = lambda n, *v: F.when(key % n != 0, F.array(*v)).otherwise(F.array().cast("array<string>"))
    return e.leads().select(
        "lead_id", "company_name", "industry", "company_summary", "value_proposition", "geography",
        F.lit("Operations teams").alias("target_audience"),
        F.lit("B2B").alias("business_model"),
        some(2, F.lit("Robots"), F.col("value_proposition")).alias("products_or_services"),
        some(3, F.lit("Spark")).alias("technology_signals"),
        some(5, F.lit("fits"), F.lit("grows")).alias("positive_signals"),
    )


@query(
    "canonical_documents",
    over(
        "leads",
        r"""SELECT lead_id, content, sha256(content) AS content_hash FROM (SELECT lead_id, regexp_replace(E'Company:\n' || company_name
        || E'\n\nIndustry:\n' || industry || E'\n\nSummary:\n' || company_summary || E'\n\nValue proposition:\n' || value_proposition
        || E'\n\nProducts & Services:\n' || CASE WHEN lead_id % 2 <> 0 THEN 'Robots, ' || value_proposition ELSE 'None listed' END
        || E'\n\nTarget audience:\nOperations teams\n\nBusiness Model:\nB2B\n\nGeography:\n' || geography
        || E'\n\nTechnology:\n' || CASE WHEN lead_id % 3 <> 0 THEN 'Spark' ELSE 'None listed' END
        || E'\n\nICP Signals:\n' || CASE WHEN lead_id % 5 <> 0 THEN 'fits; grows' ELSE 'None' END, '^\s+|\s+$', '', 'g') AS content
        FROM leads)""",
    ),
)
def canonical_documents(e):
    return pg.canonical_documents(quals(e))
