"""Page content, crawl rules, model input and model answers as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospark.functions import urls as U
from prospark.operators import context as cx
from prospark.operators import crawl as cr
from prospark.operators import html as ht
from prospark.operators import pages as pg
from prospark.operators import qualify as ql
from prospark.plans.entity_sql import over
from prospark.plans.pages import EMAIL, VARIED_SQL, varied
from prospark.plans.registry import query
from prospark.session import scratch_path
from prospark.sources import sinks


# The layout of the stored pages: a box, a heading and paragraphs, some of them bold and never closed.
PAGE_TEXT_SQL = r"""
WITH w AS (SELECT page_id, regexp_replace(html, '\s+', ' ', 'g') AS h FROM pages),
p AS (SELECT page_id, trim(regexp_extract(h, '<div class="ad">(.*?)</div>', 1)) AS box, trim(regexp_extract(h, '<h1>(.*?)</h1>', 1)) AS title,
    regexp_replace(regexp_extract(h, '</h1>(.*)</article>', 1), ' *(</?p>|<br>|<b>) *', '\1', 'g') AS body FROM w),
b AS (SELECT *, (length(body) - length(replace(body, '<b>', ''))) // 3 AS bolds, ends_with(body, '<br>') AS cut FROM p),
t AS (SELECT page_id, box || E'\n\n# ' || title || replace(replace(replace(replace(regexp_replace(body, '<br>$', E'\n'), '<br>', ''), '</p>', ''),
    '<p>', E'\n\n'), '<b>', '**') || CASE WHEN cut THEN '**' || repeat(E'\n\n**', bolds - 1) ELSE repeat(E'\n\n**', bolds) END AS x FROM b),
u AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''),
    '&amp;?', '&', 'g') AS content FROM t)
SELECT page_id, content, sha256(content) AS content_hash FROM u"""


@query("page_text", PAGE_TEXT_SQL)
def page_text(e):
    return ht.page_text(e.table("pages")).select("page_id", "content", "content_hash")


@query(
    "page_metadata",
    """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
    trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'),
        '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g')) AS title FROM pages""",
)
def page_metadata(e):
    return ht.page_metadata(e.table("pages")).select("page_id", "language", "title")


def marked_pages(e):
    """Pages with structured data about their host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    org = F.to_json(F.struct(F.lit("Organization").alias("@type"), host.alias("name")))
    graph = F.to_json(
        F.struct(
            F.array(
                F.struct(F.lit("LocalBusiness").alias("@type"), host.alias("name")),
                F.struct(F.lit("Recipe").alias("@type"), host.alias("name")),
                F.struct(F.lit(None).cast("string").alias("@type"), F.lit("untyped").alias("name")),
            ).alias("@graph")
        )
    )
    which = F.when(F.col("page_id") % 3 == 0, org).when(F.col("page_id") % 3 == 1, graph).otherwise(F.lit("{broken"))
    block = F.concat(F.lit('<script type="application/ld+json">'), which, F.lit("</script>"))
    return e.table("pages").select("page_id", F.concat("html", block).alias("html"))


@query(
    "jsonld_entities",
    """SELECT page_id, 'Organization' AS entity_type, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS name FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, 'LocalBusiness', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages WHERE page_id % 3 = 1
    UNION ALL SELECT page_id, '', 'untyped' FROM pages WHERE page_id % 3 = 1""",
)
def jsonld_entities(e):
    rows = ht.jsonld_entities(marked_pages(e))
    return rows.select("page_id", "entity_type", F.get_json_object("entity", "$.name").alias("name"))


AGENT = "ProspectBot/1.0"
# Policy texts of the query below: one with a group of its own for the crawler, one without.
POLICIES = {
    0: "User-agent: *\nDisallow: /files/\nAllow: /files/open/\n\nUser-agent: otherbot\nDisallow: /\n",
    1: "User-agent: prospectbot\nDisallow: /about\nDisallow: /careers\n\nUser-agent: *\nDisallow: /about\n",
}


def policies(e):
    """One policy file per host: two kinds of rules, a missing and a forbidden file."""
    size = F.length("host")
    hosts = e.table("pages").select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("host")).distinct()
    return hosts.select(
        "host",
        F.when(size % 4 == 2, 404).when(size % 4 == 3, 403).otherwise(200).alias("status_code"),
        F.when(size % 4 == 0, POLICIES[0]).when(size % 4 == 1, POLICIES[1]).alias("body"),
    )


@query(
    "robots_filter",
    f"""WITH {VARIED_SQL} SELECT page_id, url, CASE length(host) % 4 WHEN 2 THEN true WHEN 3 THEN false
        WHEN 0 THEN NOT starts_with(path, '/files/') ELSE NOT starts_with(path, '/about') END AS allowed FROM varied""",
)
def robots_filter(e):
    return cr.robots_filter(varied(e), policies(e), AGENT).select("page_id", "url", "allowed")


@query("crawl_plan")
def crawl_plan(e):
    """Each host's pages as a site: the first page is the root and links to all, each page links to the next."""
    rows = e.table("pages").select(
        "page_id",
        U.canonical(F.col("url")).alias("url"),
        U.domain(F.col("url")).alias("domain"),
        F.sha2("html", 256).alias("content_hash"),
        F.length("html").alias("body_chars"),
    )
    first = rows.groupBy("domain").agg(F.min_by("url", "page_id").alias("root"))
    facts = rows.groupBy("url").agg(
        F.min_by("content_hash", "page_id").alias("content_hash"),
        F.min_by("body_chars", "page_id").alias("body_chars"),
        (F.min("page_id") % 5 != 4).alias("fetched"),
        F.lit(True).alias("allowed"),
    )
    star = rows.join(first, "domain").select(F.col("root").alias("src_url"), F.col("url").alias("dst_url"))
    chain = rows.select(F.col("url").alias("src_url"), (F.col("page_id") + 1).alias("page_id")).join(
        rows.select("page_id", F.col("url").alias("dst_url")), "page_id"
    )
    edges = star.unionByName(chain.drop("page_id"))
    roots = first.select("domain", F.col("root").alias("url"))
    return cr.crawl_plan(roots, facts, edges)


@query(
    "crawl_summary",
    over(
        "crawl_targets",
        f""", c AS (SELECT target_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '{EMAIL}'), lambda x: lower(x)))) AS v FROM crawled_pages
            WHERE page_id % 5 <> 0)
        SELECT target_id, count(DISTINCT url) AS pages_discovered, count(*) FILTER (page_id % 5 <> 0) AS pages_crawled,
        count(*) FILTER (page_id % 5 = 0) AS pages_failed, any_value(coalesce(m, 0)) AS emails_found, any_value(coalesce(n, 0)) AS phones_found,
        CASE WHEN count(*) FILTER (page_id % 5 <> 0) > 0 THEN 'completed' ELSE 'failed' END AS status
        FROM crawled_pages LEFT JOIN (SELECT target_id, count(DISTINCT p) AS n FROM (SELECT target_id,
            unnest(regexp_extract_all(html, '\\d{{3}}-\\d{{4}}')) AS p FROM crawled_pages WHERE page_id % 5 <> 0) GROUP BY target_id) USING (target_id)
        LEFT JOIN (SELECT target_id, count(DISTINCT v) AS m FROM c WHERE NOT regexp_matches(v, '\\.(png|jpg|jpeg|gif|webp|svg|css|js)$')
            AND split_part(v, '@', 2) NOT IN ('example.com', 'domain.com', 'yoursite.com', 'yourdomain.com', 'email.com')
            AND length(split_part(v, '@', 1)) >= 2 GROUP BY target_id) USING (target_id)
        GROUP BY target_id""",
    ),
)
def crawl_summary(e):
    pages = e.crawled_pages()
    ok = F.col("page_id") % 5 != 0
    crawled = pages.filter(ok)
    log = pages.select("target_id", "url", ok.alias("ok"))
    phones = F.regexp_extract_all("html", F.lit(r"\d{3}-\d{4}"), F.lit(0))
    found = crawled.select("target_id", F.lit("email").alias("kind"), F.explode(pg.emails(F.col("html"))).alias("contact"))
    found = found.unionByName(crawled.select("target_id", F.lit("phone").alias("kind"), F.explode(phones).alias("contact")))
    targets = e.crawl_targets().select("target_id")
    return cr.crawl_summary(targets, crawled.select("target_id"), log, found)


@query(
    "prompt_budget",
    over(
        "doc_pages",
        """SELECT page_id, target_id, CAST(CASE WHEN b + n_chars <= 16000 THEN n_chars ELSE 16000 - b END AS BIGINT) AS kept_chars,
        b + n_chars > 16000 AS is_cut FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY target_id ORDER BY depth, page_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM doc_pages)
        WHERE b + n_chars <= 16000 OR 16000 - b > 300""",
    ),
)
def prompt_budget(e):
    slim = e.doc_pages().select("target_id", "page_id", "depth", "n_chars")
    return cx.prompt_budget(slim).select("page_id", "target_id", "kept_chars", "is_cut")


def _context_targets(e):
    return e.doc_pages().select("target_id", "domain").distinct().withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/")))


CONTEXT_SQL = r""", d AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body FROM doc_pages),
    k AS (SELECT * FROM d WHERE length(body) >= 5 QUALIFY row_number() OVER (PARTITION BY target_id, sha256(content) ORDER BY depth, page_id) = 1),
    i AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY depth, page_id) AS n FROM k),
    b AS (SELECT *, '## Page ' || n || ' [page-' || n || E']\nAddress: ' || url || E'\nHeadline: ' || title
        || E'\n\nText:\n' || body || E'\n\n' AS txt FROM i),
    s AS (SELECT *, coalesce(sum(length(txt)) OVER (PARTITION BY target_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
    t AS (SELECT target_id, n, CASE WHEN before + length(txt) <= 16000 THEN txt
        ELSE substr(txt, 1, CAST(16000 - before AS INT)) || E'\n[cut here]' END AS txt
        FROM s WHERE before + length(txt) <= 16000 OR 16000 - before > 300)"""


@query(
    "build_context",
    over(
        "doc_pages",
        CONTEXT_SQL
        + r""" SELECT target_id, 1 AS section, CAST(0 AS BIGINT) AS part, E'# Site\nHost: ' || domain
            || E'\nStart: https://' || domain || E'/\n' AS text FROM (SELECT DISTINCT target_id, domain FROM doc_pages)
        UNION ALL SELECT target_id, 3, (n - 1) // 1000, string_agg('- ' || url, E'\n' ORDER BY n) FROM i GROUP BY target_id, (n - 1) // 1000
        UNION ALL SELECT target_id, 4, 0, string_agg(txt, '' ORDER BY n) FROM t GROUP BY target_id""",
    ),
)
def build_context(e):
    return cx.build_context(_context_targets(e), e.doc_pages(), structured_chars=500)


def answers(e):
    """Model answers as JSON text: good ones, and ones with a wrong number or type, a gap, a null list or a broken end."""
    key = F.col("c_custkey")
    one = F.struct(
        F.col("c_name").alias("company_name"),
        F.lit("Sells things").alias("company_summary"),
        F.lit("Cheap").alias("value_proposition"),
        F.when(key % 17 != 0, F.col("c_mktsegment")).alias("industry"),
        F.lit("All").alias("target_audience"),
        F.array(F.lit("A")).alias("products_or_services"),
        F.lit("B2B").alias("business_model"),
        F.lit("Europe").alias("geography"),
        F.lit("Unknown").alias("estimated_company_size"),
        F.floor(F.col("c_acctbal") / 90).cast("int").alias("icp_score"),
        ((key % 103) / F.lit(100.0)).alias("confidence_score"),
        F.lit("Because").alias("qualification_reasoning"),
    )
    text = F.to_json(one)
    text = F.when(key % 31 == 0, F.replace(text, F.lit('"Sells things"'), F.lit('7'))).otherwise(text)
    text = F.when(key % 37 == 0, F.replace(text, F.lit('["A"]'), F.lit('null'))).otherwise(text)
    text = F.when(key % 41 == 0, F.replace(text, F.lit('"All"'), F.lit('{"who":"All"}'))).otherwise(text)
    text = F.when(key % 43 == 0, F.replace(text, F.lit('["A"]'), F.lit('["A",null]'))).otherwise(text)
    broken = F.substring(text, F.lit(1), F.length(text) - 5)
    return e.table("customer").select(key.alias("lead_id"), F.when(key % 29 == 0, broken).otherwise(text).alias("answer"))


@query(
    "load_qualifications",
    """WITH c AS (SELECT c_custkey AS lead_id, CAST(floor(c_acctbal / 90) AS INT) AS s, (c_custkey % 103) / 100.0::DOUBLE AS f,
        c_custkey AS k, c_mktsegment FROM customer)
    SELECT lead_id, CASE WHEN reason IS NULL THEN s END AS icp_score, CASE WHEN reason IS NULL THEN f END AS confidence_score,
        CASE WHEN reason IS NULL THEN c_mktsegment END AS industry, reason FROM (SELECT *, CASE WHEN k % 29 = 0 THEN 'malformed json'
        ELSE nullif(concat_ws('; ', CASE WHEN k % 17 = 0 THEN 'missing industry' END,
            CASE WHEN k % 31 = 0 THEN 'wrong type company_summary' END, CASE WHEN k % 41 = 0 THEN 'wrong type target_audience' END,
            CASE WHEN k % 37 = 0 THEN 'wrong type products_or_services' END,
            CASE WHEN k % 43 = 0 AND k % 37 <> 0 THEN 'null in products_or_services' END,
            CASE WHEN s < 0 OR s > 100 THEN 'icp_score not in 0..100' END,
            CASE WHEN f > 1 THEN 'confidence_score not in 0..1' END), '') END AS reason FROM c)""",
)
def load_qualifications(e):
    valid, refused = ql.load_qualifications(answers(e))
    none = F.lit(None).cast("string").alias("reason")
    return valid.select("lead_id", "icp_score", "confidence_score", "industry", none).unionByName(
        refused.select(
            "lead_id",
            F.lit(None).cast("int").alias("icp_score"),
            F.lit(None).cast("double").alias("confidence_score"),
            F.lit(None).cast("string").alias("industry"),
            "reason",
        )
    )


PROFILE_SQL = """p AS (SELECT s_suppkey AS campaign_id, s_suppkey % 11 = 0 AS blank,
    CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 2 = 0 THEN 'SaaS|Software|Tech' ELSE 'FURNITURE|MACHINERY' END AS target_industries,
    CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 4 = 0 THEN '11-50|51-200|201-500|500+' ELSE '11-50' END AS target_company_size,
    CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 3 = 0 THEN 'Global|North America|Europe|India' ELSE 'Europe|' || s_name END AS target_geographies,
    CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 5 = 0 THEN 'B2B focus' ELSE 'Business model: Subscription, Licence' END || '|'
        || CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 6 = 0 THEN 'Proprietary software or digital service' ELSE 'Technologies: Spark' END
        AS required_signals,
    'Pure consumer B2C marketplace|Personal blog|Gambling or adult content' AS negative_signals,
    CAST(CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 7 = 0 THEN 60 ELSE s_suppkey % 100 END AS INT) AS min_icp_threshold FROM supplier)"""


def _flat_profile(rows):
    return rows.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else c for c, t in rows.dtypes])


@query("load_icp_config", f"WITH {PROFILE_SQL} SELECT * EXCLUDE (blank) FROM p")
def load_icp_config(e):
    return _flat_profile(ql.load_icp_config(e.campaign_configs()))


@query(
    "resolve_icp",
    f"""WITH {PROFILE_SQL}, j AS (SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 40 END AS campaign_id,
        o_orderkey % 4 = 0 AS own FROM orders)
    SELECT job_id, CASE WHEN own THEN 'job' WHEN p.campaign_id IS NOT NULL AND NOT blank THEN 'campaign' ELSE 'default' END AS source,
        CASE source WHEN 'job' THEN 'Custom' WHEN 'campaign' THEN target_industries
            ELSE 'SaaS|Enterprise Software|Logistics Tech|Supply Chain|Fintech|E-Commerce Tech' END AS target_industries,
        CASE source WHEN 'campaign' THEN required_signals
            ELSE 'B2B focus|Proprietary software or digital service offering' END AS required_signals,
        CAST(CASE source WHEN 'job' THEN 70 WHEN 'campaign' THEN min_icp_threshold ELSE 50 END AS INT) AS min_icp_threshold
    FROM j LEFT JOIN p USING (campaign_id)""",
)
def resolve_icp(e):
    key = F.col("o_orderkey")
    jobs = e.table("orders").select(
        key.alias("job_id"),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 40).alias("campaign_id"),
        F.when(key % 4 == 0, '{"target_industries": ["Custom"], "min_icp_threshold": 70}')
        .when(key % 4 == 1, "{}")
        .alias("icp_profile"),
    )
    rows = _flat_profile(ql.resolve_icp(jobs, e.campaign_configs()))
    return rows.select("job_id", "source", "target_industries", "required_signals", "min_icp_threshold")


@query(
    "append_pages",
    over("crawled_pages", "SELECT target_id AS crawl_target_id, url, lang AS language, '2024-03-0' || (page_id % 5 + 1) AS crawl_date FROM (SELECT *, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM crawled_pages)"),
)
def append_pages(e):
    """Pages written in two appends and read back with their metadata struct."""
    day = F.concat(F.lit("2024-03-0"), (F.col("page_id") % 5 + 1).cast("string"), F.lit(" 08:00:00"))
    pages = e.crawled_pages().select(
        F.col("target_id").alias("crawl_target_id"), "url", F.lit(0).alias("depth"), F.lit(200).alias("status_code"),
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("language"), day.cast("timestamp").alias("fetched_at"),
    )
    path = scratch_path(e.spark, "pages")
    sinks.append_pages(pages.filter(F.col("url").startswith("https:")), path, writers=2)
    sinks.append_pages(pages.filter(~F.col("url").startswith("https:")), path, writers=2)
    schema = sinks.page_rows(pages).schema
    stored = e.spark.read.schema(schema).parquet(path)
    return stored.select(
        "crawl_target_id", "url", F.col("page_metadata.language").alias("language"), F.col("crawl_date").cast("string").alias("crawl_date")
    )


@query(
    "append_audit",
    over("audits", """SELECT model, strftime(created_at, '%Y') AS year, count(*) AS calls,
        CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM audits GROUP BY 1, 2"""),
)
def append_audit(e):
    path = scratch_path(e.spark, "audits")
    sinks.append_audit(e.audits(), path, writers=1)
    schema = e.audits().schema.add("total_tokens", "long").add("call_month", "string")
    stored = e.spark.read.schema(schema).parquet(path)
    return stored.groupBy("model", F.date_format("created_at", "yyyy").alias("year")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens")
    )
