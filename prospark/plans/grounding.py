"""Evidence checks as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospark.operators import grounding as gr
from prospark.plans.entity_sql import over
from prospark.plans.registry import query

NORM = "trim(regexp_replace(regexp_replace(lower({}), '[*_#`\"''()\\[\\]:,.-]', ' ', 'g'), '\\s+', ' ', 'g'))"
PAGE = NORM.format("title || ' ' || content || ' {}'")
URL_REASON = """CASE WHEN split_part(split_part(source_url, '//', 2), '/', 1) <> s.domain THEN 'other domain'
    WHEN p.page_id IS NULL THEN 'page not crawled for this target' END"""


@query(
    "ground_signals_url",
    over(
        "signals doc_pages",
        f"""SELECT signal_id, s.target_id, p.page_id, {URL_REASON} AS reason
        FROM signals s LEFT JOIN doc_pages p ON p.target_id = s.target_id AND p.url = s.source_url""",
    ),
)
def ground_signals_url(e):
    rows = gr.ground_signals(e.signals(), e.doc_pages(), check_quote=False)
    return rows.select("signal_id", "target_id", "page_id", "reason")


@query(
    "ground_signals_quote",
    over(
        "signals doc_pages",
        f""", m AS (SELECT signal_id, {NORM.format('s.evidence')} AS q, {PAGE} AS page, {URL_REASON} AS url_reason,
            lower(trim(s.evidence)) AS bare, lower(title || ' ' || content || ' {{}}') AS raw
            FROM signals s LEFT JOIN doc_pages p ON p.target_id = s.target_id AND p.url = s.source_url),
        w AS (SELECT *, string_split(q, ' ') AS words FROM m)
        SELECT signal_id, coalesce(url_reason, CASE WHEN q = '' AND (bare = '' OR NOT contains(raw, bare))
            THEN 'quote not on page' WHEN contains(page, q) OR len(list_filter(list_transform(
            range(1, greatest(len(words) - 2, 1)), lambda i: array_to_string(words[i:i + 3], ' ')),
            lambda s: length(s) >= 20 AND contains(page, s))) > 0 THEN NULL ELSE 'quote not on page' END) AS reason FROM w""",
    ),
)
def ground_signals_quote(e):
    return gr.ground_signals(e.signals(), e.doc_pages()).select("signal_id", "reason")


@query(
    "ground_quotes_corpus",
    over(
        "quotes doc_pages",
        f"""SELECT quote_id, page_id FROM (SELECT quote_id, {NORM.format('evidence')} AS q FROM quotes) JOIN
        (SELECT page_id, {PAGE} AS page FROM doc_pages) ON contains(page, q)""",
    ),
)
def ground_quotes_corpus(e):
    return gr.ground_quotes_corpus(e.quotes(), e.doc_pages())


def leaky_signals(e):
    """Signals of which some cite the next page of the corpus, which belongs to another target."""
    following = e.doc_pages().select((F.col("page_id") - 1).alias("signal_id"), F.col("url").alias("next_url"))
    cited = F.when(F.col("signal_id") % 10 == 3, F.coalesce("next_url", "source_url")).otherwise(F.col("source_url"))
    return e.signals().join(following, "signal_id", "left").withColumn("source_url", cited).drop("next_url")


@query(
    "cross_target_leak",
    over(
        "signals doc_pages",
        """, s AS (SELECT signal_id, g.target_id, CASE WHEN signal_id % 10 = 3 THEN coalesce(p.url, source_url) ELSE source_url END
            AS u FROM signals g LEFT JOIN doc_pages p ON p.page_id = signal_id + 1)
        SELECT signal_id, s.target_id, o.owner_target FROM s
        LEFT JOIN (SELECT url, min(target_id) AS owner_target FROM doc_pages GROUP BY url) o ON o.url = u
        WHERE NOT EXISTS (SELECT 1 FROM doc_pages p WHERE p.target_id = s.target_id AND p.url = u)""",
    ),
)
def cross_target_leak(e):
    return gr.cross_target_leak(leaky_signals(e), e.doc_pages()).select("signal_id", "target_id", "owner_target")


def fact_quals(e):
    """One answer per page of the corpus, citing its own page, a missing one and another site."""
    own = F.col("url")
    return e.doc_pages().select(
        F.col("page_id").alias("qual_id"),
        "target_id",
        "domain",
        F.array(
            F.concat(F.lit("Own page ("), own, F.lit(").")),
            F.concat(F.lit("Missing page "), own, F.lit("/none.")),
            F.lit("Other site https://other.example.org/p/1, as seen"),
            F.lit("No link at all"),
        ).alias("observed_facts"),
        F.create_map(
            F.lit("good"), _claim("A", "observed", F.substring("content", 1, 40), own),
            F.lit("no_quote"), _claim("B", "inferred", F.lit("zq unlikely words qz here"), own),
            F.lit("no_page"), _claim("C", "observed", F.substring("content", 1, 40), F.concat(own, F.lit("/none"))),
            F.lit("free"), _claim("D", "unknown", F.lit("x"), F.lit(None).cast("string")),
        ).alias("grounded_attributes"),
    )


def _claim(value, status, evidence, url):
    return F.struct(
        F.lit(value).alias("value"), F.lit(status).alias("status"), F.lit(0.9).alias("confidence"),
        evidence.alias("evidence"), url.alias("source_url"),
    )


@query(
    "ground_facts",
    over(
        "doc_pages",
        """SELECT page_id AS qual_id, 'Own page (' || url || ').|No link at all' AS facts FROM doc_pages""",
    ),
)
def ground_facts(e):
    rows = gr.ground_facts(fact_quals(e).drop("grounded_attributes"), e.doc_pages())
    return rows.select("qual_id", F.array_join("observed_facts", "|").alias("facts"))


@query(
    "ground_attributes",
    over(
        "doc_pages",
        f"""SELECT page_id AS qual_id, CASE WHEN trim(substr(content, 1, 40)) <> '' THEN 'A' ELSE 'Unknown' END AS good,
        'Unknown' AS no_quote, 'Unknown' AS no_page, 'D' AS free, CAST(0.0 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS url FROM doc_pages""",
    ),
)
def ground_attributes(e):
    rows = gr.ground_attributes(fact_quals(e).drop("observed_facts"), e.doc_pages())
    value = lambda n: F.col("grounded_attributes")[n]["value"].alias(n)
    return rows.select(
        "qual_id", *[value(n) for n in ("good", "no_quote", "no_page", "free")],
        F.col("grounded_attributes")["no_page"]["confidence"].alias("confidence"),
        F.col("grounded_attributes")["no_page"]["source_url"].alias("url"),
    )


def site_pages(e):
    return e.doc_pages().withColumn("target_id", F.col("site_id"))


def site_quals(e):
    """One answer per site, built from the words of its first page and some invented ones."""
    word = lambda n: F.regexp_replace(F.coalesce(F.get(F.split("content", " "), F.lit(n)), F.lit("")), "[^a-zA-Z]", "")
    first = site_pages(e).groupBy("target_id").agg(
        F.min_by("content", "page_id").alias("content"), F.min("page_id").alias("k")
    )
    return first.select(
        "target_id",
        F.lit("51-200").alias("estimated_company_size"),
        F.array(word(0), F.lit("Zqxtech")).alias("technology_signals"),
        F.array(F.concat_ws(" ", word(1), word(2)), F.lit("Quantum toaster kit")).alias("products_or_services"),
        F.when(F.col("k") % 3 == 0, word(3)).otherwise("Atlantis").alias("geography"),
        F.when(F.col("k") % 8 == 0, "B2B SaaS").otherwise("Consulting").alias("business_model"),
        F.lit("Everyone").alias("target_audience"),
        F.lit("Value").alias("value_proposition"),
        F.array(F.lit("products_or_services"), F.lit("zz")).alias("unknown_attributes"),
    )


SITE_SQL = """, st AS (SELECT site_id AS target_id, string_agg(lower(title || ' ' || content || ' {}'), ' ' ORDER BY depth, page_id) AS txt,
        arg_min(content, page_id) AS content, min(page_id) AS k FROM doc_pages GROUP BY site_id),
    w AS (SELECT *, list_transform(range(1, 5), lambda i: regexp_replace(coalesce(string_split(content, ' ')[i], ''), '[^a-zA-Z]', '', 'g')) AS ws FROM st),
    p AS (SELECT *, trim(lower(ws[2] || ' ' || ws[3])) AS prod, regexp_extract_all(trim(lower(ws[2] || ' ' || ws[3])), '[a-z]{3,}') AS pw,
        CASE WHEN k % 3 = 0 THEN ws[4] ELSE 'Atlantis' END AS geo, CASE WHEN k % 8 = 0 THEN 'B2B SaaS' ELSE 'Consulting' END AS model FROM w),
    f AS (SELECT *, regexp_matches(txt, 'employee|headcount|staff|team of|workforce|people') AS size_ok,
        contains(txt, lower(ws[1])) AS tech_ok, contains(txt, prod) OR (len(pw) = 1 AND contains(txt, pw[1]))
            OR (len(pw) > 1 AND contains(txt, pw[1]) AND contains(txt, pw[2])) AS prod_ok,
        geo = 'Unknown' OR contains(txt, lower(geo)) AS geo_ok,
        model <> 'B2B SaaS' OR regexp_matches(txt, 'saas|subscription|software as a service') AS model_ok FROM p)"""


@query(
    "ground_claims_text",
    over(
        "doc_pages",
        SITE_SQL
        + """ SELECT target_id, CASE WHEN size_ok THEN '51-200' ELSE 'Unknown' END AS estimated_company_size,
        CASE WHEN tech_ok THEN ws[1] ELSE '' END AS technology_signals,
        CASE WHEN prod_ok THEN coalesce(nullif(concat_ws(' ', ws[2], ws[3]), ''), '') ELSE '' END AS products_or_services,
        CASE WHEN geo_ok THEN geo ELSE 'Unknown' END AS geography, CASE WHEN model_ok THEN model ELSE 'Unknown' END AS business_model FROM f""",
    ),
)
def ground_claims_text(e):
    rows = gr.ground_claims(site_quals(e), site_pages(e))
    listed = lambda n: F.array_join(n, "|").alias(n)
    return rows.select(
        "target_id", "estimated_company_size", listed("technology_signals"), listed("products_or_services"),
        "geography", "business_model",
    )


@query(
    "unknown_attributes",
    over(
        "doc_pages",
        SITE_SQL
        + """ SELECT target_id, array_to_string(list_sort(list_distinct(list_filter(['products_or_services', 'zz',
            CASE WHEN NOT size_ok THEN 'estimated_company_size' END, CASE WHEN NOT tech_ok THEN 'technology_signals' END,
            CASE WHEN NOT geo_ok THEN 'geography' END, CASE WHEN NOT model_ok THEN 'business_model' END],
            lambda x: x IS NOT NULL))), '|') AS unknown_attributes FROM f""",
    ),
)
def unknown_attributes(e):
    rows = gr.ground_claims(site_quals(e), site_pages(e))
    return rows.select("target_id", F.array_join("unknown_attributes", "|").alias("unknown_attributes"))


MARKERS = ["onthsh oner", "thouther", "queaux ", "vichten"]


@query(
    "ground_sandbox_override",
    over(
        "doc_pages",
        SITE_SQL
        + f""" SELECT target_id, CASE WHEN demo THEN 'Unknown' ELSE geo END AS geography,
        CASE WHEN demo THEN 'Unknown / Non-Commercial' ELSE model END AS business_model,
        CASE WHEN demo THEN 0 ELSE 2 END AS n_products,
        CASE WHEN demo THEN 'business_model|estimated_company_size|geography|products_or_services|target_audience|technology_signals|zz'
            ELSE 'products_or_services|zz' END AS unknown_attributes
        FROM (SELECT *, {' OR '.join(f"contains(txt, '{m}')" for m in MARKERS)} AS demo FROM f)""",
    ),
)
def ground_sandbox_override(e):
    rows = gr.ground_sandbox(site_quals(e), site_pages(e), MARKERS)
    return rows.select(
        "target_id",
        "geography",
        "business_model",
        F.size("products_or_services").alias("n_products"),
        F.array_join("unknown_attributes", "|").alias("unknown_attributes"),
    )
