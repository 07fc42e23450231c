"""Evidence checks: claims against the crawled pages they rest on, as joins.

Page text is reduced to its searchable form once per page. Claims travel as
slim keys, find their page by an equi join on (target, URL spelling), and meet
the text only afterwards, by page id.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions import urls as U
from prospark.functions.text import mark_runs, page_words, plain_words, quote_found, quote_parts, strip
from prospark.operators.quotes import quotes_in_corpus

NO_URL = "missing source url"
OTHER_DOMAIN = "other domain"
NOT_CRAWLED = "page not crawled for this target"
NO_QUOTE = "quote not on page"


def _column(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def page_aliases(pages: DataFrame) -> DataFrame:
    """(target_id, alias, page_id): which page answers to which URL spelling of a target.

    When two pages share a spelling the deeper, later one answers.
    """
    given = [F.trim(c) for c in ("url", "final_url") if c in pages.columns]
    spellings = lambda u: F.array(U.canonical(u), F.regexp_replace(F.lower(u), "/+$", ""), u)
    every = F.array_distinct(F.array_compact(F.flatten(F.array(*[F.coalesce(spellings(u), F.array()) for u in given]))))
    return (
        pages.select("target_id", "page_id", "depth", F.explode(every).alias("alias"))
        .filter("alias <> ''")
        .groupBy("target_id", "alias")
        .agg(F.max(F.struct("depth", "page_id"))["page_id"].alias("page_id"))
    )


def searchable(pages: DataFrame) -> DataFrame:
    """(page_id, words, marks): the text of each page in the form quotes are looked up in."""
    text = page_words(_column(pages, "title", ""), F.col("content"), _column(pages, "metadata", "{}"))
    return pages.select("page_id", plain_words(text).alias("words"), mark_runs(text).alias("marks"))


def match_urls(claims: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Adds page_id and url_reason to `claims` (key, target_id, domain, source_url)."""
    url = F.trim(F.coalesce("source_url", F.lit("")))
    tries = F.array(U.canonical(url), F.regexp_replace(F.lower(url), "/+$", ""), url)
    looked_up = (
        claims.select(key, "target_id", F.posexplode(tries).alias("pos", "alias"))
        .filter("alias IS NOT NULL AND alias <> ''")
        .join(page_aliases(pages), ["target_id", "alias"])
        .groupBy(key)
        .agg(F.min_by("page_id", "pos").alias("page_id"))
    )
    reason = (
        F.when(url == "", NO_URL)
        .when(~U.same_domain(url, F.col("domain")), OTHER_DOMAIN)
        .when(F.col("page_id").isNull(), NOT_CRAWLED)
    )
    return claims.join(looked_up, key, "left").withColumn("url_reason", reason)


def match_quotes(claims: DataFrame, pages: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Adds quote_ok to claims that carry a page_id; a claim without a page has no quote.

    Only pages that a claim cites are brought into the searchable form, and claims without a page meet no page.
    """
    cited = claims.filter(F.col("page_id").isNotNull())
    texts = searchable(pages.join(cited.select("page_id").distinct(), "page_id", "left_semi"))
    joined = cited.withColumn("_quote", quote_parts(F.col(evidence))).join(texts, "page_id", "left")
    ok = F.coalesce(quote_found(F.col("_quote"), F.col("words"), F.col("marks")), F.lit(False))
    bare = claims.filter(F.col("page_id").isNull()).withColumn("quote_ok", F.lit(False))
    return joined.withColumn("quote_ok", ok).drop("_quote", "words", "marks").unionByName(bare)


def ground_signals(signals: DataFrame, pages: DataFrame, key: str = "signal_id", check_quote: bool = True) -> DataFrame:
    """Signals with `reason`: NULL for the ones to keep, else why the signal is refused."""
    checked = match_urls(signals, pages, key)
    free = (_column(signals, "status", "observed") == "unknown") & (F.coalesce("source_url", F.lit("")) == "")
    if check_quote:
        # Only claims with a valid page meet the page text.
        checked = match_quotes(
            checked.withColumn("page_id", F.when(F.col("url_reason").isNull(), F.col("page_id"))), pages
        )
        reason = F.coalesce("url_reason", F.when(~F.col("quote_ok"), NO_QUOTE))
        checked = checked.withColumn("reason", F.when(~free, reason)).drop("quote_ok")
    else:
        checked = checked.withColumn("reason", F.when(~free, F.col("url_reason")))
    return checked.drop("url_reason")


def split_grounded(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.col("reason").isNull()), checked.filter(F.col("reason").isNotNull())


def cross_target_leak(signals: DataFrame, pages: DataFrame, key: str = "signal_id") -> DataFrame:
    """Signals that must not be stored: their URL is no page of their own target.

    `owner_target` names a target whose page it is, if there is one.
    """
    url = F.coalesce("source_url", F.lit(""))
    loose = F.regexp_replace(F.lower(url), "/+$", "")
    tries = F.array_distinct(F.array(F.coalesce(U.canonical(url), loose), loose))
    given = [c for c in ("url", "final_url") if c in pages.columns]
    spelled = F.flatten(F.array(*[F.array(U.canonical(F.col(c)), F.regexp_replace(F.lower(c), "/+$", "")) for c in given]))
    known = pages.select("target_id", F.explode(F.array_compact(spelled)).alias("alias")).distinct()

    looked = signals.filter(url != "").select(key, "target_id", F.explode(tries).alias("alias"))
    good = looked.join(known, ["target_id", "alias"], "left_semi").select(key).distinct()
    leaks = signals.filter(url != "").join(good, key, "left_anti")
    owners = known.groupBy("alias").agg(F.min("target_id").alias("owner_target"))
    owned = looked.join(owners, "alias").groupBy(key).agg(F.min("owner_target").alias("owner_target"))
    return leaks.join(owned, key, "left")


def ground_facts(quals: DataFrame, pages: DataFrame) -> DataFrame:
    """`observed_facts` without the facts whose cited URL does not verify.

    `quals` has qual_id, target_id, domain and observed_facts; the facts of one
    answer are few, so they are put together again per answer.
    """
    found = F.regexp_extract("fact", r"(?U)https?://[^\s)]+", 0)
    facts = quals.select("qual_id", "target_id", "domain", F.posexplode("observed_facts").alias("pos", "fact"))
    facts = facts.withColumn("source_url", F.regexp_replace(found, r"[.,;)\]]+$", "")).withColumn(
        "claim_id", F.struct("qual_id", "pos")
    )
    checked = match_urls(facts, pages, "claim_id")
    kept = checked.filter((F.col("source_url") == "") | F.col("url_reason").isNull())
    lists = kept.groupBy("qual_id").agg(F.sort_array(F.collect_list(F.struct("pos", "fact"))).alias("_kept"))
    none = F.array().cast("array<string>")
    return (
        quals.join(lists, "qual_id", "left")
        .withColumn("observed_facts", F.coalesce(F.transform("_kept", lambda x: x["fact"]), none))
        .drop("_kept")
    )


def ground_attributes(quals: DataFrame, pages: DataFrame) -> DataFrame:
    """`grounded_attributes` with every unverified claim set back to unknown.

    The column is map<string, struct<value, status, confidence, evidence,
    source_url>>. Only observed or inferred claims with a URL are checked.
    """
    fields = ["value", "status", "confidence", "evidence", "source_url"]
    flat = quals.select("qual_id", "target_id", "domain", F.explode("grounded_attributes").alias("name", "a"))
    flat = flat.select("qual_id", "target_id", "domain", "name", *[F.col(f"a.{f}").alias(f) for f in fields])
    flat = flat.withColumn("claim_id", F.struct("qual_id", "name"))
    checked = match_urls(flat, pages, "claim_id")
    checked = match_quotes(
        checked.withColumn("page_id", F.when(F.col("url_reason").isNull(), F.col("page_id"))), pages
    )
    due = F.col("status").isin("observed", "inferred") & (F.coalesce("source_url", F.lit("")) != "")
    bad = due & (F.col("url_reason").isNotNull() | ~F.col("quote_ok"))
    why = F.coalesce("url_reason", F.lit(NO_QUOTE))
    text = F.concat(F.lit("Claim set aside, no crawled page bears it out ("), why, F.lit(")"))
    new = F.struct(
        F.when(bad, "Unknown").otherwise(F.col("value")).alias("value"),
        F.when(bad, "unknown").otherwise(F.col("status")).alias("status"),
        F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(bad, text).otherwise(F.col("evidence")).alias("evidence"),
        F.when(~bad, F.col("source_url")).alias("source_url"),
    )
    maps = checked.groupBy("qual_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("name"), new))).alias("_map"))
    return (
        quals.join(maps, "qual_id", "left")
        .withColumn("grounded_attributes", F.coalesce("_map", F.col("grounded_attributes")))
        .drop("_map")
    )


def _target_text(pages: DataFrame) -> Column:
    return F.lower(page_words(_column(pages, "title", ""), F.col("content"), _column(pages, "metadata", "{}")))


def found_words(needles: DataFrame, pages: DataFrame, salts: int = 16) -> DataFrame:
    """(target_id, found): which of a target's needles occur on any of its pages.

    Pages are never put together: each page is searched on its own and only the
    hits are combined. The pages of one target are spread over `salts` tasks
    and the short needle list is repeated for each. The text of a page ends with
    its metadata object, so no needle can run from one page into the next.
    """
    spread = pages.join(needles.select("target_id").distinct(), "target_id", "left_semi").select(
        "target_id", F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt"), _target_text(pages).alias("text")
    )
    every = needles.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    hits = spread.join(every, ["target_id", "salt"]).select(
        "target_id", F.explode(F.filter("needles", lambda n: F.contains(F.col("text"), n))).alias("hit")
    )
    return hits.groupBy("target_id").agg(F.collect_set("hit").alias("found"))


def _reset(attributes: Column, name: str, when: Column) -> Column:
    """The named attribute set back to unknown where `when` holds."""
    return F.transform_values(
        attributes,
        lambda k, a: F.when(
            when & (k == name),
            F.struct(
                F.lit("Unknown").alias("value"),
                F.lit("unknown").alias("status"),
                a["confidence"].alias("confidence"),
                a["evidence"].alias("evidence"),
                F.lit(None).cast("string").alias("source_url"),
            ),
        ).otherwise(a),
    )


def unknown_attributes(current: Column, *names: Column) -> Column:
    """Sorted distinct union of the listed names; NULL names are left out."""
    none = F.array().cast("array<string>")
    added = F.array_compact(F.array(*names)) if names else none
    return F.sort_array(F.array_distinct(F.array_union(F.coalesce(current, none), added)))


def ground_claims(quals: DataFrame, pages: DataFrame, salts: int = 16) -> DataFrame:
    """Company facts held against all text of their target.

    Size needs a headcount word, every technology and the geography must occur,
    a product needs its full name or most of its words, and a subscription
    model needs a matching word. What fails becomes Unknown or is removed, and
    is named in `unknown_attributes`.
    """
    lower_all = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    words_of = lambda p: F.regexp_extract_all(p, F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), F.lit(0))
    strings = lambda ws: F.array(*[F.lit(w) for w in ws])
    clean = F.transform(lower_all("products_or_services"), lambda p: strip(p))
    geo = F.lower("geography")
    model = F.lower("business_model")
    needles = F.array_distinct(
        F.concat(
            strings(rules.HEADCOUNT_WORDS),
            strings(rules.SUBSCRIPTION_WORDS),
            lower_all("technology_signals"),
            clean,
            F.flatten(F.transform(clean, words_of)),
            F.array(F.coalesce(geo, F.lit("unknown"))),
        )
    )
    wanted = quals.select("target_id", needles.alias("needles"))
    found = found_words(
        wanted.select("target_id", F.explode("needles").alias("n")).groupBy("target_id").agg(F.collect_set("n").alias("needles")),
        pages,
        salts,
    )
    seen = F.col("found")
    has = lambda x: F.array_contains(seen, x)
    any_of = lambda ws: F.arrays_overlap(seen, strings(ws))

    def product_ok(p: Column) -> Column:
        low = strip(F.lower(p))
        words = words_of(low)
        hit = F.size(F.filter(words, has))
        n = F.size(words)
        return has(low) | F.when(n == 1, hit == 1).otherwise((n > 1) & (hit >= 2) & (hit / n >= 0.7))

    rows = quals.join(found, "target_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    size_bad = (F.col("estimated_company_size") != "Unknown") & ~any_of(rules.HEADCOUNT_WORDS)
    geo_bad = (F.col("geography") != "Unknown") & ~has(geo)
    sells = F.contains(model, F.lit("saas")) | F.contains(model, F.lit("subscription"))
    model_bad = ~model.isin("unknown", rules.SANDBOX_MODEL.lower()) & sells & ~any_of(rules.SUBSCRIPTION_WORDS)
    rows = rows.withColumns({"_size_bad": size_bad, "_geo_bad": geo_bad, "_model_bad": model_bad})
    rows = rows.withColumns(
        {
            "technology_signals": F.filter("technology_signals", lambda t: has(F.lower(t))),
            "products_or_services": F.filter("products_or_services", product_ok),
        }
    )
    name_if = lambda cond, name: F.when(cond, F.lit(name))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    out = rows.withColumn(
        "unknown_attributes",
        unknown_attributes(
            F.col("unknown_attributes"),
            name_if(F.col("_size_bad"), "estimated_company_size"),
            name_if(empty("technology_signals"), "technology_signals"),
            name_if(empty("products_or_services"), "products_or_services"),
            name_if(F.col("_geo_bad"), "geography"),
            name_if(F.col("_model_bad"), "business_model"),
        ),
    )
    if "grounded_attributes" in quals.columns:
        attrs = F.col("grounded_attributes")
        for name, flag in (("company_size", "_size_bad"), ("geography", "_geo_bad"), ("business_model", "_model_bad")):
            attrs = _reset(attrs, name, F.col(flag))
        out = out.withColumn("grounded_attributes", attrs)
    for name, flag in (
        ("estimated_company_size", "_size_bad"),
        ("geography", "_geo_bad"),
        ("business_model", "_model_bad"),
    ):
        out = out.withColumn(name, F.when(F.col(flag), "Unknown").otherwise(F.col(name)))
    return out.drop("found", "_size_bad", "_geo_bad", "_model_bad")


def ground_sandbox(quals: DataFrame, pages: DataFrame, markers: list[str] = rules.SANDBOX_MARKERS) -> DataFrame:
    """Company facts of demo sites cleared; a site is a demo if any of its pages shows a marker."""
    text = _target_text(pages)
    shows = reduce(or_, [F.contains(text, F.lit(m)) for m in markers])
    demo = pages.select("target_id", shows.alias("demo")).filter("demo").select("target_id").distinct()
    rows = quals.join(demo.withColumn("_demo", F.lit(True)), "target_id", "left")
    is_demo = F.coalesce("_demo", F.lit(False))
    none = F.array().cast("array<string>")
    cleared = {
        "products_or_services": none,
        "estimated_company_size": F.lit("Unknown"),
        "technology_signals": none,
        "business_model": F.lit(rules.SANDBOX_MODEL),
        "geography": F.lit("Unknown"),
        "target_audience": F.lit("Unknown"),
    }
    marked = [F.when(is_demo, F.lit(n)) for n in cleared]
    values = {name: F.when(is_demo, v).otherwise(F.col(name)) for name, v in cleared.items()}
    values["value_proposition"] = F.when(is_demo, rules.SANDBOX_VALUE).otherwise(F.col("value_proposition"))
    values["unknown_attributes"] = unknown_attributes(F.col("unknown_attributes"), *marked)
    return rows.withColumns(values).drop("_demo")


def ground_quotes_corpus(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, page_id) for every quote that occurs word for word on a page."""
    return quotes_in_corpus(quotes, searchable(docs))
