"""Crawl rules over tables: robots policies, the choice of pages, and crawl summaries."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions import urls as U
from prospark.functions.skew import first_per_key
from prospark.session import cut_lineage

RULE = "array<struct<allow: boolean, prefix: string>>"


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, own_rules, default_rules): the rule lists that apply to one crawler, in file order.

    `robots` has host, status_code and body. One policy file is small, so its
    lines are read in one go by the standard library's own reader.
    """
    name = agent.split("/")[0].lower()

    def listed(entry):
        return [{"allow": r.allowance, "prefix": r.path} for r in entry.rulelines]

    def read(body: str | None):
        parser = RobotFileParser()
        parser.parse((body or "").splitlines())
        mine = next((e for e in parser.entries if e.applies_to(name)), None)
        rest = parser.default_entry
        return listed(mine) if mine else None, listed(rest) if rest else None

    @F.pandas_udf(f"own {RULE}, rest {RULE}")
    def policy(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(b) for b in body], columns=["own", "rest"], dtype=object)

    all_of = lambda allow: F.array(F.struct(F.lit(allow).alias("allow"), F.lit("/").alias("prefix")))
    code = F.col("status_code")
    rows = robots.select("host", "status_code", F.when(code == 200, F.col("body")).alias("body"))
    rows = rows.withColumn("p", policy("body"))
    own = F.when(code == 200, F.col("p.own"))
    rest = (
        F.when(code == 200, F.col("p.rest")).when(code.isin(401, 403), all_of(False)).otherwise(all_of(True))
    )
    return rows.select("host", own.alias("own_rules"), rest.alias("default_rules"))


def _percent(text: Column) -> Column:
    """Path text in the percent-encoded form of the policy rules."""
    raw = F.try_url_decode(
        F.replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    )
    out = F.url_encode(raw)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: Rules of a host that travel with its URLs; the rules of a larger policy are met by the prefixes of a path instead.
PACKED_RULES = 64


def _by_prefix(paths: DataFrame, policies: DataFrame) -> DataFrame:
    """(_host, _path, own, rest): the verdict of the first rule that is a prefix of each path, null where none is.

    A path meets the rules by its own prefixes, of the lengths that rules of its host have: an equi join on (host,
    prefix) whose work follows those lengths and not the number of rules.
    """
    kinds = [("own", "own_rules"), ("rest", "default_rules")]
    listed = [policies.select("_host", F.lit(kind).alias("kind"), F.posexplode(rules_of).alias("place", "r")) for kind, rules_of in kinds]
    prefix = F.when(F.col("r.prefix") == "*", "").otherwise(F.col("r.prefix")).alias("prefix")
    every = listed[0].unionByName(listed[1]).select("_host", "kind", "place", F.col("r.allow").alias("allow"), prefix)
    first = every.groupBy("_host", "kind", "prefix").agg(F.min(F.struct("place", "allow")).alias("rule"))
    lengths = every.groupBy("_host", "kind").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    own = paths.join(lengths, "_host").select("_host", "_path", "kind", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("_path"))
    met = own.withColumn("prefix", F.substring("_path", F.lit(1), F.col("n"))).join(first, ["_host", "kind", "prefix"])
    verdict = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("rule")))["allow"].alias(kind)
    return met.groupBy("_host", "_path").agg(verdict("own"), verdict("rest"))


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str, packed_rules: int = PACKED_RULES) -> DataFrame:
    """Adds `allowed` and `robots_reason` to URLs. Hosts without a policy are allowed.

    The first rule that matches decides. A host of at most `packed_rules` rules has one row of packed rules, which its
    URLs meet however many they are; the distinct paths of other hosts meet rules by prefix.
    """
    u = F.col("url")
    way = F.concat(U.full_path(u), F.when(U.query_text(u) != "", F.concat(F.lit("?"), U.query_text(u))).otherwise(""))
    rows = urls.withColumn("_host", U.netloc(u)).withColumn("_path", _percent(F.when(way == "", "/").otherwise(way)))
    policies = robots_rules(robots, agent).withColumnRenamed("host", "_host")
    count = F.coalesce(F.size("own_rules"), F.lit(0)) + F.coalesce(F.size("default_rules"), F.lit(0))
    policies = policies.withColumns({"_large": count > packed_rules, "_has_own": F.col("own_rules").isNotNull(), "_known": F.col("own_rules").isNotNull() | F.col("default_rules").isNotNull()})
    small = lambda c: F.when(~F.col("_large"), F.col(c)).alias(c)
    rows = rows.join(policies.select("_host", "_large", "_has_own", "_known", small("own_rules"), small("default_rules")), "_host", "left")

    def packed(rule_list: str) -> Column:
        hits = F.filter(rule_list, lambda r: (r["prefix"] == "*") | F.startswith(F.col("_path"), r["prefix"]))
        return F.get(hits, F.lit(0))["allow"]

    large = policies.where("_large")
    paths = rows.where("_large").select("_host", "_path").distinct()
    rows = rows.join(_by_prefix(paths, large), ["_host", "_path"], "left")
    verdict = lambda kind, rule_list: F.coalesce(F.when(F.col("_large"), F.col(kind)).otherwise(packed(rule_list)), F.lit(True))
    default_ok = verdict("rest", "default_rules")
    allowed = F.when(F.col("_has_own"), verdict("own", "own_rules") | default_ok).otherwise(default_ok)
    known = F.coalesce("_known", F.lit(False))
    return (
        rows.withColumn("allowed", allowed)
        .withColumn(
            "robots_reason",
            F.when(~known, "no policy").when(F.col("allowed"), "allowed by policy").otherwise("disallowed by policy"),
        )
        .select(*urls.columns, "allowed", "robots_reason")
    )


def crawl_plan(
    roots: DataFrame,
    pages: DataFrame,
    edges: DataFrame,
    max_pages: int = rules.CRAWL_MAX_PAGES,
    max_depth: int | None = rules.CRAWL_MAX_DEPTH,
    dup_chars: int = 50,
) -> DataFrame:
    """Which stored pages a crawl of each domain would keep, in order.

    roots: domain, url. pages: url, fetched, allowed, content_hash, body_chars.
    edges: src_url, dst_url (internal links). Result: domain, step, url, depth,
    priority, and per domain the number of discovered and failed URLs; a domain of
    which nothing can be kept has one row without a page.

    All domains advance together, one kept page per step, so there are exactly
    `max_pages` rounds whatever the data. A round touches only the links of the
    pages kept before; a domain with very many pages never becomes one group. A
    URL that failed, is disallowed or repeats a kept body can never be kept
    later either, so passing over it does not need a round of its own.
    """
    facts = pages.select("url", "fetched", "allowed", "content_hash", "body_chars")
    links = edges.select("src_url", "dst_url").distinct()
    start = (
        roots.select("domain", "url", F.lit(0).alias("depth"), F.lit(-1).alias("found_at"))
        .join(facts, "url", "left")
        .withColumn("priority", U.priority(F.col("url")))
    )
    queue = cut_lineage(start)  # every URL a domain has discovered so far
    order = [F.desc("priority"), F.asc("depth"), F.asc("found_at"), F.asc("url")]
    kept: DataFrame | None = None
    can_fetch = F.coalesce(F.col("fetched"), F.lit(False)) & F.coalesce(F.col("allowed"), F.lit(True))
    for step in range(max_pages):
        fresh = queue.filter(can_fetch)
        if kept is not None:
            fresh = fresh.join(kept.select("domain", "url"), ["domain", "url"], "left_anti")
            seen = kept.select("domain", F.col("content_hash").alias("seen_hash")).distinct()
            again = (fresh["domain"] == seen["domain"]) & (fresh["content_hash"] == seen["seen_hash"])
            fresh = fresh.join(seen, again & (fresh["body_chars"] > dup_chars), "left_anti")
        chosen = first_per_key(fresh, ["domain"], order).withColumn("step", F.lit(step))
        chosen = cut_lineage(chosen.select("domain", "step", "url", "depth", "found_at", "priority", "content_hash", "body_chars"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        opened = (
            (chosen if max_depth is None else chosen.filter(F.col("depth") < max_depth))
            .join(links, F.col("url") == F.col("src_url"))
            .select("domain", F.col("dst_url").alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(step).alias("found_at"))
            .join(queue.select("domain", "url"), ["domain", "url"], "left_anti")
            .join(facts, "url", "left")
            .withColumn("priority", U.priority(F.col("url")))
        )
        # Each round adds a table of its newly opened URLs; earlier ones are not written again.
        queue = queue.unionByName(cut_lineage(opened.select(*queue.columns)))
    return _with_counts(roots.select("domain").distinct(), kept, queue, max_pages, can_fetch)


def _with_counts(domains: DataFrame, kept: DataFrame, queue: DataFrame, max_pages: int, can_fetch: Column) -> DataFrame:
    """Adds discovered and failed counts per domain.

    A URL that cannot be fetched counts as failed once the crawl reached it: it
    was known when some page was taken and stood before that page, or the crawl
    ran until its queue was empty.
    """
    found = queue.groupBy("domain").agg(F.count(F.lit(1)).alias("discovered"))
    bad = queue.filter(~can_fetch & F.coalesce(F.col("allowed"), F.lit(True))).select(
        "domain", F.col("url").alias("b_url"), "priority", "depth", "found_at"
    )
    place = lambda p: F.struct(-p["priority"], p["depth"], p["found_at"], p["url"])
    # At most `max_pages` kept pages per domain travel with the domain's row.
    taken = kept.groupBy("domain").agg(F.collect_list(F.struct("step", "priority", "depth", "found_at", "url")).alias("taken"))
    before = F.exists(
        "taken",
        lambda t: (F.col("found_at") < t["step"])
        & (F.struct(-F.col("priority"), F.col("depth"), F.col("found_at"), F.col("b_url")) < place(t)),
    )
    drained = F.coalesce(F.size("taken"), F.lit(0)) < max_pages
    failed = (
        bad.join(taken, "domain", "left")
        .filter(drained | F.coalesce(before, F.lit(False)))
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("failed"))
    )
    return (
        domains.join(kept, "domain", "left")
        .join(found, "domain")
        .join(failed, "domain", "left")
        .select("domain", "step", "url", "depth", "priority", "discovered", F.coalesce("failed", F.lit(0)).alias("failed"))
    )


def crawl_summary(targets: DataFrame, pages: DataFrame, fetch_log: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per target: discovered, crawled and failed pages, distinct emails and phones, and final status.

    fetch_log: target_id, url, ok. contacts: target_id, kind (email or phone),
    contact. Distinct values are counted from (target, value) pairs, never from
    one collected list.
    """
    crawled = pages.groupBy("target_id").agg(F.count(F.lit(1)).alias("pages_crawled"))
    fetched = fetch_log.groupBy("target_id").agg(F.count_if(~F.col("ok")).alias("pages_failed"))
    seen = fetch_log.select("target_id", "url").distinct().groupBy("target_id").agg(F.count(F.lit(1)).alias("pages_discovered"))
    found = (
        contacts.select("target_id", "kind", "contact")
        .distinct()
        .groupBy("target_id")
        .agg(
            F.count_if(F.col("kind") == "email").alias("emails_found"),
            F.count_if(F.col("kind") == "phone").alias("phones_found"),
        )
    )
    out = targets
    for part in (seen, crawled, fetched, found):
        out = out.join(part, "target_id", "left")
    counts = ["pages_discovered", "pages_crawled", "pages_failed", "emails_found", "phones_found"]
    status = F.when(F.col("pages_crawled") > 0, "completed").otherwise("failed")
    return out.fillna(0, subset=counts).withColumn("status", status)
