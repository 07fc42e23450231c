"""Model input text per target, within a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions.skew import ordinal, running_total_upto
from prospark.functions.text import strip
from prospark.operators.pages import dedupe_pages


def _kept_chars(before: Column, size: Column, max_chars: int, min_tail: int) -> Column:
    """Characters of a block that fit: all, a cut tail, or none (NULL)."""
    left = F.lit(max_chars) - before
    return F.when(before + size <= max_chars, size).when(left > min_tail, left)


def prompt_budget(
    blocks: DataFrame,
    size: str = "n_chars",
    max_chars: int = rules.PROMPT_CHARS,
    min_tail: int = rules.PROMPT_MIN_TAIL,
    salts: int = 16,
) -> DataFrame:
    """Blocks (target_id, page_id, depth, size) that fit the budget of their target, in order.

    The block that crosses the budget is cut, and only if more than `min_tail`
    characters are left; all later ones are dropped.
    """
    rows = running_total_upto(
        blocks, ["target_id"], ["depth", "page_id"], size, max_chars, F.xxhash64("page_id"), salts, "before"
    )
    kept = rows.withColumn("kept_chars", _kept_chars(F.col("before"), F.col(size), max_chars, min_tail))
    return kept.filter(F.col("kept_chars").isNotNull()).withColumn("is_cut", F.col("kept_chars") < F.col(size))


def _block_text(idx: Column, pages: DataFrame, structured_chars: int | None) -> Column:
    have = lambda n: n in pages.columns
    line = lambda label, value, shown: F.when(shown, F.concat(F.lit(f"{label}: "), value, F.lit("\n"))).otherwise("")
    listed = lambda n: F.array_join(n, ", ")
    filled = lambda n: F.coalesce(F.size(n), F.lit(0)) > 0
    parts = [
        F.concat(F.lit("## Page "), idx, F.lit(" [page-"), idx, F.lit("]\nAddress: "), "url", F.lit("\n")),
        F.concat(F.lit("Headline: "), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("(none)")), F.lit("\n")),
    ]
    if have("description"):
        parts.append(line("Summary line", F.col("description"), F.coalesce("description", F.lit("")) != ""))
    if have("emails"):
        parts.append(line("Mail", listed("emails"), filled("emails")))
    if have("phones"):
        parts.append(line("Phone", listed("phones"), filled("phones")))
    if have("social_links"):
        parts.append(line("Profiles", F.to_json("social_links"), filled("social_links")))
    if have("json_ld"):
        shown = F.coalesce("json_ld", F.lit("[]")) != "[]"
        data = F.col("json_ld") if structured_chars is None else F.substring("json_ld", 1, structured_chars)
        parts.append(line("Markup facts", data, shown))
    body = strip(F.coalesce("content", F.lit("")))
    parts.append(F.concat(F.lit("\nText:\n"), body, F.lit("\n\n")))
    return F.concat(*parts)


def build_context(
    targets: DataFrame,
    pages: DataFrame,
    profiles: DataFrame | None = None,
    max_chars: int = rules.PROMPT_CHARS,
    min_tail: int = rules.PROMPT_MIN_TAIL,
    salts: int = 16,
    urls_per_part: int = 1000,
    structured_chars: int | None = None,
) -> DataFrame:
    """Model input of each target as ordered sections (target_id, section, part, text).

    targets: target_id, domain, url. profiles: target_id, icp_json. Sections are
    1 target, 2 profile, 3 allowed URLs and 4 pages; put together in the order
    (section, part) they are the whole text. Page text is held to `max_chars`, and
    each page's structured data to `structured_chars` if that is given; the URL list names every selected page and so comes in parts of bounded size.
    """
    # Blocks are measured where the page is read; only sizes and keys are shuffled.
    sizes = dedupe_pages(pages, carry={"size": F.length(_block_text(F.lit("0"), pages, structured_chars))})
    sizes = sizes.select("target_id", "page_id", "depth", "url", "size")

    # The page number is part of the block, so its length is first taken with a
    # one-digit number, which can only be too small; the few blocks left are
    # numbered and measured exactly.
    near = running_total_upto(
        sizes, ["target_id"], ["depth", "page_id"], "size", max_chars, F.xxhash64("page_id"), salts, "at_least"
    )
    w = W.partitionBy("target_id").orderBy("depth", "page_id")
    numbered = near.withColumn("idx", F.row_number().over(w).cast("string"))
    numbered = numbered.withColumn("size", F.col("size") + 2 * (F.length("idx") - 1))
    before = F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fitting = numbered.withColumn("kept", _kept_chars(before, F.col("size"), max_chars, min_tail)).filter("kept IS NOT NULL")

    texts = fitting.select("page_id", "idx", "kept", "size").join(pages, "page_id")
    block = _block_text(F.col("idx"), pages, structured_chars)
    shown = F.when(
        F.col("kept") < F.col("size"),
        F.concat(F.substring(block, F.lit(1), F.col("kept").cast("int")), F.lit("\n[cut here]")),
    ).otherwise(block)
    # Bounded by the budget: at most `max_chars` characters per target come together here.
    page_part = texts.groupBy("target_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("depth", "page_id", shown.alias("t")))), lambda x: x["t"]), ""
        ).alias("text")
    )
    section = lambda df, no, part: df.select("target_id", F.lit(no).alias("section"), part.alias("part"), "text")
    first = F.lit(0).cast("bigint")

    head = targets.withColumn(
        "text", F.concat(F.lit("# Site\nHost: "), "domain", F.lit("\nStart: "), "url", F.lit("\n"))
    )
    listed = ordinal(
        sizes, ["target_id"], [F.col("depth"), F.col("page_id")], F.struct("depth", F.floor(F.col("page_id") / 10000)), "n"
    )
    listed = listed.filter("url <> ''").groupBy("target_id", F.floor((F.col("n") - 1) / urls_per_part).alias("part")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("n", "url"))), lambda x: F.concat(F.lit("- "), x["url"])), "\n"
        ).alias("text")
    )
    parts = [section(head, 1, first), section(listed, 3, F.col("part")), section(page_part, 4, first)]
    if profiles is not None:
        icp = profiles.withColumn("text", F.concat(F.lit("# Wanted customers\n"), "icp_json"))
        parts.append(section(icp, 2, first))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
