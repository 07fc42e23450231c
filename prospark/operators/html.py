"""Jobs over raw page markup.

Only the tree-shaped parts (page copy, head facts) run in Python, page by page;
JSON blocks are cut and parsed by Spark itself.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions.html import head_facts, page_copy


def _page_by_page(read, kind: str):
    """`read` as a plain function of one page: pages reach Python by the hundred, whatever a session's Arrow batches hold."""
    return F.udf(read, kind, useArrow=False)


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, content, content_hash): cleaned copy of each page and its sha256."""

    rows = pages.select("page_id", _page_by_page(page_copy, "string")("html").alias("content"))
    return rows.withColumn("content_hash", F.sha2("content", 256))


HEAD_SCHEMA = (
    "title string, description string, canonical_url string, language string, open_graph map<string,string>"
)


def page_metadata(pages: DataFrame) -> DataFrame:
    """Head facts of each page."""

    rows = pages.select("page_id", _page_by_page(head_facts, HEAD_SCHEMA)("html").alias("facts"))
    return rows.select("page_id", "facts.*")


def jsonld_entities(pages: DataFrame) -> DataFrame:
    """Business entities in the structured-data blocks: (page_id, entity_type, entity)."""
    block = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(block), F.lit(1))).alias("block"))
    rows = rows.withColumn("block", F.trim(F.regexp_replace("block", r"^\s+|\s+$", "")))
    rows = rows.filter(F.try_parse_json("block").isNotNull())

    def elements(text: Column) -> Column:
        is_list = F.regexp_replace(text, r"^\s+", "").startswith("[")
        return F.when(is_list, F.from_json(text, "array<string>")).otherwise(F.array(text))

    rows = rows.select("page_id", F.explode(elements(F.col("block"))).alias("item")).filter("item IS NOT NULL")
    graph = F.get_json_object("item", "$['@graph']")
    inner = F.when(graph.startswith("["), F.from_json(graph, "array<string>")).otherwise(F.array("item"))
    rows = rows.select("page_id", F.explode(inner).alias("entity")).filter(F.trim("entity").startswith("{"))
    kind = F.coalesce(F.get_json_object("entity", "$['@type']"), F.lit(""))
    wanted = reduce(or_, [F.contains(F.lower(kind), F.lit(t)) for t in rules.BUSINESS_TYPES])
    return rows.withColumn("entity_type", kind).filter(wanted | (F.col("entity_type") == "")).select(
        "page_id", "entity_type", "entity"
    )
