"""Append-only tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_rows(pages: DataFrame) -> DataFrame:
    """Crawled pages in their stored shape: extracted facts go into one metadata struct.

    Facts the input does not have are stored as missing.
    """
    facts = {
        "description": "string", "canonical_url": "string", "language": "string", "emails": "array<string>",
        "phones": "array<string>", "addresses": "array<string>", "internal_links": "array<string>",
        "external_links": "array<string>", "social_links": "map<string,string>", "json_ld": "array<string>",
        "open_graph": "map<string,string>",
    }
    plain = {
        "crawl_target_id": "string", "url": "string", "final_url": "string", "depth": "int", "status_code": "int",
        "title": "string", "content_markdown": "string", "content_hash": "string", "response_time_ms": "double",
        "fetched_at": "timestamp",
    }
    value = lambda n, t: (F.col(n) if n in pages.columns else F.lit(None)).cast(t).alias(n)
    metadata = F.struct(*[value(n, t) for n, t in facts.items()]).alias("page_metadata")
    return pages.select(
        *[value(n, t) for n, t in plain.items()], metadata, F.to_date("fetched_at").alias("crawl_date")
    )


def append_pages(pages: DataFrame, path: str, writers: int = 64) -> None:
    """Adds crawled pages to the page table; earlier fetches of a page stay.

    A day is spread over `writers` tasks by page, so a day with one very large
    target does not become one file.
    """
    spread = F.pmod(F.xxhash64("crawl_target_id", "url"), F.lit(writers))
    rows = page_rows(pages).repartition("crawl_date", spread)
    rows.write.mode("append").partitionBy("crawl_date").parquet(path)


def append_audit(audits: DataFrame, path: str, writers: int = 8) -> None:
    """Adds one row per model call, kept by month."""
    rows = audits.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn(
        "call_month", F.date_format("created_at", "yyyy-MM")
    )
    spread = F.pmod(F.xxhash64("audit_id"), F.lit(writers))
    rows.repartition("call_month", spread).write.mode("append").partitionBy("call_month").parquet(path)


def write_export_csv(exported: DataFrame, path: str) -> None:
    """Exported leads with a header line; quotes inside fields are doubled.

    The export is limited to its best rows, so one ordered file is enough.
    """
    exported.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"'
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_export_json(exported: DataFrame, path: str) -> None:
    exported.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
