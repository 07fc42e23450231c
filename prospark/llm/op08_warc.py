"""Query of the content-addressed archive and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospark.llm.registry import query
from prospark.llm.warc import read_archive, write_archive
from prospark.session import scratch_path
from prospark.sources.tables import read_table

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(h, {10 * g + 1}, 10)) AS BIGINT) >> {35 - 5 * k}) & 31 AS INT), 1)"
    for g in range(4)
    for k in range(8)
)

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""


@query("op8_warc_archive", SQL)
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, from an archive written before."""
    path = scratch_path(spark, "archive")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
