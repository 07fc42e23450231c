"""Query of the substring deduplication and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospark.llm.passages import without_repeats
from prospark.llm.registry import query
from prospark.sources.tables import read_table

SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
),
hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, w, coalesce(len(ps), 0) AS n_removed,
    list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(ps, []), p)) AS k
  FROM d LEFT JOIN gl USING (doc_id)
)
SELECT doc_id, len(w) AS n_words, n_removed, sha256(coalesce(array_to_string(list_transform(k, lambda p: w[p]), ' '), '')) AS kept_sha256
FROM kept
"""


@query("op3_substring_dedup", SQL)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 13-word passages that stand in an earlier document are removed."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, window=13).select("doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
