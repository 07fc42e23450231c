"""Query of the license scan and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospark.llm.licenses import BASE, LICENSES, NOTICES, license_scan, slack_of
from prospark.llm.registry import query
from prospark.sources.tables import read_table

TEMPLATES = (*BASE, *NOTICES, *LICENSES)
_GRAMS = ", ".join(
    f"({t}, '{x.label}', {x.exact}, {len(x.words) - 1}, {slack_of(len(x.words) - 1)}, {o}, '{x.words[o]}', '{x.words[o + 1]}')"
    for t, x in enumerate(TEMPLATES)
    for o in range(len(x.words) - 1)
)

SQL = rf"""
WITH g(template, label, exact, offsets, slack, o, a, b) AS (VALUES {_GRAMS}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
p AS (SELECT rid, i - 1 AS pos, w[i] AS x, w[i + 1] AS y FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
votes AS (
  SELECT rid, template, label, exact, offsets, o, pos,
    unnest(CASE WHEN exact THEN [pos - o] ELSE [CAST(floor((pos - o) / slack) AS BIGINT), CAST(floor((pos - o) / slack) AS BIGINT) - 1] END) AS span
  FROM p JOIN g ON x = a AND y = b
),
firsts AS (SELECT rid, template, label, exact, offsets, span, o, min(pos) AS pos FROM votes GROUP BY ALL),
ordered AS (SELECT *, pos > coalesce(lag(pos) OVER (PARTITION BY rid, template, span ORDER BY o), -1) AS behind FROM firsts),
spans AS (
  SELECT rid, template, label, exact, span, exact AND count(*) = max(offsets) AS whole, count(*) FILTER (behind) / max(offsets) AS share
  FROM ordered GROUP BY rid, template, label, exact, span
),
r AS (SELECT *, whole OR (NOT exact AND share >= 0.7) AS matched FROM spans),
t AS (
  SELECT rid, count(*) FILTER (whole) AS n_base, min(span) FILTER (whole) AS first_word, max(span) FILTER (whole) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (matched) AS labels,
    max(CASE WHEN whole THEN 1.0 ELSE share END) FILTER (matched) AS score
  FROM r GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN t USING (rid)
"""


@query("op2_license_scan", SQL)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and matching notices of every text."""
    return license_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rid")
