"""Query of the fill-in-middle transformation, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospark.llm.fim import fill_in_middle, restored
from prospark.llm.registry import query
from prospark.sources.tables import read_table

SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
l AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS g
  FROM d
),
c AS (
  SELECT *, len(lines) AS n, least(g[1] % (len(lines) + 1), g[2] % (len(lines) + 1)) AS a,
         greatest(g[1] % (len(lines) + 1), g[2] % (len(lines) + 1)) AS b
  FROM l
),
p AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 100 THEN 'plain'
              WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(lines[1:a], '') AS prefix,
         array_to_string(lines[a + 1:b], '') AS middle,
         array_to_string(lines[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op13_fill_in_middle", SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every whole text, and of what its output gives back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs).select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    rows = restored(made)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
