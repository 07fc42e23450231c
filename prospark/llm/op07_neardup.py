"""Query of the near-duplicate search and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospark.llm.neardup import near_duplicates
from prospark.llm.registry import query
from prospark.sources.tables import read_table


def groups_sql(docs: str) -> str:
    """Components of the rows of `docs` (columns doc_id, text), as common table expressions (recursive)."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
nw AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM {docs}),
ns AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM nw WHERE len(w) > 0)
),
nn AS (SELECT doc_id, count(*) AS n FROM ns GROUP BY doc_id),
ni AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM ns a JOIN ns b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
ne AS (
  SELECT a, b FROM ni JOIN nn x ON x.doc_id = a JOIN nn y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
nr(node, seen) AS (
  SELECT doc_id, doc_id FROM nw
  UNION
  SELECT z.b, nr.seen FROM nr JOIN (SELECT a, b FROM ne UNION ALL SELECT b, a FROM ne) z ON z.a = nr.node
),
groups AS (
  SELECT nw.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, nw.doc_id = c.component_id AS kept
  FROM nw LEFT JOIN nn USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM nr GROUP BY node) c USING (doc_id)
)"""


SQL = f"WITH RECURSIVE{groups_sql('documents')} SELECT * FROM groups"


@query("op7_near_duplicates", SQL)
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)
