"""Query of the benchmark decontamination and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospark.llm.contamination import contaminated_words
from prospark.llm.registry import query
from prospark.sources.tables import read_table


def hits_sql(docs: str) -> str:
    """Hit words and items of the rows of `docs` (columns rid, doc_id, text), as common table expressions."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
cd AS (SELECT rid, doc_id, {words} AS w FROM {docs}),
ci AS (SELECT item_id, {words} AS w FROM benchmark),
cw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM ci WHERE len(w) > 0)
),
cn AS (SELECT DISTINCT n FROM cw),
cp AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cd, cn)),
ch AS (SELECT rid, item_id, i, cp.n FROM cp JOIN cw ON cp.n = cw.n AND cp.g = cw.g),
cc AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM ch) GROUP BY rid),
ct AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM ch WHERE item_id IS NOT NULL) GROUP BY rid
),
hits AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM cd LEFT JOIN cc USING (rid) LEFT JOIN ct USING (rid)
)"""


SQL = f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),{hits_sql("src")}
SELECT * EXCLUDE (rid) FROM hits
"""


@query("op10_decontamination", SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated_words(docs, read_table(spark, sf_dir, "benchmark"), window=10).select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
