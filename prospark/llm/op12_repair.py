"""Query of the conversation repair, with its SQL: damage of the given rows, then their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospark.llm.registry import query
from prospark.llm.repair import repaired, report
from prospark.sources.tables import read_table

SQL = r"""
WITH RECURSIVE src AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s
  FROM conversations
),
hit AS (
  SELECT *, xor(4294967295, list_reduce(
              list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
              lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS d
  FROM src
),
damaged AS (
  SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
),
faults AS (
  SELECT c, i, turn, role, text, left(role, 1) AS x,
         CASE WHEN bare = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
),
inserts(q, t, cost, audit, lines) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 1, 0, '', ''), (1, 2, 5, 'I', chr(10) || 'user:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, 0, '', ''), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', chr(10) || 'user:')
),
after_role(t, x, n) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT f.c, f.i, e.t AS q, e.t AS n, 2 AS cost, 'D' AS letter, '' AS line FROM faults f, (SELECT DISTINCT t FROM inserts) e
  UNION ALL
  SELECT f.c, f.i, r.t, r.n, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', chr(10) || f.role || ':' || f.text
  FROM faults f JOIN after_role r ON f.x = r.x WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.c, f.i, r.t, r.n, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', chr(10) || CASE r.x WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text
  FROM faults f JOIN after_role r ON r.x IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')
),
steps AS (
  SELECT c, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT c FROM faults)
  UNION ALL
  SELECT c, i, q, cost, audit, lines FROM (
    SELECT s.c, s.i + 1 AS i, e.n AS q, s.cost + n.cost + e.cost AS cost, s.audit || n.audit || e.letter AS audit, s.lines || n.lines || e.line AS lines
    FROM steps s JOIN inserts n ON n.q = s.q JOIN edits e ON e.c = s.c AND e.i = s.i + 1 AND e.q = n.t
  ) QUALIFY row_number() OVER (PARTITION BY c, q ORDER BY cost, audit) = 1
),
ends AS (
  SELECT s.c, s.cost + n.cost AS cost, s.audit || n.audit AS audit, s.lines || n.lines AS lines
  FROM steps s JOIN (SELECT c, max(i) AS i FROM faults GROUP BY c) l ON l.c = s.c AND l.i = s.i
  JOIN inserts n ON n.q = s.q AND (n.t = 3 OR (s.q = 0 AND n.t = 0))
  QUALIFY row_number() OVER (PARTITION BY s.c ORDER BY s.cost + n.cost, s.audit || n.audit) = 1
),
pairs AS (SELECT c, x || lead(x) OVER (PARTITION BY c ORDER BY i) AS xy, i < max(i) OVER (PARTITION BY c) AS inner_pair FROM faults),
wrong AS (SELECT c, count(*) FILTER (inner_pair AND xy NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY c),
sums AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
  FROM faults GROUP BY c
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM src) o LEFT JOIN sums USING (c) LEFT JOIN wrong USING (c) LEFT JOIN ends USING (c)
"""


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n: rows dropped, emptied, without sentence ends, doubled or given to the user, by a checksum of their place."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    which = F.crc32(place) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.where(which != 0).select(
        "conv_id",
        "turn",
        F.when(which == 4, "user").otherwise(role).alias("role"),
        F.when(which == 1, "").when(which == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(which == 3, 2).otherwise(1).alias("n"),
    )


@query("op12_conversation_repair", SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation, its rows damaged first."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = rows.select(F.struct(F.col("conv_id").alias("id")).alias("conv")).distinct()
    found = ids.join(report(repaired(damaged(rows))), "conv", "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias("cost" if c == "total" else c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "total")]
    return found.select(F.col("conv.id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
