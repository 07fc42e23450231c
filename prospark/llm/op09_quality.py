"""Query of the quality ledger and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospark.llm.quality import CURRENT, POLICIES, RULES, apply_policy, ledger, mask
from prospark.llm.registry import query
from prospark.sources.tables import read_table


#: Scripts without spaces between words, as the SQL engine writes them.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\x{3000}-\x{303F}\x{30A0}-\x{30FF}\x{FF00}-\x{FFEF}]"


def measures_sql(docs: str) -> str:
    """Measurements and failure bits of the rows of `docs` (columns rid, doc_id, text), as common table expressions."""
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return rf"""
m0 AS (SELECT rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
mw AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM m0)),
mr AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM mw) WHERE c > 1),
mc AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM mr) GROUP BY rid),
ml AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM m0),
mn AS (SELECT rid, regexp_extract_all(regexp_replace(t, '{UNSPACED}+', ' ', 'g'), '[^\x20\x09-\x0D]+') AS rs FROM m0),
measured AS (
  SELECT m0.rid, m0.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
    len(rs) AS n_runs, CAST(coalesce(list_sum(list_transform(rs, lambda x: length(x))), 0) AS BIGINT) AS run_chars,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m0 JOIN ml USING (rid) JOIN mn USING (rid) LEFT JOIN mc USING (rid)
),
booked AS (SELECT *, {bits} AS fail_bits FROM measured)"""


SQL = f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),{measures_sql("src")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(fail_bits AS BIGINT) AS fail_bits,
  (fail_bits & {mask(POLICIES["base"])}) <> 0 AS base_failed, (fail_bits & {mask(POLICIES[CURRENT])}) = 0 AS kept
FROM booked
"""


@query("op9_quality_rules", SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of the current policy."""
    book = ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        (~apply_policy(book, POLICIES["base"])).alias("base_failed"), apply_policy(book, POLICIES[CURRENT]).alias("kept"),
    )
