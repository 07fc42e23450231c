"""Query of the token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prospark.llm.counts import count_tokens
from prospark.llm.registry import query
from prospark.sources.tables import read_table


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether they are more than 4 096."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return rows.select("doc.doc_id", "n_bytes", "n_tokens", "over_limit")
