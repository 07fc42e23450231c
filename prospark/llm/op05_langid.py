"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospark.llm.langid import identify, train
from prospark.llm.registry import query
from prospark.sources.tables import read_table


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from four fifths of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), train(docs))
