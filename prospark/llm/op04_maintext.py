"""Query of the main-text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospark.llm.maintext import extract
from prospark.llm.registry import query
from prospark.sources.tables import read_table


@query("op4_main_text")
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read_table(spark, sf_dir, "pages"))
