"""Query of the id files: encode, write, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prospark.llm.idfiles import read_checksums, write_ids
from prospark.llm.registry import query
from prospark.session import scratch_path
from prospark.sources.tables import read_table


@query("op1_bitplane_ids")
def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from files written before."""
    path = scratch_path(spark, "ids")
    write_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_checksums(spark, path)
