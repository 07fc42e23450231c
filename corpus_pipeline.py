"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before it kept. All but the last return the
columns of `docs` as they came; the text is changed by the third stage alone.

Defined cases: the stages' operators say what they do with nulls, empty and repeated rows; a null doc_id passes all
stages that its text passes; an empty table passes as an empty table; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospark.llm.bpe import encode_documents
from prospark.llm.contamination import contaminated_words
from prospark.llm.neardup import near_duplicates
from prospark.llm.passages import without_repeats
from prospark.llm.quality import CURRENT, POLICIES, apply_policy, ledger
from prospark.session import cut_lineage
from prospark.sources.tables import read_table


def _columns(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of `docs` out of the struct `doc`, some of them changed."""
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    book = ledger(docs)
    return _columns(book.where(apply_policy(book, POLICIES[CURRENT])), docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group whose 5-word shingles link at a similarity of 0.8 or more."""
    gone = near_duplicates(docs, width=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 13-word passages of earlier documents; other texts stay as they are, emptied ones as empty texts."""
    rows = without_repeats(docs, window=13)
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return _columns(rows, docs, **changed)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item."""
    rows = contaminated_words(docs, read_table(spark, sf_dir, "benchmark"), window=10)
    return _columns(rows.where("n_hit = 0"), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining text (little-endian unsigned 32-bit), with digests of them and of what they decode to."""
    rows = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc.doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: SQL has no byte-pair merges; the stages are tested against brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
