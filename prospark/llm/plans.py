"""All named queries of the subpackage: importing a query module registers what it defines."""

from prospark.llm import op01_idfiles, op02_licenses, op03_passages, op04_maintext, op05_langid, op06_bpe, op07_neardup, op08_warc, op09_quality, op10_contamination, op11_counts, op12_repair, op13_fim  # noqa: F401
from prospark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
