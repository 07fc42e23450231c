"""All named queries: importing a plan module registers what it defines."""

from prospark.plans import content, grounding, lifecycle, pages, search, stored, streams, tenants  # noqa: F401
from prospark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
