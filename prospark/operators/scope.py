"""Tenant scopes and lead filters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules


def scope_tenant(df: DataFrame, org: int | None, shared: bool) -> DataFrame:
    """Rows of one tenant; `shared` adds the rows that belong to no tenant."""
    if org is None:
        return df
    own = F.col("organization_id") == F.lit(org)
    return df.filter(own | F.col("organization_id").isNull()) if shared else df.filter(own)


@dataclass(frozen=True)
class LeadFilter:
    search: str | None = None
    min_icp_score: int | None = None
    max_icp_score: int | None = None
    industry: str | None = None
    geography: str | None = None
    status: str | None = None
    organization_id: int | None = None
    campaign_id: int | None = None


def has_text(text: Column, part: str) -> Column:
    """`text ILIKE %part%` in time that follows the text.

    Parts between inner `%` are sought one after another, each at its first place behind the one before: as a part has
    one length wherever it stands, no other choice of places finds more. ILIKE itself tries all choices.
    """
    tokens = re.findall(r"(?s)\\[%_\\]|.", part)
    inner = "".join(" " if len(t) > 1 else t for t in tokens).strip("%")
    if "%" not in inner or "\\" in tokens:  # a wrong escape is left to ILIKE, which raises
        return text.ilike(f"%{part}%")
    # Inside \Q \E no text in lower case can end the quotation.
    quoted = lambda run: F.concat(F.lit(r"\Q"), F.lower(F.lit(run)), F.lit(r"\E"))
    pieces, run = [F.lit(r"(?s)\A(?>.*?")], ""
    for token in tokens:
        if token in ("%", "_"):
            pieces += [quoted(run)] if run else []
            pieces.append(F.lit(")(?>.*?" if token == "%" else "."))
            run = ""
        else:
            run += token[-1]
    pieces += [quoted(run)] if run else []
    return F.rlike(F.lower(text), F.concat(*pieces, F.lit(")")))


def text_match(text: str) -> Column:
    names = ["company_name", "domain", "industry", "company_summary", "value_proposition"]
    return reduce(or_, [has_text(F.col(n), text.strip()) for n in names])


def filter_leads(leads: DataFrame, f: LeadFilter) -> DataFrame:
    """All given conditions at once; blank texts count as not given."""
    out = scope_tenant(leads, f.organization_id, shared=True)
    if f.campaign_id is not None:
        out = out.filter(F.col("campaign_id") == f.campaign_id)
    if f.min_icp_score is not None:
        out = out.filter(F.col("icp_score") >= f.min_icp_score)
    if f.max_icp_score is not None:
        out = out.filter(F.col("icp_score") <= f.max_icp_score)
    for name in ("industry", "geography"):
        given = (getattr(f, name) or "").strip()
        if given:
            out = out.filter(has_text(F.col(name), given))
    if (f.status or "").strip():
        out = out.filter(F.col("status") == f.status.strip().upper())
    if (f.search or "").strip():
        out = out.filter(text_match(f.search))
    return out


def lookup(df: DataFrame, key: str, ids: list, org: int | None, shared: bool = True) -> DataFrame:
    """Point lookup inside a tenant scope; hidden rows do not appear."""
    return scope_tenant(df.filter(F.col(key).isin(ids)), org, shared)


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(rules.ACTIVE_STATES))


def recent_usage(usage: DataFrame, as_of: str, days: int = rules.USAGE_DAYS) -> DataFrame:
    """Rows dated from `as_of` minus `days`, first and last day included."""
    return usage.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def at_least_one(**values: int) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} is {value}, it must be 1 or more")
