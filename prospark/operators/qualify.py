"""Model answers and ideal-customer profiles: JSON text into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions.urls import let, once

# The fields of a model answer. Numbers are read as text first, so
# that a wrong number becomes a reason and not a lost row.
REQUIRED_TEXTS = [
    "company_name", "company_summary", "value_proposition", "industry", "target_audience", "business_model",
    "geography", "estimated_company_size", "qualification_reasoning",
]
TEXT_LISTS = [
    "products_or_services", "technology_signals", "positive_signals", "negative_signals", "observed_facts",
    "inferred_signals", "unknown_attributes",
]
ANSWER_SCHEMA = ", ".join(
    [f"{n} string" for n in REQUIRED_TEXTS]
    + [f"{n} array<string>" for n in TEXT_LISTS]
    + [
        "icp_score string",
        "confidence_score string",
        "contact_signals string",
        "signals array<struct<signal: string, evidence: string, source_url: string, sentiment: string, "
        "status: string, confidence: string>>",
        "grounded_attributes map<string, struct<value: string, status: string, confidence: string, "
        "evidence: string, source_url: string>>",
        "_corrupt_record string",
    ]
)


def _bad_share(x: Column) -> Column:
    """A given number that is not in 0..1."""
    return x.isNotNull() & ~F.coalesce(x.try_cast("double").between(0.0, 1.0), F.lit(False))


_TEXT_FIELDS = r"\b(?:signal|evidence|sentiment|status): (?!STRING)"


def _wrong_types(tree: str) -> list[tuple[Column, str]]:
    """Fields of a parsed answer whose type is not the one of the answer format; a number or object is no text, null is
    no list."""
    kind = lambda name: F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant"))
    off = lambda name, pattern: F.coalesce(~kind(name).rlike(pattern), F.lit(False))
    checks = [(off(n, "^(?:STRING|VOID)$"), f"wrong type {n}") for n in REQUIRED_TEXTS]  # null counts as missing
    checks += [(off(n, "^ARRAY<(?:STRING|VOID)>$"), f"wrong type {n}") for n in TEXT_LISTS]
    checks += [(off(n, "^OBJECT<"), f"wrong type {n}") for n in ("contact_signals", "grounded_attributes")]
    signals = F.coalesce(kind("signals").rlike(_TEXT_FIELDS), F.lit(False)) | off("signals", "^ARRAY<(?:OBJECT<.*|VOID)>$")
    return [*checks, (signals, "wrong type signals")]


def load_qualifications(raw: DataFrame, json_col: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(valid answers as typed columns, refused answers with their reasons)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # The answer is read once as typed fields and once as a tree whose types are looked at.
    parsed = once(once(raw, "a", F.from_json(json_col, ANSWER_SCHEMA, options)), "_tree", F.try_parse_json(json_col))
    a = lambda n: F.col(f"a.{n}")
    broken = F.col("a").isNull() | a("_corrupt_record").isNotNull()
    score = a("icp_score")
    whole = score.rlike(r"^\s*[+-]?\d+(?:\.0*)?\s*$")
    score_ok = F.coalesce(whole & score.try_cast("double").between(0, 100), F.lit(False))
    share_ok = F.coalesce(a("confidence_score").try_cast("double").between(0.0, 1.0), F.lit(False))
    part_bad = lambda s: s["signal"].isNull() | s["evidence"].isNull() | _bad_share(s["confidence"])
    checks = [(a(n).isNull(), f"missing {n}") for n in REQUIRED_TEXTS]
    checks += _wrong_types("_tree")
    checks += [(F.coalesce(F.exists(a(n), lambda x: x.isNull()), F.lit(False)), f"null in {n}") for n in TEXT_LISTS]
    checks += [
        (score.isNull(), "missing icp_score"),
        (score.isNotNull() & ~score_ok, "icp_score not in 0..100"),
        (a("confidence_score").isNull(), "missing confidence_score"),
        (a("confidence_score").isNotNull() & ~share_ok, "confidence_score not in 0..1"),
        (F.coalesce(F.exists(a("signals"), part_bad), F.lit(False)), "bad signal"),
        (
            F.coalesce(
                F.exists(F.map_values(a("grounded_attributes")), lambda g: _bad_share(g["confidence"])), F.lit(False)
            ),
            "bad attribute",
        ),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))
    reasons = F.when(broken, F.array(F.lit("malformed json"))).otherwise(found)
    judged = once(parsed, "reasons", reasons)

    none = F.array().cast("array<string>")
    share = lambda x, default: F.coalesce(x.try_cast("double"), F.lit(default))
    signals = F.transform(
        a("signals"),
        lambda s: F.struct(
            s["signal"].alias("signal"),
            s["evidence"].alias("evidence"),
            s["source_url"].alias("source_url"),
            F.coalesce(s["sentiment"], F.lit("positive")).alias("sentiment"),
            F.coalesce(s["status"], F.lit("observed")).alias("status"),
            share(s["confidence"], 1.0).alias("confidence"),
        ),
    )
    attributes = F.transform_values(
        a("grounded_attributes"),
        lambda k, g: F.struct(
            g["value"].alias("value"),
            F.coalesce(g["status"], F.lit("unknown")).alias("status"),
            share(g["confidence"], 0.0).alias("confidence"),
            g["evidence"].alias("evidence"),
            g["source_url"].alias("source_url"),
        ),
    )
    keep = [c for c in raw.columns if c != json_col]
    valid = judged.filter(F.size("reasons") == 0).select(
        *keep,
        *[a(n).alias(n) for n in REQUIRED_TEXTS],
        *[F.coalesce(a(n), none).alias(n) for n in TEXT_LISTS],
        score.try_cast("double").cast("int").alias("icp_score"),
        a("confidence_score").try_cast("double").alias("confidence_score"),
        a("contact_signals").alias("contact_signals"),
        signals.alias("signals"),
        attributes.alias("grounded_attributes"),
    )
    refused = judged.filter(F.size("reasons") > 0).select(*keep, json_col, F.array_join("reasons", "; ").alias("reason"))
    return valid, refused


CONFIG_SCHEMA = (
    "industries array<string>, geographies array<string>, company_sizes array<string>, "
    "business_models array<string>, technologies array<string>, target_titles array<string>, minimum_score int"
)
PROFILE_SCHEMA = (
    "target_industries array<string>, target_company_size array<string>, target_geographies array<string>, "
    "required_signals array<string>, negative_signals array<string>, min_icp_threshold int"
)
PROFILE_FIELDS = [
    "target_industries", "target_company_size", "target_geographies", "required_signals", "negative_signals",
    "min_icp_threshold",
]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _given(json: Column) -> Column:
    """A profile text that says something: not missing and not an empty object."""
    return json.isNotNull() & ~json.rlike(r"^\s*(?:null|\{\s*\})?\s*$")


def campaign_profile(config_json: Column) -> Column:
    """Profile struct of a campaign configuration, with defaults for what it leaves empty."""
    return let(F.from_json(config_json, CONFIG_SCHEMA), _with_defaults)


def _with_defaults(c: Column) -> Column:
    d = rules.CAMPAIGN_DEFAULTS
    some = lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    or_default = lambda n, texts: F.when(some(c[n]), c[n]).otherwise(_texts(texts))
    signal = lambda n, label, text: F.when(
        some(c[n]), F.concat(F.lit(f"{label}: "), F.array_join(c[n], ", "))
    ).otherwise(text)
    return F.struct(
        or_default("industries", d["target_industries"]).alias("target_industries"),
        or_default("company_sizes", d["target_company_size"]).alias("target_company_size"),
        or_default("geographies", d["target_geographies"]).alias("target_geographies"),
        F.array(
            signal("business_models", "Business model", d["model_signal"]),
            signal("technologies", "Technologies", d["technology_signal"]),
        ).alias("required_signals"),
        _texts(d["negative_signals"]).alias("negative_signals"),
        F.coalesce(c["minimum_score"], F.lit(d["min_icp_threshold"])).alias("min_icp_threshold"),
    )


def load_icp_config(campaigns: DataFrame) -> DataFrame:
    """Campaigns (campaign_id, icp_config) with their profile as typed columns."""
    return campaigns.withColumn("profile", campaign_profile(F.col("icp_config"))).select("campaign_id", "profile.*")


def resolve_icp(jobs: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Profile of each job: its own if it names one, else its campaign's, else the defaults.

    jobs: job_id, campaign_id, icp_profile (JSON text). campaigns: campaign_id, icp_config.
    """
    fixed = {n: F.lit(v) if isinstance(v, int) else _texts(v) for n, v in rules.PROFILE_DEFAULTS.items()}
    # Campaign texts are parsed once per campaign, before they meet the jobs.
    known = campaigns.filter(_given(F.col("icp_config"))).select(
        "campaign_id", campaign_profile(F.col("icp_config")).alias("_campaign")
    )
    filled = lambda p: F.struct(*[F.coalesce(p[n], fixed[n]).alias(n) for n in PROFILE_FIELDS])
    has_own = _given(F.col("icp_profile"))
    rows = jobs.withColumn("_own", F.when(has_own, let(F.from_json("icp_profile", PROFILE_SCHEMA), filled)))
    rows = rows.join(known, "campaign_id", "left")
    default = F.struct(*[fixed[n].alias(n) for n in PROFILE_FIELDS])
    source = F.when(F.col("_own").isNotNull(), "job").when(F.col("_campaign").isNotNull(), "campaign")
    return rows.select(
        "job_id", F.coalesce(source, F.lit("default")).alias("source"), F.coalesce("_own", "_campaign", default).alias("p")
    ).select("job_id", "source", "p.*")


def profile_json(cols: DataFrame) -> Column:
    """Profile columns as the JSON text a model reads."""
    names = {"negative_signals": "negative_disqualifiers", "min_icp_threshold": "qualification_threshold"}
    return F.to_json(F.struct(*[F.col(n).alias(names.get(n, n)) for n in PROFILE_FIELDS]), {"pretty": "true"})
