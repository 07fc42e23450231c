"""Lead search as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospark.operators import search as se
from prospark.operators import vector_index as vi
from prospark.operators.scope import LeadFilter
from prospark.plans.entity_sql import over
from prospark.plans.registry import query

TEXT = "red Ring of machinery th"
DIST = "round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9)"
SIM = "greatest(0.0::DOUBLE, round(1.0::DOUBLE - distance, 4))"
TERMS = ["red", "ring", "machinery"]
HAY = "lower(company_name || ' ' || industry || ' ' || company_summary || ' ' || value_proposition)"
KEYWORD = "least(1.0::DOUBLE, (" + " + ".join(f"contains({HAY}, '{t}')::INT" for t in TERMS) + ") / 3.0::DOUBLE)"


def first_vector(e) -> list[float]:
    """The query vector of the single-query searches: one stored row, as a caller would pass it."""
    return list(e.table("embeddings").filter(F.col("vec_id") == 0).select("embedding").head()[0])


@query(
    "semantic_topk",
    over(
        "leads lead_embeddings",
        f"""SELECT lead_id, company_name, domain, industry, company_summary, icp_score, confidence_score, geography,
        status, {SIM} AS similarity FROM (SELECT leads.*, {DIST} AS distance FROM leads JOIN lead_embeddings USING (lead_id)
        WHERE organization_id = 3 OR organization_id IS NULL ORDER BY distance, lead_id LIMIT 150)""",
    ),
)
def semantic_topk(e):
    return se.semantic_topk(e.leads(), e.lead_embeddings(), first_vector(e), 150, org=3)


@query("keyword_score", over("leads", f"SELECT lead_id, {KEYWORD} AS keyword_score FROM leads"))
def keyword_score(e):
    return se.keyword_score(e.leads(), TEXT)


@query(
    "hybrid_search",
    over(
        "leads lead_embeddings",
        f"""SELECT lead_id, score, {SIM} AS similarity, icp_score, company_name FROM (
            SELECT *, round(0.6::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - distance)
                + 0.25::DOUBLE * (icp_score / 100.0::DOUBLE) + 0.15::DOUBLE * {KEYWORD}, 4) AS score
            FROM (SELECT leads.*, {DIST} AS distance FROM leads JOIN lead_embeddings USING (lead_id)
                WHERE icp_score >= 10 ORDER BY distance, lead_id LIMIT 300)
            ORDER BY score DESC, distance, lead_id LIMIT 150)""",
    ),
)
def hybrid_search(e):
    rows = se.hybrid_search(
        e.leads(), e.lead_embeddings(), TEXT, first_vector(e), LeadFilter(min_icp_score=10), k=150, pool=300
    )
    return rows.select("lead_id", "score", "similarity", "icp_score", "company_name")


def centroids(e):
    """Query table: the mean vector of each label."""
    cells = e.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "x")))  # one entry per dimension
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(ordered, lambda s: s["x"]).alias("vector")
    )


@query(
    "semantic_topk_batch",
    f"""WITH cells AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i)
        GROUP BY label),
    d AS (SELECT query_id, vec_id AS lead_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 9) AS distance
        FROM q CROSS JOIN embeddings)
    SELECT CAST(query_id AS BIGINT) AS query_id, lead_id, {SIM} AS similarity FROM d
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, lead_id) <= 10""",
)
def semantic_topk_batch(e):
    return se.semantic_topk_batch(centroids(e), e.lead_embeddings(), k=10).drop("distance")


@query(
    "lookalikes",
    f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS lead_id,
        round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT query_id, lead_id, {SIM} AS similarity FROM d
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, lead_id) <= 5""",
)
def lookalikes(e):
    return se.lookalikes(e.lead_embeddings(), k=5, block_rows=512).drop("distance")


@query("ann_candidates")
def ann_candidates(e):
    """Five leads near every lead, from lists and codes fitted on a sample."""
    leads = e.lead_embeddings()
    queries = leads.select(F.col("lead_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vi.fit(leads)
    if index is None:
        return se.lookalikes(leads, k=5).drop("distance")
    rows = vi.search(vi.indexed(leads, index), queries, index, k=5, skip_self=True)
    return rows.select("query_id", "lead_id", se.similarity(F.col("distance")).alias("similarity"))


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in text embedder for the query below: letter frequencies."""
    return [[t.count(c) / max(1, len(t)) for c in "aeionrst"] for t in texts]


LETTERS = " || ',' || ".join(
    f"printf('%.4f', CAST((length(text) - length(replace(text, '{c}', ''))) / greatest(length(text), 1) AS FLOAT)::DOUBLE)"
    for c in "aeionrst"
)


@query(
    "embed_with",
    f"SELECT doc_id AS lead_id, sha256(text) AS content_hash, {LETTERS} AS vector FROM documents WHERE lang <> 'en'",
)
def embed_with(e):
    docs = e.table("documents").select(
        F.col("doc_id").alias("lead_id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"),
        F.when(F.col("lang") == "en", "reuse").otherwise("insert").alias("action"),
    )
    rows = se.embed_with(docs, letter_counts)
    return rows.select("lead_id", "content_hash", F.array_join(F.transform("embedding", lambda x: F.format_number(x, 4)), ",").alias("vector"))
