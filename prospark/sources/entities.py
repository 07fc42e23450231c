"""Views of the stored tables as the entities of the prospect data model.

Every view is a plain projection or join, so column pruning and filters reach
the Parquet scans underneath.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospark.sources.tables import read_table

EPOCH = "2024-01-01 00:00:00"



def _moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")

def _pick(expr: Column, names: list[str]) -> Column:
    """Value of `names` at position `expr` (0-based)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (expr + 1).cast("int"))


def _whole(expr: Column, to: str = "bigint") -> Column:
    return F.floor(expr).cast(to)


def _after(start: Column, amount: Column, unit: str) -> Column:
    parts = {"days": F.lit(0), "hours": F.lit(0), "mins": F.lit(0)}
    parts[unit] = amount.cast("int")
    return start + F.make_dt_interval(parts["days"], parts["hours"], parts["mins"])


class Entities:
    """The entity views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def organizations(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("organization_id"), F.col("n_name").alias("name")
        )

    def campaigns(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("campaign_id"),
            F.col("s_nationkey").cast("bigint").alias("organization_id"),
            F.col("s_name").alias("name"),
            _pick(key % 3, ["ACTIVE", "PAUSED", "ARCHIVED"]).alias("status"),
            _after(_moment("2023-01-01 00:00:00"), key, "hours").alias("created_at"),
        )

    def campaign_configs(self) -> DataFrame:
        """Campaign profile text as it is stored: one JSON object per campaign."""
        key = F.col("s_suppkey")
        some = lambda n, *v: F.when(key % n != 0, F.array(*v)).otherwise(F.array().cast("array<string>"))
        config = F.struct(
            some(2, F.lit("FURNITURE"), F.lit("MACHINERY")).alias("industries"),
            some(3, F.lit("Europe"), F.col("s_name")).alias("geographies"),
            some(4, F.lit("11-50")).alias("company_sizes"),
            some(5, F.lit("Subscription"), F.lit("Licence")).alias("business_models"),
            some(6, F.lit("Spark")).alias("technologies"),
            F.when(key % 7 != 0, (key % 100).cast("int")).alias("minimum_score"),
        )
        return self.table("supplier").select(
            key.alias("campaign_id"),
            F.when(key % 11 == 0, F.lit("{}")).otherwise(F.to_json(config)).alias("icp_config"),
        )

    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"))

    def members(self) -> DataFrame:
        c = self.table("customer")
        key = F.col("c_custkey")
        own = c.select(
            key.alias("user_id"),
            F.col("c_nationkey").cast("bigint").alias("organization_id"),
            F.lit("owner").alias("role"),
            _after(_moment(EPOCH), key % 50, "days").alias("joined_at"),
        )
        guest = c.filter(F.col("c_nationkey") != key % 25).select(
            key.alias("user_id"),
            (key % 25).alias("organization_id"),
            F.lit("member").alias("role"),
            _after(_moment(EPOCH), key % 30, "days").alias("joined_at"),
        )
        return own.unionByName(guest)

    def leads(self, texts: bool = True) -> DataFrame:
        """Leads; without `texts` the summary and value proposition, and the joins for them, are left out."""
        key = F.col("c_custkey")
        c, n = self.table("customer"), self.table("nation")
        rows = c.join(n, c.c_nationkey == n.n_nationkey, "left")
        long = []
        if texts:
            p, d = self.table("part"), self.table("documents")
            rows = rows.join(p, c.c_custkey == p.p_partkey, "left").join(d, c.c_custkey == d.doc_id, "left")
            long = [
                F.coalesce("p_name", F.lit("")).alias("value_proposition"),
                F.coalesce("text", F.lit("")).alias("company_summary"),
            ]
        return rows.select(
            key.alias("lead_id"),
            key.alias("crawl_target_id"),
            F.when(key % 10 != 0, F.col("c_nationkey").cast("bigint")).alias("organization_id"),
            F.when(key % 7 != 0, key % 40).alias("campaign_id"),
            F.col("c_name").alias("company_name"),
            F.concat(F.lit("c"), key.cast("string"), F.lit(".example.com")).alias("domain"),
            F.col("c_mktsegment").alias("industry"),
            F.col("n_name").alias("geography"),
            _pick(key % 4, ["1-10", "11-50", "51-200", "Unknown"]).alias("estimated_company_size"),
            *long,
            _whole(F.greatest("c_acctbal", F.lit(0.0)) / 100, "int").alias("icp_score"),
            ((key % 101) / F.lit(100.0)).alias("confidence_score"),
            _pick(key % 5, ["NEW", "REVIEW", "QUALIFIED", "CONTACTED", "REJECTED"]).alias("status"),
            _after(_moment(EPOCH), key, "mins").alias("created_at"),
        )

    def lead_embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("lead_id"), "embedding")

    def jobs(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        key, cust, state = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
        return o.join(c, o.o_custkey == c.c_custkey, "left").select(
            key.alias("job_id"),
            cust.alias("lead_id"),
            F.col("c_nationkey").cast("bigint").alias("organization_id"),
            (cust % 40).alias("campaign_id"),
            F.when(state == "O", "QUEUED")
            .when(state == "P", "RUNNING")
            .when(key % 4 == 0, "FAILED")
            .otherwise("COMPLETED")
            .alias("status"),
            _pick(key % 3, ["CRAWL", "QUALIFY", "CRAWL_AND_QUALIFY"]).alias("job_type"),
            F.concat(F.lit("crawl:"), cust.cast("string")).alias("idempotency_key"),
            (key % 6 + 1).alias("pages_crawled"),
            (key % 5 == 0).alias("embedding_reused"),
            F.col("o_orderdate").alias("created_at"),
            _after(F.col("o_orderdate"), key % 30, "days").alias("ended_at"),
        )

    def audits(self) -> DataFrame:
        line, o = self.table("lineitem"), self.table("orders")
        return line.join(o, line.l_orderkey == o.o_orderkey).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("audit_id"),
            F.col("o_custkey").alias("lead_id"),
            F.col("l_linestatus").alias("provider"),
            F.col("l_returnflag").alias("model"),
            _whole(F.col("l_extendedprice")).alias("input_tokens"),
            _whole(F.col("l_quantity") * 10).alias("output_tokens"),
            (F.col("l_tax") * 1000).alias("latency_ms"),
            F.col("l_shipdate").alias("created_at"),
        )

    def job_events(self) -> DataFrame:
        return project_job_events(self.table("events"))

    def usage_events(self) -> DataFrame:
        """One usage increment per event; the counter follows the event type."""
        kind = F.col("event_type")
        one = lambda name: F.when(kind == name, 1).otherwise(0).cast("bigint")
        return self.table("events").select(
            (F.col("user_id") % 25).alias("organization_id"),
            F.to_date("ts").alias("date"),
            one("signup").alias("crawls"),
            F.when(kind == "view", _whole(F.col("value"))).otherwise(0).cast("bigint").alias("pages_crawled"),
            one("signup").alias("leads_created"),
            one("click").alias("ai_qualifications"),
            one("click").alias("embeddings_generated"),
            one("purchase").alias("jobs_completed"),
            one("error").alias("jobs_failed"),
            F.when(kind == "click", 0.0008).when(kind == "purchase", 0.001).otherwise(0.0).alias("estimated_ai_cost"),
        )

    def request_log(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.concat(F.lit("site"), F.col("user_id").cast("string")).alias("domain"), "ts"
        )

    def crawled_pages(self) -> DataFrame:
        host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1))
        return self.table("pages").select("page_id", host.alias("target_id"), "url", "html")

    def crawl_targets(self) -> DataFrame:
        size = F.length("target_id").cast("bigint")
        return (
            self.crawled_pages()
            .select("target_id")
            .distinct()
            .select(
                "target_id",
                F.col("target_id").alias("domain"),
                F.when(size % 10 != 0, size % 25).alias("organization_id"),
            )
        )

    def doc_pages(self) -> DataFrame:
        key = F.col("doc_id")
        host = F.concat(F.col("source"), F.lit(".example.com"))
        return self.table("documents").select(
            key.alias("page_id"),
            F.col("source").alias("target_id"),
            F.floor(key / 4).alias("site_id"),
            host.alias("domain"),
            F.concat(F.lit("https://"), host, F.lit("/p/"), key.cast("string")).alias("url"),
            (key % 4).cast("int").alias("depth"),
            F.concat(F.lit("Page "), key.cast("string")).alias("title"),
            F.col("text").alias("content"),
            "n_chars",
        )

    def signals(self) -> DataFrame:
        d, b = self.table("documents"), self.table("benchmark").withColumnRenamed("text", "passage")
        key = F.col("doc_id")
        home = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/p/"))
        return d.join(b, (key % 40) == b.item_id).select(
            key.alias("signal_id"),
            F.floor(key / 2).alias("lead_id"),
            F.col("source").alias("target_id"),
            F.concat(F.col("source"), F.lit(".example.com")).alias("domain"),
            F.concat(F.lit("signal "), key.cast("string")).alias("signal"),
            F.when(key % 10 == 3, F.concat(F.lit("https://other.example.org/p/"), key.cast("string")))
            .when(key % 10 == 7, F.concat(home, F.lit("none")))
            .otherwise(F.concat(home, key.cast("string")))
            .alias("source_url"),
            F.when(key % 2 == 0, F.substring("text", 10, 60)).otherwise(F.col("passage")).alias("evidence"),
            _pick(key % 3, ["positive", "Negative", "neutral"]).alias("sentiment"),
            F.lit("observed").alias("status"),
        )

    def quotes(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("evidence"))


# Stored event types and the job event each one stands for.
JOB_EVENT_TYPES = {
    "signup": "job_created",
    "view": "page_crawled",
    "click": "qualification_started",
    "purchase": "job_completed",
    "error": "job_failed",
}


def project_job_events(events: DataFrame) -> DataFrame:
    """Job-event shape of the raw event table, batch or streaming."""
    pairs = [F.lit(x) for pair in JOB_EVENT_TYPES.items() for x in pair]
    return events.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        (F.col("user_id") % 25).alias("organization_id"),
        F.element_at(F.create_map(*pairs), F.col("event_type")).alias("event_type"),
        F.floor("value").cast("int").alias("progress"),
        F.col("props").alias("data"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
