"""Job life cycle: submissions, transitions, durations, politeness and retries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions.skew import first_per_key, lag_within, running_max_before
from prospark.operators.scope import active_jobs, recent_usage


def latest_active_job(jobs: DataFrame) -> DataFrame:
    """Newest queued or running job of each idempotency key, as one map-side-combined aggregate."""
    best = F.max(F.struct("created_at", "job_id", "status")).alias("j")
    return active_jobs(jobs).groupBy("idempotency_key").agg(best).select("idempotency_key", "j.*")


def submission_key(kind: Column, org: Column, subject: Column) -> Column:
    """kind:org:subject, or kind:subject for a request of no tenant."""
    return F.concat_ws(":", kind, org.cast("string"), subject)


def submissions(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """What happens to each submission: reuse the active job, follow an earlier request, or create a job.

    `requests` has request_id, idempotency_key, requested_at and force. Without
    force a request reuses the active job of its key; if there is none, the
    first request of the batch creates one and later ones reuse it. A forced
    request always creates.
    """
    running = latest_active_job(jobs).select("idempotency_key", F.col("job_id").alias("active_job_id"))
    # Of the requests of one key only the earliest creates a job; later ones follow the
    # newest job created before them, forced or not.
    first = requests.groupBy("idempotency_key").agg(
        F.min(F.struct("requested_at", "request_id")).alias("_first")
    )
    opens = F.col("_first.request_id") == F.col("request_id")
    action = (
        F.when(F.col("force"), "create")
        .when(F.col("active_job_id").isNotNull(), "reuse_active")
        .when(opens, "create")
        .otherwise("reuse_batch")
    )
    return (
        requests.join(first, "idempotency_key")
        .join(running, "idempotency_key", "left")
        .withColumn("action", action)
        .withColumn("active_job_id", F.when(F.col("action") == "reuse_active", F.col("active_job_id")))
        .drop("_first")
    )


def gated_submissions(
    requests: DataFrame, jobs: DataFrame, usage: DataFrame, as_of: str, max_jobs: int = rules.MAX_ACTIVE_JOBS, max_crawls: int = rules.MAX_MONTHLY_CRAWLS
) -> DataFrame:
    """`submissions` of requests that name an organization_id, held against its limits in the order they come.

    A request is refused, whatever it would do, once its tenant has `max_jobs` active jobs, those that earlier requests
    of the batch created included, or `max_crawls` crawls in the 30 days before `as_of`. Refused requests have the
    action "rejected" and a reason. Requests of no tenant have no limits.
    """
    org, when = "organization_id", F.struct("requested_at", "request_id")
    planned = submissions(requests, jobs)
    running = active_jobs(jobs).groupBy(org).agg(F.count(F.lit(1)).alias("_running"))
    crawls = recent_usage(usage, as_of).groupBy(org).agg(F.sum("crawls").alias("_crawls"))
    # The first max_jobs creations of a tenant decide when it is full; no tenant is ordered further than that.
    opening = first_per_key(planned.filter("action = 'create' AND organization_id IS NOT NULL"), [org], [F.asc("requested_at"), F.asc("request_id")], max_jobs)
    opening = opening.groupBy(org).agg(F.sort_array(F.collect_list(when)).alias("_opening"))
    rows = planned.join(running, org, "left").join(crawls, org, "left").join(opening, org, "left")
    room = F.lit(max_jobs) - F.coalesce("_running", F.lit(0))
    full = (room <= 0) | F.coalesce(F.get("_opening", room.cast("int") - 1) < when, F.lit(False))
    reason = F.when(full, "active job limit").when(F.coalesce("_crawls", F.lit(0)) >= max_crawls, "monthly crawl quota")
    rows = rows.withColumn("reason", F.when(F.col(org).isNotNull(), reason))
    refused = F.col("reason").isNotNull()
    return (
        rows.withColumn("action", F.when(refused, "rejected").otherwise(F.col("action")))
        .withColumn("active_job_id", F.when(~refused, F.col("active_job_id")))
        .drop("_running", "_crawls", "_opening")
    )


def apply_moves(jobs: DataFrame, moves: DataFrame, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(jobs after the requested moves, refused moves with a reason).

    jobs: job_id, status, started_at, completed_at and more. moves: move_id, job_id, new_status, moved_at. A job takes
    its moves one after another by (moved_at, move_id); a move the job's state then does not allow is refused and
    changes nothing. The first start and the end of a job are stamped. No state is entered twice and all states after
    RUNNING are final, so a job takes two moves at most: the first that leaves its stored state and the first after it
    that leaves the new one. Both are aggregates, the second over `salts` slices of a job; equal moves travel as one row.
    """
    states = sorted({a for a, _ in rules.JOB_MOVES})
    move, first = F.col("_move"), F.col("_first")
    asked = moves.select("job_id", F.struct("moved_at", "move_id", F.upper("new_status").alias("to")).alias("_move")).groupBy("job_id", "_move").agg(F.count(F.lit(1)).alias("_n"))
    leaving = [F.min(F.when(is_allowed_move(F.lit(s), move["to"]), move)).alias(f"_from_{s}") for s in states]
    firsts = asked.filter(F.col("job_id").isNotNull()).groupBy("job_id").agg(*leaving)
    rows = jobs.join(firsts, "job_id", "left").withColumn("_first", F.coalesce(*[F.when(F.col("status") == s, F.col(f"_from_{s}")) for s in states]))
    moved_on = first["to"].isin(states)
    opened = rows.filter(moved_on).select("job_id", "_first").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    later = asked.withColumn("_salt", F.pmod(F.xxhash64("_move"), F.lit(salts).cast("bigint"))).join(opened, ["job_id", "_salt"])
    seconds = later.filter((move > first) & is_allowed_move(first["to"], move["to"])).groupBy("job_id").agg(F.min("_move").alias("_then"))
    rows = rows.join(seconds, "job_id", "left").withColumn("_second", F.when(moved_on, F.col("_then")))

    taken = [first, F.col("_second")]
    start, end = (F.coalesce(*[F.when(t["to"].isin(kinds), t["moved_at"]) for t in taken]) for kinds in (["RUNNING"], rules.FINAL_STATES))
    ended = reduce(or_, [F.coalesce(t["to"].isin(rules.FINAL_STATES), F.lit(False)) for t in taken])
    stamped = {
        "status": F.coalesce(*[t["to"] for t in reversed(taken)], "status"),
        "started_at": F.coalesce("started_at", start),
        "completed_at": F.when(ended, end).otherwise(F.col("completed_at")),
    }
    after = rows.select(*[stamped[c].alias(c) if c in stamped else F.col(c) for c in jobs.columns])

    fate = rows.select("job_id", "_first", "_second", F.lit(True).alias("_known"))
    is_taken = reduce(or_, [F.coalesce(move == t, F.lit(False)) for t in taken])
    barred = asked.join(fate, "job_id", "left").select(
        move["move_id"].cast("bigint").alias("move_id"),
        F.when(F.col("_known"), "move not allowed").otherwise("not found").alias("reason"),
        (F.col("_n") - is_taken.cast("bigint")).alias("_n"),
    )
    return after, _repeated(barred, "_n")


def _repeated(rows: DataFrame, n: str, part: int = 10_000) -> DataFrame:
    """Each row as often as its column `n` says, in arrays of at most `part` items or `n / part`."""
    one = F.lit(1).cast("bigint")
    parts = rows.filter(F.col(n) > 0).withColumn("_part", F.explode(F.sequence(one, F.ceil(F.col(n) / part))))
    left = F.least(F.lit(part).cast("bigint"), F.col(n) - (F.col("_part") - 1) * part)
    return parts.withColumn("_copy", F.explode(F.sequence(one, left))).drop(n, "_part", "_copy")


def event_status(event_type: Column, stated: Column | None = None) -> Column:
    pairs = [F.lit(x) for pair in rules.EVENT_STATUS.items() for x in pair]
    inferred = F.coalesce(F.element_at(F.create_map(*pairs), event_type), F.lit("RUNNING"))
    if stated is None:
        return inferred
    return F.coalesce(F.when(stated != "", stated), inferred)


def normalize_events(events: DataFrame) -> DataFrame:
    """Progress held to 0..100 and a status for every event; works on batch and stream alike."""
    return events.withColumn("progress", F.least(F.greatest("progress", F.lit(0)), F.lit(100))).withColumn(
        "status", event_status(F.col("event_type"), F.get_json_object("data", "$.status"))
    )


def event_tail(events: DataFrame, n: int = 10) -> DataFrame:
    return first_per_key(events, ["job_id"], [F.desc("timestamp"), F.desc("event_id")], n)


def is_allowed_move(before: Column, after: Column) -> Column:
    moves = [F.lit(f"{a}>{b}") for a, b in rules.JOB_MOVES]
    return F.concat_ws(">", before, after).isin(*moves)


def transition_audit(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Every status change of every job, marked allowed or not.

    Repeats of one status are not changes. The previous status of a bucket's
    first event comes from the job's last earlier bucket, so a job with very
    many events is spread over its buckets. A good bucket unit leaves a hot job
    with about as many buckets as events per bucket.
    """
    part = F.date_trunc(bucket, "timestamp")
    seen = lag_within(events, ["job_id"], ["timestamp", "event_id"], part, {"status": "previous_status"})
    changed = F.col("previous_status").isNotNull() & (F.col("previous_status") != F.col("status"))
    return (
        seen.filter(changed)
        .withColumn("allowed", is_allowed_move(F.col("previous_status"), F.col("status")))
        .select("job_id", "event_id", "timestamp", "previous_status", "status", "allowed")
    )


def job_durations(events: DataFrame) -> DataFrame:
    """Start at the first RUNNING event, end at the first final one."""
    at = F.col("timestamp")
    spans = events.groupBy("job_id").agg(
        F.min(F.when(F.col("status") == "RUNNING", at)).alias("started_at"),
        F.min(F.when(F.col("status").isin(rules.FINAL_STATES), at)).alias("completed_at"),
    )
    seconds = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    return spans.withColumn("seconds", F.round(seconds / 1000000.0, 3))


def politeness_gaps(log: DataFrame, min_gap: float = 1.0, bucket: str = "hour") -> DataFrame:
    """Requests that followed the previous one to the same domain sooner than `min_gap` seconds."""
    part = F.date_trunc(bucket, "ts")
    seen = lag_within(log, ["domain"], ["ts", "event_id"], part, {"ts": "previous_ts"})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = (micros("ts") - micros("previous_ts")) / 1000000.0
    return seen.withColumn("gap_seconds", F.round(gap, 6)).filter(F.col("gap_seconds") < min_gap)


def domain_overlap(spans: DataFrame, bucket: str = "day") -> DataFrame:
    """Jobs that start while an earlier job of the same domain still runs.

    `spans` has job_id, domain, started_at and ended_at.
    """
    part = F.date_trunc(bucket, "started_at")
    seen = running_max_before(spans, ["domain"], ["started_at", "job_id"], part, "ended_at", "busy_until")
    return seen.filter(F.col("busy_until") > F.col("started_at"))


def _has_any(text: Column, words: list[str]) -> Column:
    """Plain substring tests: cheaper than one pattern with many branches on long texts."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def retry_plan(
    failures: DataFrame, base: float = 1.0, cap: float = 30.0, jitter: Column | float = 0.0, max_retries: int = 3
) -> DataFrame:
    """Class of each failure and the delay before its next try.

    `failures` has error_type, message and retry_count. `jitter` is a column or
    number of seconds that is added before the cap.
    """
    seen = F.concat_ws("\n", F.lower("error_type"), F.lower("message"))
    klass = (
        F.when(_has_any(seen, rules.PERMANENT_ERRORS), "permanent")
        .when(_has_any(seen, rules.TRANSIENT_ERRORS), "transient")
        .otherwise("other")
    )
    again = (F.col("error_class") == "transient") & (F.col("retry_count") < max_retries)
    delay = backoff_delay(F.col("retry_count"), base, cap, jitter)
    return (
        failures.withColumn("error_class", klass)
        .withColumn("retry", again)
        .withColumn("delay_seconds", F.when(F.col("retry"), delay))
    )


def backoff_delay(retry_count: Column, base: float = 1.0, cap: float = 30.0, jitter: Column | float = 0.0) -> Column:
    extra = jitter if isinstance(jitter, Column) else F.lit(float(jitter))
    return F.least(F.lit(cap), F.round(F.lit(base) * F.pow(F.lit(2.0), retry_count) + extra, 2))
