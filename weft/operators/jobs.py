"""Crawl jobs, queue jobs and job events: lookups, statistics, retention, quotas.

Inputs (see ``weft.sources.tables`` for the derived driver versions):

* jobs    ``id, user_id, created_at, status, max_depth[, start_url]``
* queue   ``job_id, crawl_id, state, priority, event_ts[, progress]``
* events  ``event_id, crawl_id, job_id, state, ts`` (state transitions of queue jobs)

All statistics are hash aggregations with one pass over the input
(``count_if`` per state instead of one scan per state); Spark runs them as
partial + final aggregates, so a crawl holding a third of the rows is
pre-aggregated on every mapper before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Queue states reported by the statistics, and terminal states.
REPORTED_STATES = ["waiting", "active", "completed", "failed"]
CLEARED_STATES = ["waiting", "active", "delayed", "failed"]
TERMINAL_STATES = ["completed", "failed"]
OPEN_STATES = ["waiting", "active", "delayed"]
# Defaults of a crawl request.
DEFAULT_MAX_DEPTH = 3
DEFAULT_EXCLUDED_PATHS = ["/admin", "/private", "/wp-admin", "/login", "/logout"]


def _cnt(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


# ---- S2-S5, S7 -------------------------------------------------------------------------------

def job_by_id(jobs: DataFrame, job_id, check: bool = True) -> DataFrame:
    """The job row with ``id = job_id``; raises unless exactly one row exists (``check=False``: whatever is there)."""
    out = jobs.filter(F.col("id") == F.lit(job_id))
    if check:
        n = out.limit(2).count()
        if n != 1:
            raise LookupError(f"crawl job {job_id!r}: expected one row, found {n if n < 2 else 'several'}")
    return out


def queue_snapshot(queue: DataFrame, states=tuple(REPORTED_STATES)) -> DataFrame:
    """S3: queue jobs in ``states`` as ``job_id, crawl_id, state, progress`` (progress default 0)."""
    prog = F.coalesce(F.col("progress"), F.lit(0)) if "progress" in queue.columns else F.lit(0)
    return queue.filter(F.col("state").isin(*states)).select("job_id", "crawl_id", "state",
                                                              prog.cast("int").alias("progress"))


def queue_by_crawl(queue: DataFrame, crawl_id, states=tuple(REPORTED_STATES)) -> DataFrame:
    """``queue_snapshot`` of one crawl."""
    return queue_snapshot(queue.filter(F.col("crawl_id") == F.lit(crawl_id)), states)


def crawl_requests(requests: DataFrame):
    """Validate crawl requests.

    Returns ``(accepted, rejected)``. accepted: ``start_url, max_depth (default 3),
    status 'pending', user_id, allowed_domains`` (given list normalised, else the
    start URL's effective domain). rejected: ``start_url, error`` ('Invalid start URL').
    The job id is not assigned here: call ``with_job_ids`` at ingestion.
    """
    from weft.functions.urls import effective_domain, with_url_parts

    df = with_url_parts(requests, "url", None, prefix="_q")
    df = df.withColumn("_valid", F.col("_q.ok") & (F.coalesce(F.col("_q.scheme"), F.lit("")) != ""))
    ok = F.col("url").isNotNull() & (F.col("url") != "") & F.col("_valid")
    allowed = (F.transform(F.col("allowed_domains"), effective_domain) if "allowed_domains" in requests.columns
               else F.lit(None).cast("array<string>"))
    host_rule = F.array(effective_domain(F.col("_q.host")))
    accepted = df.filter(ok).select(
        F.col("url").alias("start_url"),
        F.coalesce(F.col("max_depth"), F.lit(DEFAULT_MAX_DEPTH)).alias("max_depth"),
        F.lit("pending").alias("status"), "user_id",
        F.coalesce(allowed, host_rule).alias("allowed_domains"),
    )
    rejected = df.filter(~F.coalesce(ok, F.lit(False))).select(
        F.col("url").alias("start_url"), F.lit("Invalid start URL").alias("error"))
    return accepted, rejected


def with_job_ids(accepted: DataFrame) -> DataFrame:
    """Assign new job ids (``uuid()``); do this once at ingestion and store the result."""
    return accepted.withColumn("id", F.expr("uuid()"))


def update_jobs(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changes ``(id, ts, status and any other job fields)``.

    Only fields that a change gives (non-NULL) are set; of several changes the
    latest that gives a field wins, ties going to the larger value. A field that
    ``jobs`` lacks becomes a new column, NULL elsewhere. Changes are reduced to
    one row per id before the join (partial aggregation). ``processing_stats``, JSON
    text of any fields, becomes a VARIANT.
    """
    fields = [c for c in changes.columns if c not in ("id", "ts")]
    latest = changes.groupBy("id").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c).alias("v"))))["v"].alias(f"_new_{c}") for c in fields])
    j = jobs.join(latest, "id", "left")
    kept = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in jobs.columns]
    out = j.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in fields if c not in jobs.columns])
    stats = dict(out.dtypes).get("processing_stats")
    return out.withColumn("processing_stats", F.try_parse_json("processing_stats")) if stats == "string" else out


# ---- J4-J6, J8 -------------------------------------------------------------------------------

def latest_job_state(events: DataFrame) -> DataFrame:
    """Reduce job events to the latest state per (crawl, job): ``crawl_id, job_id, state, added_at, last_ts``."""
    return events.groupBy("crawl_id", "job_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"),
        F.min("ts").alias("added_at"),
        F.max("ts").alias("last_ts"),
    )


def active_jobs(events: DataFrame) -> DataFrame:
    """Jobs whose latest state is still open (added, not yet removed): ``crawl_id, job_id, added_at``.

    Where events carry ``metadata`` (JSON text, of any fields), the job's last one is given as a VARIANT; its field ``addedAt``,
    if any, stands for the time. Text that is no JSON counts as none.
    """
    if "metadata" not in events.columns:
        return latest_job_state(events).filter(F.col("state").isin(*OPEN_STATES)).select("crawl_id", "job_id", "added_at")
    when = F.struct("ts", "event_id")
    g = events.groupBy("crawl_id", "job_id").agg(F.max_by("state", when).alias("state"), F.min("ts").alias("added_at"),
                                                 F.max_by("metadata", F.when(F.col("metadata").isNotNull(), when)).alias("metadata"))
    g = g.filter(F.col("state").isin(*OPEN_STATES)).withColumn("metadata", F.try_parse_json("metadata"))
    own = F.try_variant_get("metadata", "$.addedAt", "timestamp")
    return g.select("crawl_id", "job_id", F.coalesce(own, F.col("added_at")).alias("added_at"), "metadata")


def active_job_counts(events: DataFrame) -> DataFrame:
    """J4 count: ``crawl_id, active`` for every crawl seen (0 when none is open)."""
    return latest_job_state(events).groupBy("crawl_id").agg(_cnt(F.col("state").isin(*OPEN_STATES)).alias("active"))


def queue_counts(queue: DataFrame) -> DataFrame:
    """Per crawl: total, waiting, active, completed, failed, is_complete."""
    st = F.col("state")
    return queue.groupBy("crawl_id").agg(
        F.count("*").cast("bigint").alias("total"),
        _cnt(st == "waiting").alias("waiting"), _cnt(st == "active").alias("active"),
        _cnt(st == "completed").alias("completed"), _cnt(st == "failed").alias("failed"),
        F.bool_and(st.isin(*TERMINAL_STATES)).alias("is_complete"),
    )


def recent_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest jobs (created_at descending, id as tie-break)."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(n)


def crawl_stats(jobs: DataFrame, queue: DataFrame, n: int = 10) -> DataFrame:
    """Statistics of the ``n`` newest crawls.

    No queue rows: total 1, pending 1, status 'pending', not complete. Otherwise
    counts by state, pending 0, status from the job row. The ``n`` newest jobs
    (a bounded set) are broadcast to filter the queue before it is aggregated.
    """
    top = recent_jobs(jobs, n).select("id", "status", "created_at")
    q = queue.join(F.broadcast(top.select(F.col("id").alias("crawl_id"))), "crawl_id", "left_semi")
    return crawl_stats_of(top, queue_counts(q))


def crawl_stats_of(top: DataFrame, counts: DataFrame) -> DataFrame:
    """J5 of the crawls ``top`` (``id, status``) from counts by crawl (``queue_counts``)."""
    j = top.join(counts.select("crawl_id", "total", "waiting", "active", "completed", "failed", "is_complete"), top["id"] == counts["crawl_id"], "left")
    none = F.col("crawl_id").isNull()
    z = F.lit(0).cast("bigint")
    return j.select(
        F.col("id").alias("crawl_id"),
        F.when(none, F.lit(1).cast("bigint")).otherwise(F.col("total")).alias("total"),
        F.when(none, z).otherwise(F.col("waiting")).alias("waiting"),
        F.when(none, z).otherwise(F.col("active")).alias("active"),
        F.when(none, z).otherwise(F.col("completed")).alias("completed"),
        F.when(none, z).otherwise(F.col("failed")).alias("failed"),
        F.when(none, F.lit(1).cast("bigint")).otherwise(z).alias("pending"),
        F.when(none, F.lit(False)).otherwise(F.col("is_complete")).alias("is_complete"),
        F.when(none, F.lit("pending")).otherwise(F.col("status")).alias("status"),
    )


def job_status(jobs: DataFrame, queue: DataFrame, job_id) -> DataFrame:
    """One row for a crawl: its job fields, its queue counts and the global queue counts.

    One pass over the queue computes both the crawl's and the global counts;
    the job's fields come in as scalar subqueries.
    """
    st = F.col("state")
    mine = F.col("crawl_id") == F.lit(job_id)
    job = jobs.filter(F.col("id") == F.lit(job_id))
    return queue.agg(
        _cnt(mine).alias("crawl_jobs"),
        _cnt(mine & (st == "waiting")).alias("crawl_waiting"), _cnt(mine & (st == "active")).alias("crawl_active"),
        _cnt(mine & (st == "completed")).alias("crawl_completed"), _cnt(mine & (st == "failed")).alias("crawl_failed"),
        _cnt(st == "waiting").alias("waiting_count"), _cnt(st == "active").alias("active_count"),
        _cnt(st == "completed").alias("completed_count"), _cnt(st == "failed").alias("failed_count"),
    ).select(
        F.lit(job_id).alias("id"),
        job.select("status").scalar().alias("status"),
        job.select("created_at").scalar().alias("created_at"),
        "*",
    )


def user_of_crawl(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Attach the crawl's user to each page row (equi-join on crawl id)."""
    return pages.join(jobs.select(F.col("id").alias("crawl_id"), "user_id"), "crawl_id", "inner")


# ---- T2, T3 --------------------------------------------------------------------------------

def next_pending(jobs: DataFrame, queue: DataFrame) -> DataFrame:
    """The oldest pending job, only when no queue job is active (id as tie-break)."""
    busy = queue.filter(F.col("state") == "active").exists()
    return (jobs.filter((F.col("status") == "pending") & ~busy)
            .orderBy(F.col("created_at").asc(), F.col("id").asc()).limit(1))


def retain(queue: DataFrame, now: Column | None = None, keep: int = 1000,
           completed_age: str = "24 hours", failed_age: str = "7 days") -> DataFrame:
    """Finished jobs kept by the queue: completed within 24 h and the newest 1000,
    failed within 7 days and the newest 1000. ``now`` defaults to the newest event time.

    One sort with a limit for each state: whatever ``keep`` is, a mapper ships its
    newest rows only and no state is sorted in one window.
    """
    now = now if now is not None else queue.select(F.max("event_ts")).scalar()

    def newest(state, age):
        fresh = queue.filter((F.col("state") == state) & (F.col("event_ts") >= now - F.expr(f"INTERVAL {age}")))
        return fresh.orderBy(F.col("event_ts").desc(), F.col("job_id").asc()).limit(keep)

    return newest("completed", completed_age).unionByName(newest("failed", failed_age))


# ---- A1-A6, A9-A11 -------------------------------------------------------------------------

def queue_stats(queue: DataFrame) -> DataFrame:
    """A1: one row of waiting, active, completed, failed counts."""
    st = F.col("state")
    return queue.agg(_cnt(st == "waiting").alias("waiting_count"), _cnt(st == "active").alias("active_count"),
                     _cnt(st == "completed").alias("completed_count"), _cnt(st == "failed").alias("failed_count"))


def queue_status(queue: DataFrame) -> DataFrame:
    """A2: per crawl the four counts and the total of reported states."""
    st = F.col("state")
    q = queue.filter(st.isin(*REPORTED_STATES))
    return q.groupBy("crawl_id").agg(
        _cnt(st == "waiting").alias("waiting"), _cnt(st == "active").alias("active"),
        _cnt(st == "completed").alias("completed"), _cnt(st == "failed").alias("failed"),
        F.count("*").cast("bigint").alias("total"))


def queue_job_list(queue: DataFrame, crawl_id=None) -> DataFrame:
    """A2/J6 job lists: ``crawl_id, job_id, state`` and, where the queue has them, ``url, depth, max_depth``."""
    q = queue.filter(F.col("state").isin(*REPORTED_STATES))
    if crawl_id is not None:
        q = q.filter(F.col("crawl_id") == F.lit(crawl_id))
    return q.select("crawl_id", "job_id", "state", *[c for c in ("url", "depth", "max_depth") if c in queue.columns])


def clear_summary(queue: DataFrame) -> DataFrame:
    """A3: one row: crawls affected (grouped over waiting/active/completed/failed) and
    jobs cleared (waiting/active/delayed/failed). Two filtered aggregates, one pass.
    The affected crawl ids are the rows of ``clear_updates``."""
    st = F.col("state")
    return queue.agg(
        F.count_distinct(F.when(st.isin(*REPORTED_STATES), F.col("crawl_id"))).cast("bigint").alias("total_crawls_affected"),
        _cnt(st.isin(*CLEARED_STATES)).alias("total_jobs_cleared"))


def clear_updates(queue: DataFrame) -> DataFrame:
    """A3: job-table changes of a clear: ``id, status 'stopped', cleared_job_count``."""
    q = queue.filter(F.col("state").isin(*REPORTED_STATES))
    return q.groupBy(F.col("crawl_id").alias("id")).agg(F.count("*").cast("bigint").alias("cleared_job_count")) \
        .select("id", F.lit("stopped").alias("status"), "cleared_job_count")


def reset_updates(queue: DataFrame, at: Column) -> DataFrame:
    """A4: job-table changes of a reset at time ``at`` (input of ``update_jobs``):
    ``id, ts, status 'stopped', stop_requested_at, reset_at, cleared_job_count``."""
    return clear_updates(queue).select("id", at.alias("ts"), "status", at.alias("stop_requested_at"), at.alias("reset_at"), "cleared_job_count")


def reset_summary(queue: DataFrame) -> DataFrame:
    """A4: jobs by state plus the total row (state NULL), with the crawls affected, via ``rollup``."""
    q = queue.filter(F.col("state").isin(*REPORTED_STATES))
    return q.rollup("state").agg(F.count("*").cast("bigint").alias("jobs"),
                                 F.count_distinct("crawl_id").cast("bigint").alias("crawls_affected"))


def stop_summary(queue: DataFrame, crawl_id=None) -> DataFrame:
    """A5: per crawl (or one crawl): active+waiting jobs, of these the jobs stopped, response status 'stopped'.

    A queue column ``removable`` (False: the queue could not remove the job) takes jobs out of ``jobs_stopped``.
    """
    q = queue if crawl_id is None else queue.filter(F.col("crawl_id") == F.lit(crawl_id))
    mine = F.col("state").isin("active", "waiting")
    gone = mine & F.coalesce(F.col("removable"), F.lit(True)) if "removable" in queue.columns else mine
    return q.groupBy("crawl_id").agg(_cnt(mine).alias("total_jobs"), _cnt(gone).alias("jobs_stopped")) \
        .select("crawl_id", "total_jobs", "jobs_stopped", F.lit("stopped").alias("status"))


def stop_updates(queue: DataFrame, at: Column, crawl_id=None) -> DataFrame:
    """A5: job-table changes of a stop at time ``at``, in order: 'stopping', then 'crawled'
    (``id, ts, step, status, completed_at``; ``step`` orders changes with equal times)."""
    ids = stop_summary(queue, crawl_id).select(F.col("crawl_id").alias("id"))
    return ids.select("id", at.alias("ts"), F.posexplode(F.array(F.lit("stopping"), F.lit("crawled"))).alias("step", "status"), at.alias("completed_at"))


def shutdown_summary(queue: DataFrame) -> DataFrame:
    """Per crawl the number of waiting/active/delayed/failed jobs that a shutdown stops."""
    q = queue.filter(F.col("state").isin(*CLEARED_STATES))
    return q.groupBy("crawl_id").agg(F.count("*").cast("bigint").alias("jobs")).select(
        "crawl_id", "jobs", F.lit("stopped").alias("status"))


def outcomes(events: DataFrame) -> DataFrame:
    """Job outcomes from events: latest state per job with ``inserted``, ``failed``, ``error_code``.

    A job that ended completed inserted its page; failed jobs carry the error code
    of their last event (``error_code`` column of the events, else ``CrawlError``).
    """
    given = F.col("error_code") if "error_code" in events.columns else F.lit(None).cast("string")
    s = events.groupBy("crawl_id", "job_id").agg(F.max_by(F.struct("state", given.alias("code"), F.col("ts").alias("last_ts")), F.struct("ts", "event_id")).alias("l"))
    failed = F.col("l.state") == "failed"
    return s.select("crawl_id", "job_id", "l.state", "l.last_ts", (F.col("l.state") == "completed").alias("inserted"), failed.alias("failed"),
                    F.when(failed, F.coalesce("l.code", F.lit("CrawlError"))).alias("error_code"))


def progress(outc: DataFrame) -> DataFrame:
    """Per crawl: pages (+1 per inserted page), errors (+1 per failed job, quota errors excluded)."""
    return outc.groupBy("crawl_id").agg(
        _cnt(F.col("inserted")).alias("pages_crawled"),
        _cnt(F.col("failed") & (F.coalesce(F.col("error_code"), F.lit("")) != "QuotaExceededError")).alias("errors"))


def final_status(events: DataFrame) -> DataFrame:
    """A10: crawls whose open jobs reached 0: status of the last job to end
    (completed -> 'crawled', failed -> 'failed') and completed_at = its time."""
    s = latest_job_state(events)
    st = F.col("state")
    ended = st.isin(*TERMINAL_STATES)
    g = s.groupBy("crawl_id").agg(
        _cnt(st.isin(*OPEN_STATES)).alias("open_jobs"),
        F.max_by(F.when(ended, st), F.when(ended, F.struct("last_ts", "job_id"))).alias("last_state"),
        F.max(F.when(ended, F.col("last_ts"))).alias("completed_at"))
    return g.filter((F.col("open_jobs") == 0) & F.col("last_state").isNotNull()).select(
        "crawl_id", F.when(F.col("last_state") == "completed", "crawled").otherwise("failed").alias("status"),
        "completed_at")


def queue_health(queue: DataFrame) -> DataFrame:
    """The four counts and 'degraded' if any job failed, else 'healthy'."""
    s = queue_stats(queue)
    return s.withColumn("status", F.when(F.col("failed_count") > 0, "degraded").otherwise("healthy"))


# ---- W3 ---------------------------------------------------------------------------------------

def within_quota(page_events: DataFrame, quotas: DataFrame, salt_buckets: int = 16, used: DataFrame | None = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Monthly page quota per user.

    Rows: ``user_id, url, ts, month, n (running count, only within quota),
    within_quota, remaining``, one for each input row. Pages are counted per (user,
    month) in (ts, url) order, repeated rows one by one; a user without a quota row
    has none left. A hot user is split into ``salt_buckets`` buckets: only the first
    ``quota`` rows of each bucket can be among the user's first ``quota`` rows, so
    only those candidates are ranked; all others are over the quota as they are.
    ``used`` (``user_id, month, used``): pages charged to the month before; ``keep``: further columns.
    """
    q = quotas.select("user_id", F.col("monthly_quota").alias("quota"))
    pe = page_events.withColumn("month", F.date_trunc("month", "ts")).join(q, "user_id", "left")
    pe = pe.withColumn("quota", F.coalesce("quota", F.lit(0)))
    if used is not None:
        pe = pe.join(used.select("user_id", "month", "used"), ["user_id", "month"], "left").withColumn("quota", F.greatest(F.col("quota") - F.coalesce("used", F.lit(0)), F.lit(0)))
    pe = pe.withColumn("_salt", F.pmod(F.xxhash64("url", "ts"), F.lit(salt_buckets)))
    order = [F.col("ts").asc(), F.col("url").asc()]
    w_local = Window.partitionBy("user_id", "month", "_salt").orderBy(*order)
    local = pe.withColumn("_ln", F.row_number().over(w_local))
    w_user = Window.partitionBy("user_id", "month").orderBy(*order)
    ranked = local.filter(F.col("_ln") <= F.col("quota")).withColumn("n", F.row_number().over(w_user))
    both = ranked.withColumn("n", F.when(F.col("n") <= F.col("quota"), F.col("n"))).unionByName(
        local.filter(F.col("_ln") > F.col("quota")).withColumn("n", F.lit(None).cast("int")))
    return both.select("user_id", "url", "ts", *keep, "month", F.col("n").cast("bigint").alias("n"),
                       F.col("n").isNotNull().alias("within_quota"),
                       F.when(F.col("n").isNotNull(), F.col("quota") - F.col("n")).otherwise(F.lit(0)).cast("bigint")
                       .alias("remaining"))
