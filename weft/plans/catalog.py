"""Registered queries: one per operator of the inventory, each over the driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the operator can be
written in SQL, ``ORACLE[name]`` (DuckDB) with the same column names. Results
are flat scalar columns (counts as BIGINT) so the two can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.session import checkpoint_dir, written
from weft.operators import frontier as FR
from weft.operators import html as H
from weft.operators import jobs as J
from weft.operators import links as L
from weft.operators import pages as PG
from weft.operators import robots as RB
from weft.operators import rules as RU
from weft.operators import urls as U
from weft.plans.oracle import (FX, BLOCK_CLOSE, BLOCK_OPEN, TOKENS, _decode, _enc_path, canon_cte, clean, element_text_cte, href_expr,
                               raw_state_tokens, wq)
from weft.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _pages(spark, sf):
    """S1 at the head of every query on pages."""
    return T.read_pages(spark, T.read_table(spark, sf, "pages"))


# ======================= sources =================================================================

@query("read_pages_json", wq(["fx_responses"], [],
                             "SELECT page_id, url, status, md5(html) AS html_md5 FROM fx_responses WHERE status = 200 AND strlen(html) <= 10485760"))
def q_read_pages_json(spark, sf):
    """S1 from JSON lines: the responses written as such (with a line that is no JSON), and read again."""
    path = f"{checkpoint_dir(spark)}/weft-lines/{uuid.uuid4().hex}"
    lines = T.responses(spark, sf).select(F.to_json(F.struct("page_id", "url", "status", "html")).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit("{broken").alias("value"))).write.text(path)
    return T.read_pages(spark, path, "json").select("page_id", "url", "status", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("read_pages", wq(["fx_responses"], [],
                        "SELECT page_id, url, status FROM fx_responses WHERE status = 200 AND strlen(html) <= 10485760"))
def q_read_pages(spark, sf):
    return T.read_pages(spark, T.responses(spark, sf)).select("page_id", "url", "status")


@query("queue_snapshot", wq(["fx_queue"], [], "SELECT job_id, crawl_id, state, 0 AS progress FROM fx_queue "
                                               "WHERE state IN ('waiting','active','completed','failed')"))
def q_queue_snapshot(spark, sf):
    return J.queue_snapshot(T.queue_jobs(spark, sf))


@query("queue_by_crawl", wq(["fx_queue"], [], "SELECT job_id, crawl_id, state, 0 AS progress FROM fx_queue "
                                               "WHERE state IN ('waiting','active','completed','failed') "
                                               "AND crawl_id = (SELECT min(crawl_id) FROM fx_queue)"))
def q_queue_by_crawl(spark, sf):
    q = T.queue_jobs(spark, sf)
    return J.queue_by_crawl(q, q.select(F.min("crawl_id")).scalar())


@query("job_by_id", wq(["fx_crawl_jobs"], [], "SELECT * FROM fx_crawl_jobs WHERE id = (SELECT max(id) FROM fx_crawl_jobs)"))
def q_job_by_id(spark, sf):
    j = T.crawl_jobs(spark, sf)
    return J.job_by_id(j, j.agg(F.max("id")).first()[0])


_VALID_SQL = ("(regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT (regexp_matches(lower(url), '^(https?|wss?|ftp):') "
              "AND NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\\\]*[^/\\\\?#:@ ]+')))")


@query("crawl_requests", wq(["fx_requests"], [], f"""
    SELECT url AS start_url, coalesce(max_depth, 3) AS max_depth, 'pending' AS status, user_id,
        regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS allowed_domains
    FROM fx_requests WHERE url IS NOT NULL AND url <> '' AND {_VALID_SQL}"""))
def q_crawl_requests(spark, sf):
    acc, _ = J.crawl_requests(T.crawl_requests_input(spark, sf))
    return acc.withColumn("allowed_domains", F.array_join("allowed_domains", ","))


@query("crawl_requests_rejected", wq(["fx_requests"], [], f"""
    SELECT url AS start_url, 'Invalid start URL' AS error FROM fx_requests
    WHERE url IS NULL OR url = '' OR NOT {_VALID_SQL}"""))
def q_crawl_requests_rejected(spark, sf):
    return J.crawl_requests(T.crawl_requests_input(spark, sf))[1]


@query("update_jobs", wq(["fx_crawl_jobs", "fx_job_events", "fx_latest", "fx_final"], [], """
    SELECT j.id, j.user_id, j.created_at, CASE WHEN f.crawl_id IS NULL THEN j.status WHEN j.id % 2 = 0 THEN 'stopped' ELSE f.status END AS status,
        j.max_depth, f.completed_at
    FROM fx_crawl_jobs j LEFT JOIN fx_final f ON f.crawl_id = j.id"""))
def q_update_jobs(spark, sf):
    """Each finished crawl's status and end; a later change of every second one gives only another status."""
    fin = J.final_status(T.job_events(spark, sf)).select(F.col("crawl_id").alias("id"), "status", "completed_at", F.col("completed_at").alias("ts"))
    later = fin.filter(F.col("id") % 2 == 0).select("id", F.lit("stopped").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"),
                                                    (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return J.update_jobs(T.crawl_jobs(spark, sf), fin.unionByName(later))


@query("job_processing_stats", wq(["fx_crawl_jobs", "fx_queue"], ["""c AS (SELECT crawl_id, count(*) AS n FROM fx_queue WHERE state IN ('waiting','active','delayed','failed') GROUP BY crawl_id)"""], """
    SELECT j.id, CASE WHEN c.n IS NULL THEN j.status ELSE 'stopped' END AS status, c.n AS cleared, CASE WHEN c.n IS NOT NULL THEN TIMESTAMP '2024-05-06 07:08:09' END AS cleared_at
    FROM fx_crawl_jobs j LEFT JOIN c ON c.crawl_id = j.id"""))
def q_job_processing_stats(spark, sf):
    """S7 with the processing statistics of a clear (A3), read back from the job rows."""
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    q = T.queue_jobs(spark, sf).filter(F.col("state").isin(*J.CLEARED_STATES)).groupBy("crawl_id").agg(F.count("*").alias("n"))
    changes = q.select(F.col("crawl_id").alias("id"), at.alias("ts"), F.lit("stopped").alias("status"),
                       F.to_json(F.struct(F.lit("2024-05-06 07:08:09").alias("cleared_at"), F.col("n").alias("cleared_job_count"))).alias("processing_stats"))
    done = J.update_jobs(T.crawl_jobs(spark, sf), changes)
    return done.select("id", "status", F.try_variant_get("processing_stats", "$.cleared_job_count", "bigint").alias("cleared"),
                       F.try_variant_get("processing_stats", "$.cleared_at", "timestamp").alias("cleared_at"))


# ======================= jobs, queue, events =====================================================

@query("active_jobs", wq(["fx_job_events", "fx_latest"], [],
                         "SELECT crawl_id, job_id, added_at FROM fx_latest WHERE state IN ('waiting','active','delayed')"))
def q_active_jobs(spark, sf):
    return J.active_jobs(T.job_events(spark, sf))


@query("active_job_metadata", wq(["fx_job_events"], ["""m AS (SELECT crawl_id, job_id, arg_max(state, (ts, event_id)) AS state, min(ts) AS first_ts, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS e
        FROM fx_job_events GROUP BY crawl_id, job_id)"""], """
    SELECT crawl_id, job_id, CASE WHEN e % 5 = 0 THEN TIMESTAMP '2020-01-02 03:04:05' ELSE first_ts END AS added_at, CAST(e % 7 AS INTEGER) AS priority,
        CASE WHEN e % 2 = 0 THEN job_id END AS url, e IS NOT NULL AS has_metadata FROM m WHERE state IN ('waiting','active','delayed')"""))
def q_active_job_metadata(spark, sf):
    """J4 with metadata of changing shape on two events of three, read back field by field."""
    e = F.col("event_id")
    fields = F.to_json(F.struct((e % 7).alias("priority"), F.when(e % 2 == 0, F.col("job_id")).alias("url"), F.when(e % 5 == 0, F.lit("2020-01-02 03:04:05")).alias("addedAt")))
    a = J.active_jobs(T.job_events(spark, sf).withColumn("metadata", F.when(e % 3 != 0, fields)))
    return a.select("crawl_id", "job_id", "added_at", F.try_variant_get("metadata", "$.priority", "int").alias("priority"),
                    F.try_variant_get("metadata", "$.url", "string").alias("url"), F.col("metadata").isNotNull().alias("has_metadata"))


@query("active_job_counts", wq(["fx_job_events", "fx_latest"], [], """
    SELECT crawl_id, count(*) FILTER (WHERE state IN ('waiting','active','delayed')) AS active
    FROM fx_latest GROUP BY crawl_id"""))
def q_active_job_counts(spark, sf):
    return J.active_job_counts(T.job_events(spark, sf))


@query("crawl_stats", wq(["fx_crawl_jobs", "fx_queue"], [
    "top AS (SELECT id, status, created_at FROM fx_crawl_jobs ORDER BY created_at DESC, id ASC LIMIT 200)",
    """qc AS (SELECT crawl_id, count(*) AS total, count(*) FILTER (WHERE state = 'waiting') AS waiting,
        count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'completed') AS completed,
        count(*) FILTER (WHERE state = 'failed') AS failed, bool_and(state IN ('completed','failed')) AS is_complete
        FROM fx_queue WHERE crawl_id IN (SELECT id FROM top) GROUP BY crawl_id)"""], """
    SELECT t.id AS crawl_id, coalesce(q.total, 1) AS total, coalesce(q.waiting, 0) AS waiting,
        coalesce(q.active, 0) AS active, coalesce(q.completed, 0) AS completed, coalesce(q.failed, 0) AS failed,
        CASE WHEN q.crawl_id IS NULL THEN 1 ELSE 0 END AS pending, coalesce(q.is_complete, false) AS is_complete,
        CASE WHEN q.crawl_id IS NULL THEN 'pending' ELSE t.status END AS status
    FROM top t LEFT JOIN qc q ON q.crawl_id = t.id"""))
def q_crawl_stats(spark, sf):
    return J.crawl_stats(T.crawl_jobs(spark, sf), T.queue_jobs(spark, sf), n=200)


@query("job_status", wq(["fx_crawl_jobs", "fx_queue"], ["jid AS (SELECT min(id) AS id FROM fx_crawl_jobs)"], """
    SELECT (SELECT id FROM jid) AS id,
        (SELECT status FROM fx_crawl_jobs WHERE id = (SELECT id FROM jid)) AS status,
        (SELECT created_at FROM fx_crawl_jobs WHERE id = (SELECT id FROM jid)) AS created_at,
        count(*) FILTER (WHERE crawl_id = (SELECT id FROM jid)) AS crawl_jobs,
        count(*) FILTER (WHERE crawl_id = (SELECT id FROM jid) AND state = 'waiting') AS crawl_waiting,
        count(*) FILTER (WHERE crawl_id = (SELECT id FROM jid) AND state = 'active') AS crawl_active,
        count(*) FILTER (WHERE crawl_id = (SELECT id FROM jid) AND state = 'completed') AS crawl_completed,
        count(*) FILTER (WHERE crawl_id = (SELECT id FROM jid) AND state = 'failed') AS crawl_failed,
        count(*) FILTER (WHERE state = 'waiting') AS waiting_count, count(*) FILTER (WHERE state = 'active') AS active_count,
        count(*) FILTER (WHERE state = 'completed') AS completed_count, count(*) FILTER (WHERE state = 'failed') AS failed_count
    FROM fx_queue"""))
def q_job_status(spark, sf):
    jobs = T.crawl_jobs(spark, sf)
    jid = jobs.select(F.min("id")).first()[0]
    return J.job_status(jobs, T.queue_jobs(spark, sf), jid)


@query("user_of_crawl", wq(["fx_crawl_jobs", "fx_queue"], [], """
    SELECT q.job_id, q.crawl_id, j.user_id FROM fx_queue q JOIN fx_crawl_jobs j ON j.id = q.crawl_id"""))
def q_user_of_crawl(spark, sf):
    return J.user_of_crawl(T.queue_jobs(spark, sf).select("job_id", "crawl_id"), T.crawl_jobs(spark, sf))


@query("recent_jobs", wq(["fx_crawl_jobs"], [], "SELECT * FROM fx_crawl_jobs ORDER BY created_at DESC, id ASC LIMIT 10"))
def q_recent_jobs(spark, sf):
    return J.recent_jobs(T.crawl_jobs(spark, sf), 10)


@query("next_pending", wq(["fx_crawl_jobs", "fx_queue"], [], """
    SELECT * FROM fx_crawl_jobs WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM fx_queue WHERE state = 'active')
    ORDER BY created_at ASC, id ASC LIMIT 1"""))
def q_next_pending(spark, sf):
    return J.next_pending(T.crawl_jobs(spark, sf), T.queue_jobs(spark, sf))


@query("next_pending_idle", wq(["fx_crawl_jobs", "fx_queue"], ["idle AS (SELECT * FROM fx_queue WHERE state <> 'active')"], """
    SELECT * FROM fx_crawl_jobs WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM idle WHERE state = 'active')
    ORDER BY created_at ASC, id ASC LIMIT 1"""))
def q_next_pending_idle(spark, sf):
    """T2 on the queue once its active jobs are done, so the guard lets a job through."""
    return J.next_pending(T.crawl_jobs(spark, sf), T.queue_jobs(spark, sf).filter(F.col("state") != "active"))


@query("retain_all_ages", wq(["fx_queue"], [], """
    SELECT job_id, crawl_id, state, priority, event_ts FROM (
        SELECT *, row_number() OVER (PARTITION BY state ORDER BY event_ts DESC, job_id ASC) AS rn FROM fx_queue
        WHERE state IN ('completed', 'failed')) WHERE rn <= 1000"""))
def q_retain_all_ages(spark, sf):
    """T3 without an age limit in effect, so that the newest 1000 of each state are what decides."""
    return J.retain(T.queue_jobs(spark, sf), completed_age="100 years", failed_age="100 years")


@query("queue_job_list", wq(["fx_queue"], [], "SELECT crawl_id, job_id, state FROM fx_queue WHERE state IN ('waiting','active','completed','failed')"))
def q_queue_job_list(spark, sf):
    return J.queue_job_list(T.queue_jobs(spark, sf))


@query("reset_updates", wq(["fx_queue"], [], """
    SELECT crawl_id AS id, (SELECT max(event_ts) FROM fx_queue) AS ts, 'stopped' AS status, (SELECT max(event_ts) FROM fx_queue) AS stop_requested_at,
        (SELECT max(event_ts) FROM fx_queue) AS reset_at, count(*) AS cleared_job_count
    FROM fx_queue WHERE state IN ('waiting','active','completed','failed') GROUP BY crawl_id"""))
def q_reset_updates(spark, sf):
    q = T.queue_jobs(spark, sf)
    return J.reset_updates(q, q.select(F.max("event_ts")).scalar())


@query("stop_updates", wq(["fx_queue"], [], """
    SELECT crawl_id AS id, (SELECT max(event_ts) FROM fx_queue) AS ts, s AS step, CASE s WHEN 0 THEN 'stopping' ELSE 'crawled' END AS status,
        (SELECT max(event_ts) FROM fx_queue) AS completed_at FROM (SELECT DISTINCT crawl_id FROM fx_queue), (VALUES (0), (1)) v(s)"""))
def q_stop_updates(spark, sf):
    q = T.queue_jobs(spark, sf)
    return J.stop_updates(q, q.select(F.max("event_ts")).scalar())


@query("retain", wq(["fx_queue"], ["now AS (SELECT max(event_ts) AS t FROM fx_queue)"], """
    SELECT job_id, crawl_id, state, priority, event_ts FROM (
        SELECT *, row_number() OVER (PARTITION BY state ORDER BY event_ts DESC, job_id ASC) AS rn FROM fx_queue
        WHERE (state = 'completed' AND event_ts >= (SELECT t FROM now) - INTERVAL 24 HOURS)
           OR (state = 'failed' AND event_ts >= (SELECT t FROM now) - INTERVAL 7 DAYS)) WHERE rn <= 1000"""))
def q_retain(spark, sf):
    return J.retain(T.queue_jobs(spark, sf))


@query("queue_stats", wq(["fx_queue"], [], """
    SELECT count(*) FILTER (WHERE state = 'waiting') AS waiting_count, count(*) FILTER (WHERE state = 'active') AS active_count,
        count(*) FILTER (WHERE state = 'completed') AS completed_count, count(*) FILTER (WHERE state = 'failed') AS failed_count
    FROM fx_queue"""))
def q_queue_stats(spark, sf):
    return J.queue_stats(T.queue_jobs(spark, sf))


@query("queue_status", wq(["fx_queue"], [], """
    SELECT crawl_id, count(*) FILTER (WHERE state = 'waiting') AS waiting, count(*) FILTER (WHERE state = 'active') AS active,
        count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'failed') AS failed,
        count(*) AS total
    FROM fx_queue WHERE state IN ('waiting','active','completed','failed') GROUP BY crawl_id"""))
def q_queue_status(spark, sf):
    return J.queue_status(T.queue_jobs(spark, sf))


@query("clear_summary", wq(["fx_queue"], [], """
    SELECT count(DISTINCT crawl_id) FILTER (WHERE state IN ('waiting','active','completed','failed')) AS total_crawls_affected,
        count(*) FILTER (WHERE state IN ('waiting','active','delayed','failed')) AS total_jobs_cleared FROM fx_queue"""))
def q_clear_summary(spark, sf):
    return J.clear_summary(T.queue_jobs(spark, sf))


@query("clear_updates", wq(["fx_queue"], [], """
    SELECT crawl_id AS id, 'stopped' AS status, count(*) AS cleared_job_count FROM fx_queue
    WHERE state IN ('waiting','active','completed','failed') GROUP BY crawl_id"""))
def q_clear_updates(spark, sf):
    return J.clear_updates(T.queue_jobs(spark, sf))


@query("reset_summary", wq(["fx_queue"], [], """
    SELECT state, count(*) AS jobs, count(DISTINCT crawl_id) AS crawls_affected FROM fx_queue
    WHERE state IN ('waiting','active','completed','failed') GROUP BY ROLLUP (state)"""))
def q_reset_summary(spark, sf):
    return J.reset_summary(T.queue_jobs(spark, sf))


@query("stop_summary", wq(["fx_queue"], [], """
    SELECT crawl_id, count(*) FILTER (WHERE state IN ('active','waiting')) AS total_jobs,
        count(*) FILTER (WHERE state IN ('active','waiting') AND priority <> 2) AS jobs_stopped, 'stopped' AS status
    FROM fx_queue GROUP BY crawl_id"""))
def q_stop_summary(spark, sf):
    """A5 where jobs of priority 2 could not be removed."""
    return J.stop_summary(T.queue_jobs(spark, sf).withColumn("removable", F.col("priority") != 2))


@query("shutdown_summary", wq(["fx_queue"], [], """
    SELECT crawl_id, count(*) AS jobs, 'stopped' AS status FROM fx_queue
    WHERE state IN ('waiting','active','delayed','failed') GROUP BY crawl_id"""))
def q_shutdown_summary(spark, sf):
    return J.shutdown_summary(T.queue_jobs(spark, sf))


@query("progress", wq(["fx_job_events", "fx_latest"], [], """
    SELECT crawl_id, count(*) FILTER (WHERE state = 'completed') AS pages_crawled,
        count(*) FILTER (WHERE state = 'failed' AND NOT quota) AS errors
    FROM fx_latest GROUP BY crawl_id"""))
def q_progress(spark, sf):
    return J.progress(J.outcomes(T.job_events(spark, sf)))


@query("final_status", wq(["fx_job_events", "fx_latest", "fx_final"], [], "SELECT crawl_id, status, completed_at FROM fx_final"))
def q_final_status(spark, sf):
    return J.final_status(T.job_events(spark, sf))


@query("queue_health", wq(["fx_queue"], [], """
    SELECT *, CASE WHEN failed_count > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM (
    SELECT count(*) FILTER (WHERE state = 'waiting') AS waiting_count, count(*) FILTER (WHERE state = 'active') AS active_count,
        count(*) FILTER (WHERE state = 'completed') AS completed_count, count(*) FILTER (WHERE state = 'failed') AS failed_count
    FROM fx_queue)"""))
def q_queue_health(spark, sf):
    return J.queue_health(T.queue_jobs(spark, sf))


@query("within_quota", wq(["fx_page_events", "fx_quota"], [], """
    SELECT user_id, url, ts, month, CASE WHEN n <= quota THEN n END AS n, n <= quota AS within_quota, CASE WHEN n <= quota THEN quota - n ELSE 0 END AS remaining
    FROM (SELECT e.*, date_trunc('month', ts) AS month, coalesce(q.quota, 0) AS quota,
            row_number() OVER (PARTITION BY e.user_id, date_trunc('month', ts) ORDER BY ts, url) AS n
          FROM fx_page_events e LEFT JOIN fx_quota q ON q.user_id = e.user_id)"""))
def q_within_quota(spark, sf):
    return J.within_quota(T.page_events(spark, sf), T.quotas(spark, sf))


# ======================= frontier and visited sets ===============================================

@query("visited_count", wq(["fx_job_events"], [], "SELECT crawl_id, count(DISTINCT job_id) AS visited FROM fx_job_events GROUP BY crawl_id"))
def q_visited_count(spark, sf):
    v = T.job_events(spark, sf).select("crawl_id", F.col("job_id").alias("url"))
    return FR.visited_count(v)


_VIS = "vis AS (SELECT 'c0' AS crawl_id, url FROM pages WHERE url LIKE 'https:%')"
_CAND = "cand AS (SELECT 'c0' AS crawl_id, dst_url AS url FROM fx_edges)"


def _vis_spark(spark, sf):
    return _pages(spark, sf).filter(F.col("url").startswith("https:")).select(F.lit("c0").alias("crawl_id"), "url")


def _cand_spark(spark, sf):
    return T.link_edges(spark, sf).select(F.lit("c0").alias("crawl_id"), F.col("dst_url").alias("url"))


@query("unvisited", wq(["fx_edges"], [_VIS, _CAND], "SELECT * FROM cand WHERE url NOT IN (SELECT url FROM vis)"))
def q_unvisited(spark, sf):
    return FR.unvisited(_cand_spark(spark, sf), _vis_spark(spark, sf))


@query("is_visited", wq(["fx_edges"], [_VIS, _CAND],
                        "SELECT c.crawl_id, c.url, c.url IN (SELECT url FROM vis) AS visited FROM cand c"))
def q_is_visited(spark, sf):
    return FR.is_visited(_cand_spark(spark, sf), _vis_spark(spark, sf))


@query("mark_visited", wq(["fx_edges"], [_VIS, _CAND], "SELECT * FROM vis UNION SELECT * FROM cand"))
def q_mark_visited(spark, sf):
    return FR.mark_visited(_cand_spark(spark, sf), _vis_spark(spark, sf))


_FRONTIER_SQL = wq(["fx_edges"], ["""seeds AS (SELECT 'c0' AS crawl_id, url, 8 AS max_depth FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)
        UNION ALL SELECT 'c1', url, 5 FROM pages WHERE page_id = (SELECT max(page_id) FROM pages)
        UNION ALL SELECT 'c2', url, 3 FROM pages WHERE page_id % 25 = 1)""",
    """ce AS (SELECT c AS crawl_id, e.* FROM fx_edges e, (VALUES ('c0'), ('c1'), ('c2')) v(c) WHERE c <> 'c1' OR pos = 0)""",
    """walk(crawl_id, url, depth, parent_url, max_depth) AS (
        SELECT crawl_id, url, 0, CAST(NULL AS VARCHAR), max_depth FROM seeds
        UNION SELECT w.crawl_id, e.dst_url, w.depth + 1, w.url, w.max_depth FROM walk w
            JOIN ce e ON e.src_url = w.url AND e.crawl_id = w.crawl_id WHERE w.depth < w.max_depth)"""], """
    SELECT crawl_id, url, depth, parent_url FROM (
        SELECT crawl_id, url, depth, min(parent_url) AS parent_url, rank() OVER (PARTITION BY crawl_id, url ORDER BY depth) AS r
        FROM walk GROUP BY crawl_id, url, depth) WHERE r = 1""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("crawl_frontier", _FRONTIER_SQL)
def q_crawl_frontier(spark, sf):
    """Three crawls with their own seeds, depths and links (c1 follows only first links; c2 has the default depth)."""
    p = _pages(spark, sf).select("page_id", "url")
    ends = p.agg(F.min("page_id"), F.max("page_id")).first()
    seeds = reduce(DataFrame.unionByName, (
        p.filter(where).select(F.lit(c).alias("crawl_id"), "url", F.lit(d).cast("int").alias("max_depth"))
        for c, d, where in (("c0", 8, F.col("page_id") == ends[0]), ("c1", 5, F.col("page_id") == ends[1]), ("c2", None, F.col("page_id") % 25 == 1))))
    e = T.link_edges(spark, sf).withColumn("crawl_id", F.explode(F.array(F.lit("c0"), F.lit("c1"), F.lit("c2"))))
    return FR.crawl_frontier(seeds, e.filter((F.col("crawl_id") != "c1") | (F.col("pos") == 0)).select("crawl_id", "src_url", "dst_url"))


_MAY = """CASE WHEN regexp_extract({u}, '://([^/?#]+)', 1) LIKE 'blog.%' THEN NOT starts_with(regexp_extract({u}, '://[^/?#]+([^#]*)', 1), '/fr/') OR starts_with(regexp_extract({u}, '://[^/?#]+([^#]*)', 1), '/fr/2')
        WHEN regexp_extract({u}, '://([^/?#]+)', 1) LIKE 'm.%' THEN true
        WHEN substr(regexp_extract({u}, '://([^/?#]+)', 1), 2, 1) = 'h' THEN NOT (regexp_extract({u}, '://[^/?#]+([^#]*)', 1) LIKE '/%e%') ELSE true END"""


@query("visited_sketches", wq(["fx_job_events"], [], "SELECT crawl_id, true AS within_bound FROM fx_job_events GROUP BY crawl_id"))
def q_visited_sketches(spark, sf):
    """T4 by sketches of four rounds, merged: within 8 % (five standard errors) of the exact count, or one."""
    v = T.job_events(spark, sf).select("crawl_id", F.col("job_id").alias("url"), (F.col("event_id") % 4).alias("round"))
    merged = FR.merge_sketches(*(FR.visited_sketches(v.filter(F.col("round") == i)) for i in range(4)))
    both = FR.approximate_visited_count(merged).join(FR.visited_count(v).withColumnRenamed("visited", "exact"), "crawl_id")
    return both.select("crawl_id", (F.abs(F.col("visited") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") * 0.08)).alias("within_bound"))


@query("fetch_offsets", wq(["fx_edges"], [], """
    SELECT src, dst, pos, src_url, dst_url, (row_number() OVER (PARTITION BY src_url ORDER BY pos, dst_url) - 1) * 100 AS delay_ms,
        1 AS priority FROM fx_edges"""))
def q_fetch_offsets(spark, sf):
    return FR.fetch_offsets(T.link_edges(spark, sf))


@query("fetch_plan", wq(["fx_queue"], [], """
    SELECT crawl_id, url, depth, priority, rn - 1 AS rank, CAST(floor((rn - 1) / 20) * 1000 AS BIGINT) AS start_ms FROM (
        SELECT crawl_id, job_id AS url, 0 AS depth, priority,
            row_number() OVER (ORDER BY priority DESC, crawl_id, job_id) AS rn
        FROM fx_queue WHERE state = 'waiting')"""))
def q_fetch_plan(spark, sf):
    f = T.queue_jobs(spark, sf).filter(F.col("state") == "waiting").select(
        "crawl_id", F.col("job_id").alias("url"), F.lit(0).alias("depth"), "priority")
    return FR.fetch_plan(f).select("crawl_id", "url", "depth", "priority", "rank", "start_ms")


# ======================= URLs and rules ==========================================================

_VALID_URL_SQL = _VALID_SQL


@query("split_valid_urls", wq(["fx_requests"], [], f"SELECT url, coalesce({_VALID_URL_SQL}, false) AS is_valid FROM fx_requests"))
def q_split_valid_urls(spark, sf):
    ok, bad = U.split_valid_urls(T.crawl_requests_input(spark, sf).select("url"))
    return ok.withColumn("is_valid", F.lit(True)).unionByName(bad.withColumn("is_valid", F.lit(False)))


@query("canonicalize_urls", wq([], [canon_cte("pages", "page_id", "url")], "SELECT page_id, url_canon FROM canon"))
def q_canonicalize_urls(spark, sf):
    return U.canonicalize_urls(_pages(spark, sf).select("page_id", "url")).select("page_id", "url_canon")


@query("duplicate_url_groups", wq([], ["""two AS (SELECT page_id, url FROM pages UNION ALL
        SELECT page_id + 1000000, regexp_replace(url, '^(https?)://', '\\1://www.') FROM pages WHERE page_id % 2 = 0 AND NOT url LIKE '%://www.%')""",
                                       canon_cte("two", "page_id", "url")], """
    SELECT url_canon, count(*) AS n_urls, min(page_id) AS first_page_id FROM canon GROUP BY url_canon"""))
def q_duplicate_url_groups(spark, sf):
    """U8 on the page URLs and, for every second page, the same URL on a ``www.`` host."""
    p = _pages(spark, sf).select("page_id", "url")
    www = p.filter((F.col("page_id") % 2 == 0) & ~F.col("url").contains("://www.")).select(
        (F.col("page_id") + 1000000).alias("page_id"), F.regexp_replace("url", "^(https?)://", "$1://www.").alias("url"))
    return U.duplicate_url_groups(p.unionByName(www))


@query("pages_by_domain", """
    SELECT regexp_replace(lower(trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))), '^www\\.', '') AS domain,
        count(*) AS pages FROM pages GROUP BY 1""")
def q_pages_by_domain(spark, sf):
    return U.pages_by_domain(_pages(spark, sf))


_DOM = "regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


@query("internal_external_links", wq(["fx_edges"], [], f"""
    SELECT {_DOM.format(u='src_url')} AS src_domain,
        count(*) FILTER (WHERE {_DOM.format(u='src_url')} = {_DOM.format(u='dst_url')}) AS internal,
        count(*) FILTER (WHERE {_DOM.format(u='src_url')} <> {_DOM.format(u='dst_url')}) AS external
    FROM fx_edges GROUP BY 1"""))
def q_internal_external_links(spark, sf):
    return U.internal_external_links(T.link_edges(spark, sf))


@query("filter_media_links", wq(["fx_edges"], [], """
    SELECT src_url, dst_url || CASE pos WHEN 0 THEN '.pdf' ELSE '?f=x.pdf' END AS dst_url FROM fx_edges
    WHERE NOT regexp_matches(dst_url || CASE pos WHEN 0 THEN '.pdf' ELSE '?f=x.pdf' END, '(?i)\\.(jpg|jpeg|png|gif|pdf|zip|exe)$')
    UNION ALL SELECT src_url, dst_url FROM fx_edges"""))
def q_filter_media_links(spark, sf):
    """U5 on the edge URLs plus a '.pdf' and a '?f=x.pdf' variant of each (the first is dropped, the second kept)."""
    e = T.link_edges(spark, sf)
    variant = e.select("src_url", F.concat("dst_url", F.when(F.col("pos") == 0, F.lit(".pdf"))
                                          .otherwise(F.lit("?f=x.pdf"))).alias("dst_url"))
    return U.filter_media_links(variant.unionByName(e.select("src_url", "dst_url")), "dst_url")


@query("filter_crawlable", wq(["fx_edges"], [], """
    SELECT u AS url FROM (SELECT dst_url || CASE pos WHEN 0 THEN '.PDF' ELSE '.html' END AS u FROM fx_edges
                          UNION ALL SELECT src_url FROM fx_edges)
    WHERE regexp_matches(u, '^https?://')
      AND NOT regexp_matches(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1),
        '(?i)\\.(jpg|jpeg|png|gif|ico|pdf|doc|docx|xls|xlsx|zip|tar|gz|exe|css|js|json|xml|txt|map|mp3|mp4|avi|mov|wmv|wav|webm|ttf|woff|woff2|eot)$')"""))
def q_filter_crawlable(spark, sf):
    """U4 on the edge URLs with a '.PDF' (dropped) or '.html' (kept) variant and the sources."""
    e = T.link_edges(spark, sf)
    u = e.select(F.concat("dst_url", F.when(F.col("pos") == 0, F.lit(".PDF")).otherwise(F.lit(".html"))).alias("url")) \
        .unionByName(e.select(F.col("src_url").alias("url")))
    return U.filter_crawlable(u, "url")


_ALLOWED_SQL = """(CASE WHEN len(r.allowed_domains) = 0 THEN true ELSE
        list_bool_or(list_transform(r.allowed_domains, lambda d: h.host = d OR (r.allow_subdomains AND h.host LIKE '%.' || d)))
        AND (r.ignore_paths OR NOT list_bool_or(list_transform(r.excluded_paths, lambda e: starts_with(lower(h.path), lower(e)))))
    END)"""
_HOSTPATH = """h AS (SELECT crawl_id, page_id, url,
        regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host,
        CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
             ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path FROM fx_crawl_urls)"""


@query("filter_allowed", wq(["fx_rules", "fx_crawl_urls"], [_HOSTPATH], f"""
    SELECT h.crawl_id, h.page_id, h.url FROM h JOIN fx_rules r ON r.crawl_id = h.crawl_id WHERE {_ALLOWED_SQL}"""))
def q_filter_allowed(spark, sf):
    return RU.filter_allowed(T.crawl_urls(spark, sf), T.crawl_rules(spark))


@query("make_rules", wq(["fx_rule_requests"], [], """
    SELECT crawl_id, array_to_string(list_transform(allowed_domains, lambda d: regexp_replace(regexp_replace('www.' || d, '^www\\.', ''), '^$', '')), ',') AS allowed_domains,
        allow_subdomains, ignore_paths, array_to_string(excluded_paths, ',') AS excluded_paths FROM fx_rule_requests"""))
def q_make_rules(spark, sf):
    """D1 over one request per page, with fields left out in turn; lists flattened to text."""
    r = RU.make_rules(T.rule_requests(spark, sf))
    return r.withColumn("allowed_domains", F.array_join("allowed_domains", ",")) \
        .withColumn("excluded_paths", F.array_join("excluded_paths", ","))


@query("validate_requests", wq(["fx_rules", "fx_crawl_urls"], [_HOSTPATH], f"""
    SELECT h.crawl_id, h.page_id, CASE WHEN h.page_id % 11 = 0 THEN 'no url ' || h.url ELSE h.url END AS url,
        CASE WHEN h.page_id % 11 = 0 THEN 'INVALID_URL_FORMAT' WHEN {_ALLOWED_SQL} THEN NULL ELSE 'DOMAIN_NOT_ALLOWED' END AS error_code
    FROM h JOIN fx_rules r ON r.crawl_id = h.crawl_id"""))
def q_validate_requests(spark, sf):
    """D3 where every eleventh request has no valid URL."""
    urls = T.crawl_urls(spark, sf).withColumn("url", F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("no url "), F.col("url"))).otherwise(F.col("url")))
    ok, bad = RU.validate_requests(urls, T.crawl_rules(spark))
    return ok.select("crawl_id", "page_id", "url", F.lit(None).cast("string").alias("error_code")).unionByName(
        bad.select("crawl_id", "page_id", "url", "error_code"))


_OUTCOME_SQL = wq(["fx_rules", "fx_crawl_urls", "fx_responses"], [canon_cte("pages", "page_id", "url"), _HOSTPATH], f"""
    SELECT page_id, error_code, CASE error_code WHEN 'INVALID_URL_FORMAT' THEN 'INVALID_URL_FORMAT: no url ' || url
        WHEN 'DOMAIN_NOT_ALLOWED' THEN 'DOMAIN_NOT_ALLOWED: ' || url_canon WHEN 'DENIED_BY_ROBOTS_TXT' THEN 'DENIED_BY_ROBOTS_TXT: ' || url_canon
        WHEN 'HTTP_ERROR' THEN 'HTTP ' || status || ': ' || status_text
        WHEN 'CONTENT_EXTRACTION_FAILED' THEN 'Content extraction failed'
        WHEN 'EXTRACTED_CONTENT_FAILED_VERIFICATION' THEN 'EXTRACTED_CONTENT_FAILED_VERIFICATION: ' END AS error_message FROM (
      SELECT h.page_id, h.url, c.url_canon, s.status, CASE s.status WHEN 404 THEN 'Not Found' ELSE 'Internal Server Error' END AS status_text,
        CASE WHEN h.page_id % 11 = 0 THEN 'INVALID_URL_FORMAT' WHEN NOT {_ALLOWED_SQL} THEN 'DOMAIN_NOT_ALLOWED'
            WHEN h.page_id % 13 = 0 THEN 'DENIED_BY_ROBOTS_TXT' WHEN s.status <> 200 THEN 'HTTP_ERROR' WHEN h.page_id % 17 = 0 THEN 'CONTENT_EXTRACTION_FAILED'
            WHEN s.html = '' THEN 'EXTRACTED_CONTENT_FAILED_VERIFICATION' END AS error_code
      FROM h JOIN fx_rules r ON r.crawl_id = h.crawl_id JOIN canon c ON c.page_id = h.page_id JOIN fx_responses s ON s.page_id = h.page_id)""")


def _classified(spark, sf):
    """E1's input: every eleventh URL invalid, every thirteenth page denied, every seventeenth not extracted, statuses and bodies of fx_responses."""
    r = T.responses(spark, sf).withColumn("status_text", F.when(F.col("status") == 404, "Not Found").when(F.col("status") == 500, "Internal Server Error"))
    r = r.join(T.crawl_urls(spark, sf).select("page_id", "crawl_id"), "page_id").withColumn(
        "url", F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("no url "), F.col("url"))).otherwise(F.col("url")))
    c = U.canonicalize_urls(r)
    c = RU.with_allowed(c, T.crawl_rules(spark), "url_canon")
    return RU.classify_outcomes(c.withColumns({"robots_allowed": F.col("page_id") % 13 != 0, "extracted": F.col("page_id") % 17 != 0, "has_content": F.col("html") != ""}))


@query("classify_outcomes", _OUTCOME_SQL)
def q_classify_outcomes(spark, sf):
    return _classified(spark, sf).select("page_id", "error_code", "error_message")


@query("append_logs", _OUTCOME_SQL.replace("SELECT page_id, error_code, CASE", "SELECT crawl_job_id, level, message, error_code FROM (SELECT CAST(page_id AS VARCHAR) AS crawl_job_id, 'error' AS level, error_code, CASE", 1)
       .replace("END AS error_message FROM (", "END AS message FROM (", 1) + ") WHERE error_code IS NOT NULL")
def q_append_logs(spark, sf):
    """The rejects' log rows, appended to a log table in the shared folder and read from it."""
    path = f"{checkpoint_dir(spark)}/weft-logs/{uuid.uuid4().hex}"
    PG.append_logs(PG.rejects_to_logs(_classified(spark, sf).filter(F.col("error_code").isNotNull()), "page_id"), path)
    return spark.read.schema("crawl_job_id string, level string, message string, metadata variant, ts timestamp, date date").parquet(path).select(
        "crawl_job_id", "level", "message", F.variant_get("metadata", "$.error_code", "string").alias("error_code"))


# ======================= HTML =====================================================================

@query("html_tokens", wq([], [TOKENS], "SELECT page_id, pos, kind, tag FROM tk"))
def q_html_tokens(spark, sf):
    return H.html_tokens(_pages(spark, sf)).select("page_id", F.col("pos").cast("int").alias("pos"), "kind", "tag")


@query("clean_text", f"SELECT doc_id, {clean('text')} AS clean FROM documents")
def q_clean_text(spark, sf):
    from weft.functions.text import clean_text
    return T.read_table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))


_TITLE_INNER = _decode("regexp_extract(tok, '(?is)^<title\\b[^>]*>(.*)</title\\s*>$', 1)")
_HEADS = element_text_cte("hd", "kind = 'open' AND tag IN ('h1','h2','h3','h4','h5','h6')",
                          "(kind IN ('open', 'close') AND tag IN ('h1','h2','h3','h4','h5','h6')) OR (kind = 'close' AND tag IN ('body','html','td','th','tr','table','li'))")
_PARAS = element_text_cte("pa", "kind = 'open' AND tag = 'p'",
                          f"(kind = 'open' AND tag IN ({BLOCK_OPEN})) OR (kind = 'close' AND tag IN ({BLOCK_CLOSE}))")
_ANCH = element_text_cte("an", "kind = 'open' AND tag = 'a' AND regexp_matches(tok, '(?is)\\shref')",
                         "kind IN ('open', 'close') AND tag = 'a'")
_ITEMS = element_text_cte("li", "kind = 'open' AND tag = 'li'",
                          "(kind IN ('open', 'close') AND tag = 'li') OR (kind = 'close' AND tag IN ('ul','ol','dl'))")
_ANCHORS = f"""anchors AS (SELECT page_id, pos, {href_expr('tok')} AS href, {clean('content_raw')} AS text FROM an),
anchors_ok AS (SELECT * FROM anchors WHERE href <> '' AND text <> '')"""
_RAW = f"""body AS (SELECT t.page_id, string_agg(t.text, '' ORDER BY t.pos) AS b FROM tk t
        JOIN (SELECT page_id, min(pos) AS bp FROM tk WHERE kind = 'open' AND tag = 'body' GROUP BY page_id) s
          ON s.page_id = t.page_id AND t.pos > s.bp WHERE t.kind = 'text' GROUP BY t.page_id),
raw AS (SELECT p.page_id, coalesce(array_to_string(list_filter(list_transform(string_split(b.b, chr(10)), lambda x: {clean('x')}),
        lambda x: x <> ''), chr(10)), '') AS raw_text FROM pages p LEFT JOIN body b ON b.page_id = p.page_id)"""


@query("titles", wq([], [TOKENS], f"""
    SELECT p.page_id, nullif(t.title, '') AS title FROM pages p LEFT JOIN (
        SELECT page_id, arg_min({_TITLE_INNER}, pos) AS title FROM tk WHERE kind = 'title' GROUP BY page_id) t
    ON t.page_id = p.page_id"""))
def q_titles(spark, sf):
    return H.titles(_pages(spark, sf))


@query("headings", wq([], [TOKENS, _HEADS], f"""
    SELECT page_id, pos, CAST(substr(tag, 2, 1) AS INTEGER) AS level, {clean('content_raw')} AS content FROM hd"""))
def q_headings(spark, sf):
    return H.headings(_pages(spark, sf))


@query("paragraphs", wq([], [TOKENS, _PARAS], f"""
    SELECT page_id, pos, content FROM (SELECT page_id, pos, {clean('content_raw')} AS content FROM pa) WHERE content <> ''"""))
def q_paragraphs(spark, sf):
    return H.paragraphs(_pages(spark, sf))


@query("anchors", wq([], [TOKENS, _ANCH, _ANCHORS], "SELECT page_id, pos, href, text FROM anchors_ok"))
def q_anchors(spark, sf):
    return H.anchors(_pages(spark, sf))


@query("raw_text", wq([], [TOKENS, _RAW], "SELECT page_id, raw_text FROM raw"))
def q_raw_text(spark, sf):
    return H.raw_text(_pages(spark, sf))


@query("lists", wq([], [TOKENS, _ITEMS, f"""conts AS (SELECT page_id, pos, tag FROM tk WHERE kind = 'open' AND tag IN ('ul','ol','dl'))""",
                        f"""items AS (SELECT l.page_id, l.pos, {clean('l.content_raw')} AS item,
        (SELECT max(c.pos) FROM conts c WHERE c.page_id = l.page_id AND c.pos < l.pos) AS cpos FROM li l)"""], """
    SELECT c.page_id, c.pos, CASE c.tag WHEN 'ol' THEN 'ordered' WHEN 'dl' THEN 'definition' ELSE 'unordered' END AS list_type,
        coalesce(string_agg(i.item, chr(10) ORDER BY i.pos), '') AS content, count(i.pos) AS n_items
    FROM conts c LEFT JOIN items i ON i.page_id = c.page_id AND i.cpos = c.pos GROUP BY c.page_id, c.pos, c.tag"""))
def q_lists(spark, sf):
    return H.lists(_pages(spark, sf)).select("page_id", "pos", "list_type", "content",
                                             F.size("items").cast("bigint").alias("n_items"))


@query("tables", """
    SELECT page_id, k AS table_no, CASE WHEN k = 0 THEN 'Page|Host' ELSE '' END AS headers,
        CASE WHEN k = 0 THEN CAST(page_id AS VARCHAR) || '|' || regexp_extract(url, '://([^/?#]*)', 1) || ';cell in|in;in' ELSE 'in' END AS rows
    FROM pages, (VALUES (0), (1)) v(k)""")
def q_tables(spark, sf):
    """H8 on every page with a table (and one nested in it) built from its own id and host put before its body's end."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    made = F.concat(F.lit("</p><table><tr><th>Page</th><th>Host</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), host,
                    F.lit("</td></tr><tr></tr><tr><td>cell <table><tr><td>in</td></tr></table></td></tr></table></body></html>"))
    t = H.tables(_pages(spark, sf).withColumn("html", F.concat(F.regexp_replace("html", "</body>|</html>", ""), made)))
    return t.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1).alias("table_no"), F.array_join("headers", "|").alias("headers"),
                    F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))


_ODD = """odd AS (SELECT page_id, url, CASE page_id % 6
        WHEN 0 THEN replace(html, '</article>', '<p>before<textarea><p>a &amp; b</p></textarea></article>')
        WHEN 1 THEN replace(html, '</article>', '<p>before<iframe><p>in &amp; out</p></iframe><xmp><b>x</xmp>after</article>')
        WHEN 2 THEN html || '<script>var x = "<p>no</p>"' WHEN 3 THEN html || '<!-- open <p>no</p>'
        WHEN 4 THEN replace(html, '</article>', '<noembed><a href="/x">no</a></noembed><noframes><p>n</p></noframes></article>')
        ELSE html || '<textarea>rest <p>of it' END AS html FROM pages)"""


@query("raw_text_states", wq([], [_ODD, raw_state_tokens("odd"), _RAW, element_text_cte("pa", "kind = 'open' AND tag = 'p'",
       f"(kind = 'open' AND tag IN ({BLOCK_OPEN})) OR (kind = 'close' AND tag IN ({BLOCK_CLOSE})) OR (kind = 'text' AND tag = 'xmp')"), _ANCH, _ANCHORS], f"""
    SELECT p.page_id, md5(r.raw_text) AS content_md5, (SELECT count(*) FROM pa WHERE pa.page_id = p.page_id AND {clean('pa.content_raw')} <> '') AS n_paragraphs,
        (SELECT count(*) FROM anchors_ok a WHERE a.page_id = p.page_id) AS n_links, (SELECT count(*) FROM tk WHERE tk.page_id = p.page_id) AS n_tokens
    FROM odd p JOIN raw r ON r.page_id = p.page_id"""))
def q_raw_text_states(spark, sf):
    """H1, H3, H6 on pages with text areas, raw elements, and scripts, comments and text areas that nothing ends."""
    case, into = F.col("page_id") % 6, lambda more: F.replace("html", F.lit("</article>"), F.lit(more + "</article>"))
    odd = (F.when(case == 0, into("<p>before<textarea><p>a &amp; b</p></textarea>"))
           .when(case == 1, into("<p>before<iframe><p>in &amp; out</p></iframe><xmp><b>x</xmp>after"))
           .when(case == 2, F.concat("html", F.lit('<script>var x = "<p>no</p>"'))).when(case == 3, F.concat("html", F.lit("<!-- open <p>no</p>")))
           .when(case == 4, into('<noembed><a href="/x">no</a></noembed><noframes><p>n</p></noframes>')).otherwise(F.concat("html", F.lit("<textarea>rest <p>of it"))))
    p = _pages(spark, sf).withColumn("html", odd)
    d = H.documents(p).select("page_id", F.md5(F.col("raw_text").cast("binary")).alias("content_md5"), F.size("paragraphs").cast("bigint").alias("n_paragraphs"), F.size("links").cast("bigint").alias("n_links"))
    return d.join(H.html_tokens(p).groupBy("page_id").agg(F.count("*").alias("n_tokens")), "page_id")


@query("extractors", wq([], [TOKENS, _RAW], """
    SELECT p.page_id, md5(r.raw_text) AS content_md5, (SELECT CAST(sum(len(string_split(text, ' '))) AS BIGINT) FROM tk WHERE tk.page_id = p.page_id AND kind = 'text') AS words,
        nullif((SELECT count(*) FROM tk WHERE tk.page_id = p.page_id AND kind = 'open' AND tag = 'div'), 0) AS blocks
    FROM pages p JOIN raw r ON r.page_id = p.page_id"""))
def q_extractors(spark, sf):
    """Documents with two extractors of the user's own, by name."""
    own = {"words": lambda t: t.filter("kind = 'text'").groupBy("page_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")),
           "blocks": lambda t: t.filter("kind = 'open' AND tag = 'div'").groupBy("page_id").agg(F.count("*").alias("n"))}
    d = H.documents(_pages(spark, sf), extractors=own)
    return d.select("page_id", F.md5(F.col("raw_text").cast("binary")).alias("content_md5"), F.col("words.n").alias("words"), F.col("blocks.n").alias("blocks"))


@query("write_documents", wq([], [TOKENS, _RAW, _HEADS, _ANCH, _ANCHORS], f"""
    SELECT 'c' || CAST(p.page_id % 4 AS VARCHAR) AS crawl_id, p.url, CAST(p.page_id % 3 AS INTEGER) AS depth, 'completed' AS processing_status, md5(r.raw_text) AS content_md5,
        nullif((SELECT arg_min({_TITLE_INNER}, pos) FROM tk WHERE tk.page_id = p.page_id AND kind = 'title'), '') AS title,
        (SELECT count(*) FROM hd WHERE hd.page_id = p.page_id) AS n_headings, (SELECT count(*) FROM anchors_ok a WHERE a.page_id = p.page_id) AS n_links
    FROM pages p JOIN raw r ON r.page_id = p.page_id"""))
def q_write_documents(spark, sf):
    """The stored page rows with crawl, address, depth and status, written and read again."""
    path = f"{checkpoint_dir(spark)}/weft-documents/{uuid.uuid4().hex}"
    p = _pages(spark, sf).withColumns({"crawl_id": F.concat(F.lit("c"), (F.col("page_id") % 4).cast("string")), "depth": (F.col("page_id") % 3).cast("int")})
    PG.write_documents(H.documents(p, keep=("crawl_id", "url", "depth")), path)
    return spark.read.schema(PG.STORED_SCHEMA).parquet(path).select(
        "crawl_id", "url", "depth", "processing_status", F.md5(F.col("content_text").cast("binary")).alias("content_md5"), "title",
        F.size("extracted.structured.headings").cast("bigint").alias("n_headings"), F.size("extracted.structured.links").cast("bigint").alias("n_links"))


@query("documents", wq([], [TOKENS, _RAW, _HEADS, _PARAS, _ANCH, _ANCHORS], f"""
    SELECT p.page_id, t.title, CAST(length(r.raw_text) AS BIGINT) AS raw_text_length, md5(r.raw_text) AS content_md5,
        (SELECT count(*) FROM hd WHERE hd.page_id = p.page_id) AS n_headings,
        (SELECT count(*) FROM pa WHERE pa.page_id = p.page_id AND {clean('pa.content_raw')} <> '') AS n_paragraphs,
        (SELECT count(*) FROM tk WHERE tk.page_id = p.page_id AND kind = 'open' AND tag IN ('ul','ol','dl')) AS n_lists,
        (SELECT count(*) FROM tk WHERE tk.page_id = p.page_id AND kind = 'open' AND tag = 'table') AS n_tables,
        (SELECT count(*) FROM anchors_ok a WHERE a.page_id = p.page_id) AS n_links
    FROM pages p JOIN raw r ON r.page_id = p.page_id LEFT JOIN (
        SELECT page_id, nullif(arg_min({_TITLE_INNER}, pos), '') AS title FROM tk WHERE kind = 'title' GROUP BY page_id) t ON t.page_id = p.page_id"""))
def q_documents(spark, sf):
    """H10 flattened to one row per page: element counts and a hash of the text."""
    d = H.documents(_pages(spark, sf))
    return d.select("page_id", "title", F.length("raw_text").cast("bigint").alias("raw_text_length"), F.md5(F.col("raw_text").cast("binary")).alias("content_md5"),
                    *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("headings", "paragraphs", "lists", "tables", "links")])


_UTF16 = "CAST(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS BIGINT)"


@query("page_stats", wq([], [TOKENS, _RAW, _HEADS, _PARAS, _ANCH, _ANCHORS], f"""
    SELECT p.page_id, p.page_id % 10 <> 9 AS extraction_success, CASE WHEN p.page_id % 10 <> 9 THEN {_UTF16.format(x='r.raw_text')} END AS raw_text_length,
        CASE WHEN p.page_id % 10 <> 9 THEN (SELECT count(*) FROM hd WHERE hd.page_id = p.page_id) END AS headings_count,
        CASE WHEN p.page_id % 10 <> 9 THEN (SELECT count(*) FROM pa WHERE pa.page_id = p.page_id AND {clean('pa.content_raw')} <> '') END AS paragraphs_count,
        CASE WHEN p.page_id % 10 <> 9 THEN (SELECT count(*) FROM tk WHERE tk.page_id = p.page_id AND kind = 'open' AND tag IN ('ul','ol','dl')) END AS lists_count,
        CASE WHEN p.page_id % 10 <> 9 THEN (SELECT count(*) FROM tk WHERE tk.page_id = p.page_id AND kind = 'open' AND tag = 'table') END AS tables_count,
        CASE WHEN p.page_id % 10 <> 9 THEN (SELECT count(*) FROM anchors_ok a WHERE a.page_id = p.page_id) END AS links_count,
        CASE WHEN p.page_id % 10 <> 9 THEN {_UTF16.format(x='p.html')} END AS response_size
    FROM pages p JOIN raw r ON r.page_id = p.page_id"""))
def q_page_stats(spark, sf):
    """A7 on responses of which every tenth has no body."""
    p = _pages(spark, sf).withColumn("html", F.when(F.col("page_id") % 10 != 9, F.col("html")))
    return PG.page_stats(H.documents(PG.measured(p), keep=("response_size",)))


_VOLUME = """SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS total_size_bytes,
        CAST(len(regexp_extract_all(r.raw_text, '\\w+|[^\\w\\s]')) AS BIGINT) AS token_count
    FROM pages p JOIN raw r ON r.page_id = p.page_id"""


@query("page_volume", wq([], [TOKENS, _RAW], _VOLUME))
def q_page_volume(spark, sf):
    return PG.page_volume(H.documents(PG.measured(_pages(spark, sf)), keep=("total_size_bytes",)))


@query("crawl_volume", wq([], [TOKENS, _RAW, f"v AS ({_VOLUME})"], """
    SELECT 'c' || CAST(page_id % 4 AS VARCHAR) AS crawl_id, CAST(sum(total_size_bytes) AS BIGINT) AS total_size_bytes, CAST(sum(token_count) AS BIGINT) AS token_count,
        count(*) AS pages FROM v GROUP BY 1"""))
def q_crawl_volume(spark, sf):
    """A8 per crawl: four crawls share the pages."""
    p = _pages(spark, sf).withColumn("crawl_id", F.concat(F.lit("c"), (F.col("page_id") % 4).cast("string")))
    return PG.crawl_volume(PG.page_volume(H.documents(PG.measured(p), keep=("crawl_id", "total_size_bytes"))))


@query("drop_empty_documents", wq(["fx_responses"], [TOKENS.replace("FROM pages)", "FROM fx_responses WHERE status = 200)", 1),
                                                   _RAW.replace("FROM pages p", "FROM fx_responses p"), _PARAS], f"""
    SELECT r.page_id FROM raw r WHERE r.page_id IN (SELECT page_id FROM fx_responses WHERE status = 200)
        AND (r.raw_text <> '' OR EXISTS (SELECT 1 FROM pa WHERE pa.page_id = r.page_id AND {clean('pa.content_raw')} <> ''))"""))
def q_drop_empty_documents(spark, sf):
    ok = T.read_pages(spark, T.responses(spark, sf))
    return RU.drop_empty_documents(H.documents(ok)).select("page_id")


# ======================= links =====================================================================

_PAGE_LINKS = "page_links AS (SELECT a.page_id, p.url AS src_url, a.pos, a.href, a.text FROM anchors_ok a JOIN pages p ON p.page_id = a.page_id)"


@query("page_links", wq([], [TOKENS, _ANCH, _ANCHORS, _PAGE_LINKS], "SELECT * FROM page_links"))
def q_page_links(spark, sf):
    return L.page_links(_pages(spark, sf))


_RESOLVE_SQL = (f"regexp_extract(src_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || "
                f"{_enc_path('href')}")


@query("resolve_links", wq([], [TOKENS, _ANCH, _ANCHORS, _PAGE_LINKS], f"""
    SELECT page_id, pos, href, {_RESOLVE_SQL} AS url_abs FROM page_links"""))
def q_resolve_links(spark, sf):
    return U.resolve_links(L.page_links(_pages(spark, sf)), "href", "src_url").select("page_id", "pos", "href", "url_abs")


_OUTLINKS = [canon_cte("pages", "page_id", "url", name="pc"),
             "pl AS (SELECT l.*, c.url_canon AS page_canon FROM page_links l JOIN pc c ON c.page_id = l.page_id)",
             canon_cte("pl", "page_id, pos", "href", base="page_canon", name="hc"),
             """outl AS (SELECT page_id, pos, url_canon AS dst_url FROM (
                 SELECT *, row_number() OVER (PARTITION BY page_id, url_canon ORDER BY pos) AS rn FROM hc WHERE url_canon IS NOT NULL)
               WHERE rn = 1 AND NOT regexp_matches(url_canon, '(?i)[.](jpg|jpeg|png|gif|pdf|zip|exe)$'))"""]


@query("outlinks", wq([], [TOKENS, _ANCH, _ANCHORS, _PAGE_LINKS, *_OUTLINKS], "SELECT page_id, pos, dst_url FROM outl"))
def q_outlinks(spark, sf):
    return L.outlinks(L.page_links(_pages(spark, sf))).select("page_id", "pos", "dst_url")


@query("renormalize", wq([], [TOKENS, _ANCH, _ANCHORS, _PAGE_LINKS, *_OUTLINKS,
                               "rn AS (SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN replace(dst_url, '://', '://www.www.') ELSE dst_url END AS u FROM outl)",
                               canon_cte("rn", "page_id, pos", "u", name="rc")], "SELECT page_id, pos, url_canon AS dst_url FROM rc"))
def q_renormalize(spark, sf):
    """L4 on the outlinks, every second one moved to a ``www.www.`` host."""
    o = L.outlinks(L.page_links(_pages(spark, sf)))
    o = o.withColumn("dst_url", F.when(F.col("pos") % 2 == 0, F.replace("dst_url", F.lit("://"), F.lit("://www.www."))).otherwise(F.col("dst_url")))
    return L.renormalize(o).select("page_id", "pos", "dst_url")


@query("domain_link_summary", wq([], [TOKENS, _ANCH, _ANCHORS, _PAGE_LINKS, *_OUTLINKS], f"""
    SELECT {_DOM.format(u='p.url')} AS domain, count(DISTINCT o.page_id) AS pages, count(*) AS links,
        count(DISTINCT o.dst_url) AS targets
    FROM outl o JOIN pages p ON p.page_id = o.page_id
    WHERE {_DOM.format(u='o.dst_url')} = {_DOM.format(u='p.url')} OR {_DOM.format(u='o.dst_url')} LIKE '%.' || {_DOM.format(u='p.url')}
    GROUP BY 1"""))
def q_domain_link_summary(spark, sf):
    """Minimum slice: pages -> anchors -> outlinks under rules from each page's own host -> per-domain summary."""
    p = U.with_domain(_pages(spark, sf), "url", "domain")
    rules = written(RU.make_rules(p.select(F.col("page_id").alias("crawl_id"), F.array("domain").alias("allowed_domains"))), "rules", plain=True)  # D2 reads them many times
    links = L.page_links(L.with_base(p), keep=("base", "domain"))  # addresses are parsed for the page, not for each link
    out = L.outlinks(links.withColumnRenamed("page_id", "crawl_id").withColumn("page_id", F.col("crawl_id")), rules, base="base")
    return out.groupBy("domain").agg(F.count_distinct("page_id").cast("bigint").alias("pages"),
                                     F.count("*").cast("bigint").alias("links"),
                                     F.count_distinct("dst_url").cast("bigint").alias("targets"))


_CRAWL_SQL = wq(["fx_edges"], [TOKENS, _ANCH, _ANCHORS, _PAGE_LINKS, *_OUTLINKS, f"""ce AS (SELECT src_url, dst_url FROM (
        SELECT c.url_canon AS src_url, o.dst_url FROM outl o JOIN pc c ON c.page_id = o.page_id WHERE o.page_id % 10 NOT IN (3, 7, 9)
        UNION SELECT s.url_canon, d.url_canon FROM fx_edges e JOIN pc s ON s.page_id = e.src JOIN pc d ON d.page_id = e.dst WHERE e.src % 10 NOT IN (3, 7, 9))
        WHERE {_MAY.format(u='src_url')} AND {_MAY.format(u='dst_url')})""",
    """seeds AS (SELECT 'c0' AS crawl_id, url_canon AS url, 2 AS max_depth FROM pc WHERE page_id % 5 = 0 UNION SELECT 'c1', url_canon, 4 FROM pc WHERE page_id % 50 = 1)""",
    """walk(crawl_id, url, depth, parent_url, max_depth) AS (
        SELECT crawl_id, url, 0, CAST(NULL AS VARCHAR), max_depth FROM seeds
        UNION SELECT w.crawl_id, e.dst_url, w.depth + 1, w.url, w.max_depth FROM walk w JOIN ce e ON e.src_url = w.url WHERE w.depth < w.max_depth)"""], """
    SELECT crawl_id, url, depth, parent_url FROM (
        SELECT crawl_id, url, depth, min(parent_url) AS parent_url, rank() OVER (PARTITION BY crawl_id, url ORDER BY depth) AS r
        FROM walk GROUP BY crawl_id, url, depth) WHERE r = 1""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("crawl_pages", _CRAWL_SQL)
def q_crawl_pages(spark, sf):
    """J1 over the links of fetched pages: L3's outlinks (two more anchors in each page lead to other pages) of the pages that pass
    E1 and E2, where robots.txt allows them; two crawls."""
    e = T.link_edges(spark, sf).groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<a href="'), "dst_url", F.lit('">next</a>')))), " ").alias("more"))
    p = T.responses(spark, sf).join(e.withColumnRenamed("src", "page_id"), "page_id")
    p = p.withColumn("html", F.when(F.col("html") != "", F.concat("html", "more")).otherwise(F.lit("")))
    p = p.withColumn("crawl_id", F.explode(F.array(F.lit("c0"), F.lit("c1"))))
    u = U.canonicalize_urls(T.read_table(spark, sf, "pages").select("page_id", "url"), out="u")
    seeds = u.filter("page_id % 5 = 0").select(F.lit("c0").alias("crawl_id"), F.col("u").alias("url"), F.lit(2).alias("max_depth")).unionByName(
        u.filter("page_id % 50 = 1").select(F.lit("c1").alias("crawl_id"), F.col("u").alias("url"), F.lit(4).alias("max_depth")))
    return FR.crawl_frontier(seeds, FR.crawl_edges(p, T.robots_files(spark, sf)))


_LINK_RULES = [f"""lr AS (SELECT l.*, (['c_net', 'c_one', 'c_free', 'c_nopath'])[l.page_id % 4 + 1] AS crawl_id FROM page_links l)""",
               canon_cte("lr", "page_id, pos, crawl_id", "href", base="src_url", name="lc"),
               """h AS (SELECT crawl_id, page_id, pos, url_canon AS url,
        regexp_replace(lower(regexp_extract(url_canon, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host,
        CASE WHEN regexp_extract(url_canon, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
             ELSE regexp_extract(url_canon, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path FROM lc)"""]


@query("filter_valid_links", wq(["fx_rules"], [TOKENS, _ANCH, _ANCHORS, _PAGE_LINKS, *_LINK_RULES], f"""
    SELECT h.page_id, h.pos FROM h JOIN fx_rules r ON r.crawl_id = h.crawl_id WHERE {_ALLOWED_SQL}"""))
def q_filter_valid_links(spark, sf):
    links = L.page_links(_pages(spark, sf)).withColumn("crawl_id", T.rule_set()).filter("crawl_id IS NOT NULL")
    return L.filter_valid_links(links, T.crawl_rules(spark)).select("page_id", "pos")


# ======================= robots, outcomes, upserts ==================================================

@query("robots_allowed", wq([], [canon_cte("pages", "page_id", "url"),
    """o AS (SELECT page_id, url_canon, regexp_extract(url_canon, '://([^/?#]+)', 1) AS host, regexp_extract(url_canon, '://[^/?#]+([^#]*)', 1) AS rest FROM canon)"""], """
    SELECT page_id, url_canon AS url, CASE WHEN host LIKE 'blog.%' THEN NOT starts_with(rest, '/fr/') OR starts_with(rest, '/fr/2')
        WHEN host LIKE 'm.%' THEN true WHEN substr(host, 2, 1) = 'h' THEN NOT (rest LIKE '/%e%') ELSE true END AS robots_allowed FROM o"""))
def q_robots_allowed(spark, sf):
    urls = U.canonicalize_urls(_pages(spark, sf).select("page_id", "url")).select("page_id", F.col("url_canon").alias("url"))
    return RB.robots_allowed(urls, T.robots_files(spark, sf)).select("page_id", "url", "robots_allowed")


@query("upsert_pages", wq(["fx_responses"], ["tgt AS (SELECT 'c0' AS crawl_id, url, page_id FROM fx_responses WHERE status = 200)"], """
    SELECT 'c0' AS crawl_id, p.url, p.page_id, p.url NOT IN (SELECT url FROM tgt) AS inserted FROM pages p"""))
def q_upsert_pages(spark, sf):
    tgt = T.read_pages(spark, T.responses(spark, sf)).select(F.lit("c0").alias("crawl_id"), "url", "page_id")
    new = _pages(spark, sf).select(F.lit("c0").alias("crawl_id"), "url", "page_id")
    return PG.upsert_pages(tgt, new, key=("crawl_id", "url"), order="page_id")


@query("upsert_outcomes", wq(["fx_quota"], ["""o AS (SELECT o_orderkey AS k, o_custkey AS crawl_id, 'https://example.com/o/' || CAST(o_orderkey AS VARCHAR) AS url, o_orderdate AS ts FROM orders)""",
    "tgt AS (SELECT crawl_id, url, ts FROM o WHERE k % 3 = 0)",
    "new AS (SELECT crawl_id, url, CASE WHEN k % 4 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts, k % 3 = 0 AS known FROM o WHERE k % 3 <> 0 OR k % 9 = 0)",
    "used AS (SELECT crawl_id AS user_id, date_trunc('month', ts) AS m, count(*) AS used FROM tgt GROUP BY 1, 2)",
    """x AS (SELECT n.crawl_id, n.url, n.crawl_id AS user_id, n.ts, known, greatest(coalesce(q.quota, 0) - coalesce(u.used, 0), 0) AS have,
        row_number() OVER (PARTITION BY known, n.crawl_id, date_trunc('month', n.ts) ORDER BY n.ts, n.url) AS rn
        FROM new n LEFT JOIN fx_quota q ON q.user_id = n.crawl_id LEFT JOIN used u ON u.user_id = n.crawl_id AND u.m = date_trunc('month', n.ts))"""], """
    SELECT crawl_id, url, user_id, ts, NOT known AND rn <= have AS inserted, NOT known AND rn > have AS quota_exceeded,
        CAST(CASE WHEN known THEN have WHEN rn <= have THEN have - rn ELSE 0 END AS BIGINT) AS pages_remaining FROM x"""))
def q_upsert_outcomes(spark, sf):
    """S6 answers for a batch of orders as pages: a third is stored and charged already, some of those come again, some pages come twice."""
    o = T.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("crawl_id"),
                                                  F.concat(F.lit("https://example.com/o/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderdate").alias("ts"))
    new = o.filter((F.col("k") % 3 != 0) | (F.col("k") % 9 == 0))
    new = new.unionByName(new.filter("k % 4 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))).drop("k")
    jobs = T.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_id"))
    return PG.upsert_outcomes(o.filter("k % 3 = 0").drop("k"), new, jobs, T.quotas(spark, sf))


@query("keyed_table", """
    SELECT 'c0' AS crawl_id, o_orderkey % 500 AS page, count(*) AS versions, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 2""")
def q_keyed_table(spark, sf):
    """S6 on files: three upserts of orders into a table keyed by (crawl, page); each rewrites only the buckets it touches."""
    from weft.sources.keyed import KeyedTable
    o = T.read_table(spark, sf, "orders").select(F.lit("c0").alias("crawl_id"), (F.col("o_orderkey") % 500).alias("page"), F.col("o_orderkey").alias("k"),
                                                  F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    t = KeyedTable(spark, f"{checkpoint_dir(spark)}/weft-keyed/{uuid.uuid4().hex}", "crawl_id string, page long, versions long, k long, ts timestamp, price double", ("crawl_id", "page"))

    def later(old, new):
        both = old.unionByName(new)
        best = F.max_by(F.struct("k", "ts", "price"), F.struct("ts", "k")).alias("b")
        return both.groupBy("crawl_id", "page").agg(F.sum("versions").alias("versions"), best).select("crawl_id", "page", "versions", "b.*")

    for part in ("k % 7 < 3", "k % 7 between 3 and 5", "k % 7 = 6"):
        rows = o.filter(part).withColumn("versions", F.lit(1).cast("bigint"))
        t.upsert(later(rows, rows.limit(0)), later)
    return t.read().select("crawl_id", "page", "versions", "price")


# ======================= streaming ===================================================================

@query("throughput", wq(["fx_job_events"], [], """
    SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, state, count(*) AS n FROM fx_job_events GROUP BY 1, 2"""))
def q_throughput(spark, sf):
    """R5 run as a Structured Streaming query over the events table (availableNow), equal to the batch count."""
    from weft.streaming.live import stream_throughput_table
    return stream_throughput_table(spark, sf)


@query("dedupe_urls", wq(["fx_job_events"], [], "SELECT DISTINCT crawl_id, job_id AS url FROM fx_job_events"))
def q_dedupe_urls(spark, sf):
    """R3 run as a stream over the events table."""
    from weft.streaming.live import stream_unique_urls_table
    return stream_unique_urls_table(spark, sf)


@query("live_queue_stats", wq(["fx_job_events", "fx_latest"], [], """
    SELECT count(*) FILTER (WHERE state = 'waiting') AS waiting_count, count(*) FILTER (WHERE state = 'active') AS active_count,
        count(*) FILTER (WHERE state = 'completed') AS completed_count, count(*) FILTER (WHERE state = 'failed') AS failed_count FROM fx_latest"""))
def q_live_queue_stats(spark, sf):
    """R2 run as a stream over the events in four batches, from the totals that the changes keep."""
    from weft.streaming.live import live_jobs_table
    return live_jobs_table(spark, sf, "queue").queue_stats()


@query("live_crawl_stats", ORACLE["crawl_stats"].replace("WITH fx_crawl_jobs AS", "WITH fx_job_events AS (" + FX["fx_job_events"] + "),\nfx_latest AS ("
                                                         + FX["fx_latest"] + "),\nfx_crawl_jobs AS", 1).replace("FROM fx_queue WHERE", "FROM fx_latest WHERE"))
def q_live_crawl_stats(spark, sf):
    """R1 run as a stream over the events in four batches, from the counts of the newest crawls."""
    from weft.streaming.live import live_jobs_table
    return live_jobs_table(spark, sf, "crawls").crawl_stats(T.crawl_jobs(spark, sf), 200)


@query("track_active", wq(["fx_job_events", "fx_latest", "fx_final"], [], """
    SELECT a.crawl_id, a.active, f.status, f.completed_at FROM (
        SELECT crawl_id, count(*) FILTER (WHERE state IN ('waiting','active','delayed')) AS active FROM fx_latest GROUP BY crawl_id) a
    LEFT JOIN fx_final f ON f.crawl_id = a.crawl_id"""))
def q_track_active(spark, sf):
    """R4 run as a stream over the events in four batches."""
    from weft.streaming.live import live_jobs_table
    return live_jobs_table(spark, sf, "active").active()


@query("publish_stats", wq(["fx_crawl_jobs", "fx_job_events", "fx_latest"], [], """
    SELECT CASE WHEN j.id IS NULL THEN 'error' ELSE 'crawlUpdate' END AS type, CASE WHEN j.id IS NULL THEN 'Failed to update crawl ' || CAST(c.crawl_id AS VARCHAR) END AS message,
        c.crawl_id, CASE WHEN j.id IS NOT NULL THEN c.total END AS total, CASE WHEN j.id IS NOT NULL THEN c.active END AS active, CASE WHEN j.id IS NOT NULL THEN c.failed END AS failed, j.status
    FROM (SELECT crawl_id, count(*) AS total, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'failed') AS failed FROM fx_latest GROUP BY crawl_id) c
    LEFT JOIN fx_crawl_jobs j ON j.id = c.crawl_id"""))
def q_publish_stats(spark, sf):
    """The last message on each crawl of the feed; crawls without a job row are errors."""
    from weft.streaming.live import live_jobs_table
    feed = live_jobs_table(spark, sf, "feed", T.crawl_jobs(spark, sf)).feed()
    last = feed.groupBy("crawl_id").agg(F.max_by(F.struct("type", "message", "total", "active", "failed", "status"), "v").alias("m"))
    return last.select("m.type", "m.message", "crawl_id", "m.total", "m.active", "m.failed", "m.status")


_AGAIN = """again AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN replace(html, '</article>', '<h2>Fetched again</h2></article>') ELSE html END AS html FROM pages)"""


@query("stream_documents", wq([], [_AGAIN, TOKENS.replace("FROM pages)", "FROM again)", 1), _RAW.replace("FROM pages p", "FROM again p"), _PARAS, _HEADS, _ANCH, _ANCHORS], f"""
    SELECT 'c0' AS crawl_id, p.url, CAST(length(r.raw_text) AS BIGINT) AS raw_text_length, md5(r.raw_text) AS content_md5,
        (SELECT count(*) FROM hd WHERE hd.page_id = p.page_id) AS n_headings, (SELECT count(*) FROM anchors_ok a WHERE a.page_id = p.page_id) AS n_links
    FROM pages p JOIN raw r ON r.page_id = p.page_id
    WHERE r.raw_text <> '' OR EXISTS (SELECT 1 FROM pa WHERE pa.page_id = p.page_id AND {clean('pa.content_raw')} <> '')"""))
def q_stream_documents(spark, sf):
    """R6 run as a stream over the pages in four batches; every fifth page is fetched again, changed, an hour after the others."""
    from weft.streaming.live import stream_documents_table
    p = T.read_table(spark, sf, "pages").select(F.lit("c0").alias("crawl_id"), "page_id", "url", F.lit(0).alias("depth"), "html",
                                                 F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 3000).alias("fetched"))
    again = p.filter("page_id % 5 = 0").withColumns({"html": F.replace("html", F.lit("</article>"), F.lit("<h2>Fetched again</h2></article>")), "fetched": F.col("fetched") + F.expr("INTERVAL 1 HOUR")})
    return stream_documents_table(spark, p.unionByName(again)).select(
        "crawl_id", "url", F.length("content_text").cast("bigint").alias("raw_text_length"), F.md5(F.col("content_text").cast("binary")).alias("content_md5"),
        F.size("extracted.structured.headings").cast("bigint").alias("n_headings"), F.size("extracted.structured.links").cast("bigint").alias("n_links"))
