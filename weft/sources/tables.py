"""Sources: driver tables, fetched pages (S1) and the derived crawl tables.

The driver ships TPC-H-like tables plus ``pages``. Crawl-shaped inputs (crawl
jobs, queue jobs, job events, robots files, rules, requests, responses, link
edges, quotas) are *derived* from them with plain DataFrame expressions, so
their volume grows with the scale factor. ``weft.plans.oracle`` holds the
same derivations in DuckDB SQL for the correctness check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BODY_BYTES = 10 * 1024 * 1024  # fixed value: largest accepted response body (10 MiB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of pages in JSON lines; those that a line lacks are NULL.
PAGE_LINE_SCHEMA = "page_id BIGINT, url STRING, status INT, html STRING"


def read_pages(spark: SparkSession, source: str | DataFrame, form: str = "parquet", schema: str = PAGE_LINE_SCHEMA) -> DataFrame:
    """Fetched pages that go on to extraction: status 200 (no column = 200) and body <= 10 MiB.

    source: a table, or the path of Parquet files or of JSON lines (``form='json'``, read by ``schema``; a line that is no
    JSON object has no status and is left out).
    """
    if isinstance(source, str):
        df = spark.read.parquet(source) if form == "parquet" else spark.read.schema(schema).option("mode", "PERMISSIVE").json(source)
    else:
        df = source
    status = F.col("status") if "status" in df.columns else F.lit(200)
    return df.filter((status == 200) & (F.octet_length("html") <= MAX_BODY_BYTES))


# ---- derived crawl tables ---------------------------------------------------------------------

def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_crawl_jobs from orders: id, user_id, created_at, status, max_depth."""
    o = read_table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "crawled")
              .when(F.col("o_orderstatus") == "O", "running").otherwise("pending"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                    F.col("o_orderdate").alias("created_at"), status.alias("status"), F.lit(3).alias("max_depth"))


def queue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_queue from lineitem: job_id, crawl_id, state, priority, event_ts."""
    li = read_table(spark, sf_dir, "lineitem")
    st = F.concat(F.col("l_linestatus"), F.col("l_returnflag"))
    state = (F.when(st.isin("FA", "FN"), "completed").when(st == "FR", "failed").when(st == "OA", "active")
             .when(st == "ON", "waiting").when(st == "OR", "delayed"))
    job_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                         F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                         F.date_format("l_shipdate", "yyyyMMdd"))
    return li.select(job_id.alias("job_id"), F.col("l_orderkey").alias("crawl_id"), state.alias("state"),
                     F.col("l_linenumber").alias("priority"), F.col("l_shipdate").alias("event_ts"))


def job_event_columns(e: DataFrame) -> DataFrame:
    """Raw events as job events. Crawls with an id divisible by 3 are over: their jobs end in every event."""
    over = F.col("user_id") % 3 == 0
    kind = F.col("event_type")
    state = (F.when(kind == "purchase", "completed").when(kind == "error", "failed")
             .when(over, F.when(kind == "signup", "failed").otherwise("completed"))
             .when(kind == "view", "waiting").when(kind == "click", "active").when(kind == "signup", "delayed"))
    code = F.when(F.col("state") == "failed", F.when(F.col("event_id") % 4 == 0, "QuotaExceededError").otherwise("CrawlError"))
    return e.select("event_id", F.col("user_id").alias("crawl_id"),
                    F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("props")).alias("job_id"),
                    state.alias("state"), "ts").withColumn("error_code", code)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_job_events from events: event_id, crawl_id, job_id, state, ts, error_code."""
    return job_event_columns(read_table(spark, sf_dir, "events"))


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_quota from customer: user_id, monthly_quota (1 to 3; every tenth user has none)."""
    c = read_table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 10 != 0)
    return c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 3 + 1).cast("int").alias("monthly_quota"))


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages charged to users: orders as (user_id, url, ts); every fourth order is charged twice."""
    o = read_table(spark, sf_dir, "orders")
    o = o.unionByName(o.filter(F.col("o_orderkey") % 4 == 0))
    return o.select(F.col("o_custkey").alias("user_id"),
                    F.concat(F.lit("https://example.com/o/"), F.col("o_orderkey").cast("string")).alias("url"),
                    F.col("o_orderdate").alias("ts"))


def rule_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_rule_requests: one request per page with some fields left out: crawl_id, allowed_domains, allow_subdomains, ignore_paths, excluded_paths."""
    p = read_table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)
    i = F.col("page_id")
    return p.select(i.alias("crawl_id"), F.when(i % 3 > 0, F.array(F.concat(F.lit(" WWW."), F.upper(host)))).alias("allowed_domains"),
                    F.when(i % 2 == 0, i % 4 == 0).alias("allow_subdomains"), F.when(i % 5 == 0, i % 10 == 0).alias("ignore_paths"),
                    F.when(i % 7 == 0, F.array(F.lit("/fr"))).alias("excluded_paths"))


# Four crawl rule sets used with the page URLs (fx_rules).
RULES_ROWS = [
    ("c_net", ["example.net"], True, False, ["/fr"]),
    ("c_one", ["ththre.example.com"], False, False, ["/admin", "/private", "/wp-admin", "/login", "/logout"]),
    ("c_free", [], True, False, ["/fr"]),
    ("c_nopath", ["example.com"], True, True, ["/admin", "/private", "/wp-admin", "/login", "/logout"]),
]
RULES_SCHEMA = ("crawl_id string, allowed_domains array<string>, allow_subdomains boolean, "
                "ignore_paths boolean, excluded_paths array<string>")


def crawl_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES_ROWS, RULES_SCHEMA)


def rule_set(page_id: str = "page_id") -> Column:
    """The rule set that a page is dealt to: the (id mod 4 + 1)-th, from the end where that is negative, none (NULL) at 0 or without
    an id, as SQL's list index has it. ``element_at`` fails at 0 and, in ANSI mode, gives some set for a NULL."""
    n = len(RULES_ROWS)
    at = F.col(page_id) % n + 1
    return F.get(F.array(*[F.lit(r[0]) for r in RULES_ROWS]), F.when(at < 0, at + n).otherwise(at - 1).cast("int"))


def crawl_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs assigned to the four rule sets in turn: crawl_id, page_id, url (without pages of no set, which no rules join)."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(rule_set().alias("crawl_id"), "page_id", "url").filter("crawl_id IS NOT NULL")


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_robots: one robots.txt per origin of the pages' canonical URLs (m. hosts: none = fetch failed). Hosts with an 'h'
    after the first letter deny everything, with a byte order mark and tabs as some files have them."""
    p = read_table(spark, sf_dir, "pages")
    origin = F.regexp_replace(F.regexp_extract(F.lower("url"), r"^([a-z][a-z0-9+.\-]*://[^/?#]+)", 1), r"://www\.", "://")
    host = F.regexp_extract(origin, r"://(.*)$", 1)
    body = (F.when(host.startswith("blog."), F.lit("User-agent: *\nDisallow: /fr/\nAllow: /fr/2"))
            .when(host.startswith("m."), F.lit(None))
            .when(host.substr(2, 1) == "h", F.lit("\ufeffUser-agent:\t*\nDisallow:\t/*e # all with an e"))
            .otherwise(F.lit("User-agent: *\nAllow: /")))
    return p.select(origin.alias("origin"), body.alias("body")).filter(F.col("body").isNotNull()).distinct()


def crawl_requests_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_requests: page URLs plus a few malformed ones: url, max_depth, user_id."""
    p = read_table(spark, sf_dir, "pages")
    base = p.select("url", F.when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(F.col("page_id") % 4)
                    .cast("int").alias("max_depth"), (F.col("page_id") % 7).alias("user_id"))
    extra = spark.createDataFrame([("not-a-url", 2, 1), ("", 2, 1), ("mailto:a@b.c", None, 2)],
                                  "url string, max_depth int, user_id long")
    return base.unionByName(extra)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_responses: pages with some non-200 statuses and emptied bodies."""
    p = read_table(spark, sf_dir, "pages")
    m = F.col("page_id") % 10
    status = F.when(m == 3, 404).when(m == 7, 500).otherwise(200)
    return p.select("page_id", "url", status.alias("status"),
                    F.when(m == 9, F.lit("")).otherwise(F.col("html")).alias("html"))


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_edges: two out-links per page (pos 0 and 1), ``(2i+1) mod N`` and ``(3i+2) mod N``, as URLs."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    n = p.select(F.count("*")).scalar()
    e = p.select(F.col("page_id").alias("src"), F.posexplode(F.array(
        (F.col("page_id") * 2 + 1) % n, (F.col("page_id") * 3 + 2) % n)).alias("pos", "dst"))
    s = p.select(F.col("page_id").alias("src"), F.col("url").alias("src_url"))
    d = p.select(F.col("page_id").alias("dst"), F.col("url").alias("dst_url"))
    return e.join(s, "src").join(d, "dst").select("src", "dst", "pos", "src_url", "dst_url")
