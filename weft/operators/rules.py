"""Domain rules, request validation and outcome classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.urls import effective_domain, with_canonical, with_known_parts, with_url_parts
from weft.operators.jobs import DEFAULT_EXCLUDED_PATHS

# Error codes in the order a page is checked.
ERROR_CODES = ["INVALID_URL_FORMAT", "DOMAIN_NOT_ALLOWED", "DENIED_BY_ROBOTS_TXT", "HTTP_ERROR",
               "CONTENT_EXTRACTION_FAILED", "EXTRACTED_CONTENT_FAILED_VERIFICATION"]

def make_rules(requests: DataFrame) -> DataFrame:
    """One rule row per crawl with defaults: subdomains allowed, paths checked,
    excluded ``/admin /private /wp-admin /login /logout``; domains normalised."""
    cols = requests.columns
    allowed = F.col("allowed_domains") if "allowed_domains" in cols else F.lit(None).cast("array<string>")
    return requests.select(
        "crawl_id",
        F.transform(F.coalesce(allowed, F.array().cast("array<string>")), effective_domain).alias("allowed_domains"),
        (F.coalesce(F.col("allow_subdomains"), F.lit(True)) if "allow_subdomains" in cols else F.lit(True)).alias("allow_subdomains"),
        (F.coalesce(F.col("ignore_paths"), F.lit(False)) if "ignore_paths" in cols else F.lit(False)).alias("ignore_paths"),
        (F.coalesce(F.col("excluded_paths"), F.array(*[F.lit(p) for p in DEFAULT_EXCLUDED_PATHS]))
         if "excluded_paths" in cols else F.array(*[F.lit(p) for p in DEFAULT_EXCLUDED_PATHS])).alias("excluded_paths"),
    )


def _allowed_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The (crawl, host) pairs that equal one of the crawl's domains, or lie below one where subdomains are allowed.

    The host and what follows each of its dots are looked up in the domains: an equi-join on (crawl, domain), so a crawl with
    many domains costs its matches only.
    """
    domains = rules.select(F.col("crawl_id").alias("_c"), F.col("allow_subdomains").alias("_below"), F.explode("allowed_domains").alias("_domain")).distinct()
    labels = F.split("_host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.array_size(labels)), lambda i: F.struct((i > 1).alias("below"), F.array_join(F.slice(labels, i, F.array_size(labels)), ".").alias("end")))
    asked = hosts.select("_c", "_host", F.explode(ends).alias("_e")).select("_c", "_host", "_e.below", F.col("_e.end").alias("_domain"))
    return asked.join(domains, ["_c", "_domain"]).filter(~F.col("below") | F.col("_below")).select("_c", "_host").distinct()


def with_allowed(urls: DataFrame, rules: DataFrame, url: str = "url", crawl: str = "crawl_id",
                 out: str = "allowed") -> DataFrame:
    """D2 as a flag: add ``out`` (False for invalid URLs).

    (b) no allowed domains (or no rules for the crawl): allowed, path check skipped; (c) host equals an
    allowed domain, or ends with ``.domain`` when subdomains are allowed;
    (d) unless paths are ignored, the lower-cased path must not start with an
    excluded path. Rules are joined by crawl id and hosts by (crawl, host); each host is
    looked up once. Spark's own statistics choose the joins.
    """
    no_paths = F.array().cast("array<string>")
    r = rules.select(F.col("crawl_id").alias("_rc"), (F.size(F.coalesce("allowed_domains", no_paths)) > 0).alias("_bound"),
                     F.when(F.coalesce("ignore_paths", F.lit(False)), no_paths).otherwise(F.transform(F.coalesce("excluded_paths", no_paths), F.lower)).alias("_ep"))
    p = with_url_parts(urls, url, None, "_a").withColumns({"_host": effective_domain(F.col("_a.host")), "_path": F.lower("_a.path"), "_valid": F.col("_a.ok"), "_c": F.col(crawl)}).drop("_a")
    found = _allowed_hosts(p.filter("_valid").select("_c", "_host").distinct(), rules).withColumn("_in", F.lit(True))
    p = p.join(r, p["_c"] == r["_rc"], "left").join(found, ["_c", "_host"], "left")
    barred = F.exists(F.coalesce("_ep", no_paths), lambda e: F.col("_path").startswith(e))
    bound = F.coalesce("_bound", F.lit(False))
    flag = F.col("_valid") & (~bound | (F.coalesce("_in", F.lit(False)) & ~barred))
    return p.withColumn(out, F.coalesce(flag, F.lit(False))).select(*urls.columns, out)


def filter_allowed(urls: DataFrame, rules: DataFrame, url: str = "url", crawl: str = "crawl_id") -> DataFrame:
    """Keep the URLs that the crawl's rules allow.

    As ``with_allowed``, but in one pass over ``urls``: a crawl's domains are first reduced to those that lie below no other
    allowed one, so a host has at most one of them, and is looked up only by as many labels as the crawl's domains have.
    A NULL among the domains matches no host; its labels are counted by ``array_size``, as ``size`` of NULL is -1 outside ANSI mode.
    """
    own = rules.select(F.col("crawl_id").alias("_c"), F.col("allow_subdomains").alias("_below"), F.explode("allowed_domains").alias("_domain")).distinct()
    labels = F.split("_domain", r"\.", -1)
    above = own.filter("_below").select("_c", "_domain", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.array_size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.array_size(labels)), "."))).alias("_up"))
    held = own.select("_c", F.col("_domain").alias("_up"))
    inner = above.filter("contains(_domain, '.')").join(held, ["_c", "_up"], "left_semi").select("_c", "_domain").distinct()
    domains = own.join(inner, ["_c", "_domain"], "left_anti").withColumn("_in", F.lit(True))
    no_paths = F.array().cast("array<string>")
    sizes = F.array_distinct(F.transform("allowed_domains", lambda d: F.array_size(F.split(d, r"\.", -1))))
    r = rules.select(F.col("crawl_id").alias("_c"), F.col("allow_subdomains").alias("_deep"),
                     F.when(F.coalesce("ignore_paths", F.lit(False)), no_paths).otherwise(F.transform(F.coalesce("excluded_paths", no_paths), F.lower)).alias("_ep"),
                     F.when(F.size("allowed_domains") > 0, sizes).alias("_sizes"))
    p = with_known_parts(urls, url, None, "_a").withColumns({"_host": effective_domain(F.col("_a.host")), "_path": F.lower("_a.path"), "_c": F.col(crawl)}).drop("_a").join(r, "_c", "left")
    host = F.split("_host", r"\.", -1)
    n = F.array_size(host)
    ends = F.transform(F.filter("_sizes", lambda k: (k == n) | ((k < n) & F.col("_deep"))), lambda k: F.array_join(F.slice(host, n - k + 1, k), "."))
    # a crawl without domains asks for no look-up: its one row passes
    asked = p.withColumn("_domain", F.explode(F.when(F.col("_sizes").isNull(), F.array(F.lit(None).cast("string"))).otherwise(ends)))
    barred = F.exists("_ep", lambda e: F.col("_path").startswith(e))
    found = asked.join(domains.select("_c", "_domain", "_in"), ["_c", "_domain"], "left")
    return found.filter(F.col("_sizes").isNull() | (F.col("_in") & ~barred)).select(*urls.columns)


def validate_requests(df: DataFrame, rules: DataFrame, url: str = "url", crawl: str = "crawl_id"):
    """D3: canonicalise without a base; NULL -> INVALID_URL_FORMAT; not allowed -> DOMAIN_NOT_ALLOWED.

    Returns ``(ok, rejects)``; ok carries ``url_canon``; rejects carry ``error_code``.
    """
    c = with_canonical(df, url, None, "url_canon")
    c = with_allowed(c, rules, "url_canon", crawl, "_allowed")
    code = F.when(F.col("url_canon").isNull(), "INVALID_URL_FORMAT").when(~F.col("_allowed"), "DOMAIN_NOT_ALLOWED")
    c = c.withColumn("error_code", code).drop("_allowed")
    return c.filter(F.col("error_code").isNull()).drop("error_code"), c.filter(F.col("error_code").isNotNull())


def classify_outcomes(df: DataFrame) -> DataFrame:
    """``error_code, error_message`` of the first failing step.

    Expects ``url, url_canon`` (NULL = bad URL), booleans ``allowed``,
    ``robots_allowed``, ``extracted`` (extraction succeeded) and ``has_content``
    (E2), ``status`` and optionally ``status_text`` and ``title``. A step whose
    flag or status is NULL did not succeed, so it fails there. Passing rows get NULLs.
    """
    def failed(c):
        return ~F.coalesce(F.col(c), F.lit(False))

    def text(c, default=""):
        return F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)

    code = (F.when(F.col("url_canon").isNull(), "INVALID_URL_FORMAT")
            .when(failed("allowed"), "DOMAIN_NOT_ALLOWED")
            .when(failed("robots_allowed"), "DENIED_BY_ROBOTS_TXT")
            .when(F.coalesce(F.col("status"), F.lit(0)) != 200, "HTTP_ERROR")
            .when(failed("extracted"), "CONTENT_EXTRACTION_FAILED")
            .when(failed("has_content"), "EXTRACTED_CONTENT_FAILED_VERIFICATION"))
    # Message prefixes.
    msg = (F.when(code == "INVALID_URL_FORMAT", F.concat(F.lit("INVALID_URL_FORMAT: "), text("url")))
           .when(code == "DOMAIN_NOT_ALLOWED", F.concat(F.lit("DOMAIN_NOT_ALLOWED: "), F.col("url_canon")))
           .when(code == "DENIED_BY_ROBOTS_TXT", F.concat(F.lit("DENIED_BY_ROBOTS_TXT: "), F.col("url_canon")))
           .when(code == "HTTP_ERROR", F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("")), F.lit(": "), text("status_text")))
           .when(code == "CONTENT_EXTRACTION_FAILED", F.lit("Content extraction failed"))
           .when(code == "EXTRACTED_CONTENT_FAILED_VERIFICATION", F.concat(F.lit("EXTRACTED_CONTENT_FAILED_VERIFICATION: "), text("title"))))
    return df.withColumns({"error_code": code, "error_message": msg})


def drop_empty_documents(docs: DataFrame) -> DataFrame:
    """Keep documents with raw text or at least one paragraph."""
    return docs.filter((F.coalesce(F.col("raw_text"), F.lit("")) != "") | (F.size("paragraphs") > 0))

