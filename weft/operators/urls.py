"""URL table operators (U1-U8): validity, canonical form, resolution, crawlability, domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.urls import effective_domain, with_canonical, with_resolved, with_url_parts, with_validity

# File extensions that are never crawled (U4), and the frontier's media filter.
NON_CRAWLABLE_EXT = ["jpg", "jpeg", "png", "gif", "ico", "pdf", "doc", "docx", "xls", "xlsx", "zip", "tar", "gz",
                     "exe", "css", "js", "json", "xml", "txt", "map", "mp3", "mp4", "avi", "mov", "wmv", "wav",
                     "webm", "ttf", "woff", "woff2", "eot"]
MEDIA_EXT = ["jpg", "jpeg", "png", "gif", "pdf", "zip", "exe"]


def split_valid_urls(df: DataFrame, url: str = "url"):
    """``(valid, rejects)``; a URL is valid iff it parses as an absolute URL on its own."""
    v = with_validity(df, url, "_valid")
    return v.filter(F.col("_valid")).drop("_valid"), v.filter(~F.col("_valid")).drop("_valid")


def canonicalize_urls(df: DataFrame, url: str = "url", base: str | Column | None = None,
                      out: str = "url_canon") -> DataFrame:
    """Add ``out`` = canonical URL (NULL when it does not parse)."""
    return with_canonical(df, url, base, out)


def resolve_links(df: DataFrame, href: str = "href", base: str | Column | None = "base",
                  out: str = "url_abs") -> DataFrame:
    """Add ``out`` = ``href`` resolved against ``base`` (WHATWG serialisation)."""
    return with_resolved(df, href, base, out)


def filter_crawlable(df: DataFrame, url: str = "url") -> DataFrame:
    """U4: http(s) URLs whose path does not end (any case) in a non-crawlable extension."""
    p = with_url_parts(df, url, None, prefix="_k")
    ext = "|".join(NON_CRAWLABLE_EXT)
    keep = (F.col("_k.ok") & F.col("_k.scheme").isin("http", "https")
            & ~F.col("_k.path").rlike(rf"(?i)\.({ext})$"))
    return p.filter(keep).drop("_k")


def filter_media_links(df: DataFrame, url: str = "url") -> DataFrame:
    """Drop URLs whose whole text (query and fragment included) ends in a media extension."""
    ext = "|".join(MEDIA_EXT)
    return df.filter(~F.coalesce(F.col(url).rlike(rf"(?i)\.({ext})$"), F.lit(False)))


def with_domain(df: DataFrame, url: str = "url", out: str = "domain") -> DataFrame:
    """Add ``out`` = effective domain of ``url`` (host, lower-case, one ``www.`` removed; NULL if invalid)."""
    known = F.when(F.col("_d.ok") & F.col("_d.hasauth"), effective_domain(F.col("_d.host")))
    return with_url_parts(df, url, None, "_d").withColumn(out, F.nullif(known, F.lit(""))).drop("_d")


def pages_by_domain(pages: DataFrame, url: str = "url") -> DataFrame:
    """``domain, pages`` -- pages per effective domain."""
    return with_domain(pages.select(url), url).groupBy("domain").agg(F.count("*").cast("bigint").alias("pages"))


def internal_external_links(links: DataFrame, src: str = "src_url", dst: str = "dst_url") -> DataFrame:
    """Per source domain, links to the same effective domain (internal) and to others (external).

    Both domains must be known and equal; NULL or empty counts as external.
    """
    d = with_domain(with_domain(links.select(src, dst), src, "src_domain"), dst, "dst_domain")
    same = F.coalesce(F.col("src_domain") == F.col("dst_domain"), F.lit(False))
    return d.groupBy("src_domain").agg(F.count_if(same).cast("bigint").alias("internal"),
                                       F.count_if(~same).cast("bigint").alias("external"))


def duplicate_url_groups(pages: DataFrame, url: str = "url") -> DataFrame:
    """U8: raw URLs that share a canonical URL: ``url_canon, n_urls, first_page_id``."""
    c = canonicalize_urls(pages.select("page_id", url), url)
    return c.groupBy("url_canon").agg(F.count("*").cast("bigint").alias("n_urls"),
                                      F.min("page_id").alias("first_page_id"))

