"""Link graph operators (L1-L4).

Links come out of the page's own fold, with the page's address, so the HTML is
neither shuffled nor joined. A canonical URL is one expression, computed once
by a generator that also drops what does not parse; only the link rows that
are left move, for the first occurrence within a page. A page's own address
can be parsed once for the page and carried by its links (``with_base``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.urls import with_canonical, with_known_canonical, with_url_parts
from weft.operators.html import anchors
from weft.operators.rules import filter_allowed
from weft.operators.urls import filter_media_links


def with_base(df: DataFrame, url: str = "url", out: str = "base") -> DataFrame:
    """Add ``out``: the canonical form of ``url``, parsed, which L3 resolves hrefs against."""
    return with_url_parts(with_canonical(df, url, None, "_page_canon"), "_page_canon", None, out).drop("_page_canon")


def page_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """L1: ``page_id, src_url, pos, href, text`` (anchors with non-empty href and text), and the page's columns named by ``keep``."""
    a = anchors(pages, keep=("url", *keep))
    return a.select("page_id", F.col("url").alias("src_url"), "pos", "href", "text", *keep)


def filter_valid_links(links: DataFrame, rules: DataFrame | None = None, base: str = "src_url",
                       crawl: str = "crawl_id") -> DataFrame:
    """L2: keep anchors whose href canonicalises against ``base`` (the original job URL)
    and, with rules, is allowed; the stored href stays raw."""
    c = with_known_canonical(links, "href", base, "_canon")
    if rules is not None:
        c = filter_allowed(c, rules, "_canon", crawl)
    return c.drop("_canon")


def outlinks(links: DataFrame, rules: DataFrame | None = None, src: str = "src_url", crawl: str = "crawl_id",
             depth: str | None = None, max_depth: str | None = None, base: str | None = None) -> DataFrame:
    """L3: next-depth URLs of each page.

    Only pages with depth < max_depth (when given) expand. The href is
    canonicalised against the *canonical* page URL; NULLs dropped; the first
    occurrence per page (of a crawl, where links name it) is kept; then domain rules and the media filter.
    Adds ``dst_url``. ``base`` names the column of ``with_base``, where links carry it from their page (it is dropped);
    without it, the page URL is parsed for each link.
    """
    df = links
    if depth is not None and max_depth is not None:
        df = df.filter(F.col(depth) < F.col(max_depth))
    if base is None:
        base, df = "_base", with_base(df, src, "_base")
    df = with_known_canonical(df, "href", base, "dst_url", parsed_base=True).drop(base)
    w = Window.partitionBy(*(c for c in (crawl,) if c in df.columns), "page_id", "dst_url").orderBy("pos")
    df = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    if rules is not None:
        df = filter_allowed(df, rules, "dst_url", crawl)
    return filter_media_links(df, "dst_url")


def renormalize(links: DataFrame, url: str = "dst_url") -> DataFrame:
    """L4: canonicalise once more with no base (drops NULLs); only stacked ``www.www.`` hosts change."""
    return with_known_canonical(links, url, None, "_again").withColumn(url, F.col("_again")).drop("_again")
