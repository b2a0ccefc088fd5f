"""Crawl frontier and visited sets.

``crawl_frontier`` is a breadth-first expansion written as a loop of joins.
The visited pages and the links are tables bucketed by (crawl_id, url) in the
shared folder, so a round shuffles only its own candidates: neither side that
grows moves again, and every layer is a written piece that a lost executor
does not recompute.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.jobs import DEFAULT_MAX_DEPTH
from weft.session import checkpoint_dir, written


def crawl_edges(fetched: DataFrame, robots: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The links that a crawl may follow: ``crawl_id, src_url, dst_url`` (canonical), input of ``crawl_frontier``.

    fetched: ``page_id, crawl_id, url, html`` and optionally ``status``. Pages that fail S1, or have neither text nor a paragraph
    (E2), or whose own address robots.txt or the crawl's rules deny (E1), give no links; links are L3's, of the pages that are
    left, without those that robots.txt denies.
    """
    from weft.functions.urls import with_canonical, with_url_parts
    from weft.operators.html import documents
    from weft.operators.links import outlinks
    from weft.operators.robots import robots_allowed
    from weft.operators.rules import drop_empty_documents, filter_allowed
    from weft.sources.tables import read_pages

    docs = drop_empty_documents(documents(read_pages(fetched.sparkSession, fetched), keep=("crawl_id", "url")))
    docs = with_url_parts(with_canonical(docs, "url", None, "src_url"), "src_url", None, "base")  # parsed for the page, not for each link
    links = docs.select("page_id", "crawl_id", "src_url", "base", F.posexplode("links").alias("pos", "l")).select(
        "page_id", "crawl_id", "src_url", "base", "pos", F.col("l.href").alias("href"))
    out = outlinks(links, rules, base="base").filter("src_url IS NOT NULL").select("crawl_id", "src_url", "dst_url")
    if rules is not None:
        out = filter_allowed(out, rules, "src_url")
    out = written(out, "links")
    ends = out.select(F.explode(F.array("src_url", "dst_url")).alias("url")).distinct()
    may = written(robots_allowed(ends, robots).filter("robots_allowed").select("url"), "may")  # each address is looked up once
    return out.join(may.withColumnRenamed("url", "src_url"), "src_url", "left_semi").join(may.withColumnRenamed("url", "dst_url"), "dst_url", "left_semi").select("crawl_id", "src_url", "dst_url")


class _Bucketed:
    """A table bucketed and sorted by (crawl_id, url), in the shared folder; each part added is written once."""

    def __init__(self, name: str, first: DataFrame):
        self.spark = first.sparkSession
        # at least as many buckets as shuffle partitions: then a join shuffles the other side to the buckets
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"weft_{name}_{uuid.uuid4().hex}", f"{checkpoint_dir(self.spark)}/weft-tables/{uuid.uuid4().hex}/{name}"
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "crawl_id", "url").write.bucketBy(self.buckets, "crawl_id", "url").sortBy("crawl_id", "url").option("path", self.path)
         .mode("append").saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def crawl_frontier(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``crawl_id, url, depth, parent_url`` of every page reached from the seeds.

    seeds: ``crawl_id, url[, max_depth]``; edges: ``crawl_id, src_url, dst_url``
    (links of successfully fetched pages, kept by the crawl's own rules: ``crawl_edges``).
    Depth is the BFS (minimum) depth; the parent is the smallest URL of the previous layer
    linking to the page; a page reached once never changes. Expansion stops at the
    crawl's ``max_depth`` (default 3), further limited by the argument where given,
    or when a layer is empty.
    """
    own = F.col("max_depth") if "max_depth" in seeds.columns else F.lit(None)
    limit = F.coalesce(own, F.lit(max_depth), F.lit(DEFAULT_MAX_DEPTH)).cast("int")
    if max_depth is not None:
        limit = F.least(limit, F.lit(max_depth))
    columns = ["crawl_id", "url", "depth", "parent_url", "max_depth"]
    limits = seeds.groupBy("crawl_id").agg(F.max(limit).alias("max_depth"))
    start = seeds.select("crawl_id", "url").distinct().join(limits, "crawl_id").select(
        "crawl_id", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), "max_depth")
    links = _Bucketed("links", edges.select("crawl_id", F.col("src_url").alias("url"), F.col("dst_url").alias("_dst")).distinct())
    visited, depth = _Bucketed("visited", start), 0
    layer = visited.read()
    while True:
        cand = layer.filter(F.col("depth") < F.col("max_depth")).join(links.read(), ["crawl_id", "url"]).select("crawl_id", F.col("_dst").alias("url"), F.col("url").alias("parent_url"), "max_depth")
        depth += 1
        layer = (cand.groupBy("crawl_id", "url").agg(F.min("parent_url").alias("parent_url"), F.first("max_depth").alias("max_depth"))
                 .join(visited.read().select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")
                 .select("crawl_id", "url", F.lit(depth).alias("depth"), "parent_url", "max_depth").select(*columns))
        layer = written(layer, "layer")  # a table cannot be appended to while it is read
        if layer.isEmpty():
            return visited.read().drop("max_depth")
        visited.add(layer)


def unvisited(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """URLs not yet in the crawl's visited set (anti-join on crawl_id, url)."""
    return urls.join(visited.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")


def is_visited(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """Add ``visited`` (membership flag per URL)."""
    v = visited.select("crawl_id", "url").distinct().withColumn("visited", F.lit(True))
    return urls.join(v, ["crawl_id", "url"], "left").withColumn("visited", F.coalesce("visited", F.lit(False)))


def mark_visited(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """Add URLs to the visited set (set union)."""
    return visited.select("crawl_id", "url").unionByName(urls.select("crawl_id", "url")).distinct()


def visited_count(visited: DataFrame) -> DataFrame:
    """T4: ``crawl_id, visited`` (exact distinct count per crawl)."""
    return visited.groupBy("crawl_id").agg(F.count_distinct("url").cast("bigint").alias("visited"))


def visited_sketches(visited: DataFrame, lg_k: int = 12) -> DataFrame:
    """T4, approximate: ``crawl_id, sketch``, a mergeable HyperLogLog sketch of each crawl's URLs (2^lg_k registers)."""
    return visited.groupBy("crawl_id").agg(F.hll_sketch_agg("url", lg_k).alias("sketch"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """Sketches of several rounds or tables as one for each crawl; their order does not matter, and URLs in several count once."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.groupBy("crawl_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def approximate_visited_count(sketches: DataFrame) -> DataFrame:
    """T4: ``crawl_id, visited`` estimated from sketches; the standard error is 1.04 / sqrt(2^lg_k), 1.6 % by default."""
    return sketches.select("crawl_id", F.hll_sketch_estimate("sketch").alias("visited"))


def fetch_offsets(outl: DataFrame, src: str = "src_url", spacing_ms: int = 100) -> DataFrame:
    """The n-th new link of a page (n from 0) is delayed n x 100 ms; priority from the parent (default 1)."""
    w = Window.partitionBy(src).orderBy("pos", "dst_url")
    prio = F.coalesce(F.col("priority"), F.lit(1)) if "priority" in outl.columns else F.lit(1)
    return outl.withColumns({
        "delay_ms": ((F.row_number().over(w) - 1) * spacing_ms).cast("bigint"),
        "priority": prio.cast("int"),
    })


def fetch_plan(frontier: DataFrame, rate: int = 20, partitions: int | None = None) -> DataFrame:
    """Global start plan: at most ``rate`` starts per second, higher priority first.

    The global rank is computed without a single-partition window: rows are
    range-partitioned and sorted by (priority desc, depth, crawl_id, url); each
    partition's row count is aggregated (one row per partition), prefix-summed
    and joined back (a table bounded by the partition count), and the rank is
    offset + position within the partition. Adds ``rank`` (from 0) and ``start_ms``.
    """
    checkpoint_dir(frontier.sparkSession)
    prio = F.coalesce(F.col("priority"), F.lit(1)) if "priority" in frontier.columns else F.lit(1)
    df = frontier.withColumn("priority", prio.cast("int"))
    keys = [F.col("priority").desc(), F.col("depth").asc(), F.col("crawl_id").asc(), F.col("url").asc()]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) \
        .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).checkpoint()
    counts = ordered.groupBy("_pid").agg(F.count("*").alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ordered.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
    rank = (F.col("_off") + F.col("_local")).cast("bigint")
    return out.withColumn("rank", rank).withColumn("start_ms", (F.floor(rank / rate) * 1000).cast("bigint")) \
        .drop("_pid", "_mid", "_local", "_off")
