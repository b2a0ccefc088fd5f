"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is fully executed with the no-op sink (every column computed).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

COPIES = 20  # pages of the larger extraction runs: so many times the table's


def many_pages(spark, sf_dir):
    """The pages table ``COPIES`` times, as a throughput run (50,000 pages at sf0.1)."""
    from pyspark.sql import functions as F
    from weft.sources.tables import read_pages
    pages = read_pages(spark, f"{sf_dir}/pages.parquet").repartition(64)
    return pages.withColumn("page_id", F.explode(F.sequence(F.col("page_id") * COPIES, F.col("page_id") * COPIES + COPIES - 1)))


def documents_many(spark, sf_dir):
    from weft.operators.html import documents
    return documents(many_pages(spark, sf_dir))


def outlinks_many(spark, sf_dir):
    from weft.operators.links import outlinks, page_links
    return outlinks(page_links(many_pages(spark, sf_dir)))


EXTRA = {"documents_x20": documents_many, "outlinks_x20": outlinks_many}
HEADLINE = ["domain_link_summary", "documents", "canonicalize_urls", "page_stats", "outlinks", "robots_allowed",
            "crawl_stats", "queue_status", "within_quota", "final_status", "crawl_frontier", "fetch_plan", "crawl_pages", "track_active", "upsert_outcomes", *EXTRA]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from weft.plans.catalog import QUERIES
    from weft.session import get_spark
    spark = get_spark("weft-bench", cpus=cpus)
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.time()
        {**QUERIES, **EXTRA}[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
