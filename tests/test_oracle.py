"""Registered queries against their DuckDB oracles on the smallest driver data."""

import duckdb
import pytest

from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
NAMES = ["queue_stats", "queue_status", "crawl_stats", "reset_summary", "final_status", "within_quota", "retain",
         "fetch_plan", "crawl_frontier", "canonicalize_urls", "pages_by_domain", "filter_allowed", "paragraphs",
         "headings", "anchors", "raw_text", "outlinks", "robots_allowed", "throughput",
         "raw_text_states", "extractors", "write_documents", "crawl_pages", "upsert_outcomes", "job_processing_stats"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF)
    rows = df.collect()
    cur = con.execute(oracle_sql()[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    assert entry(spark).count() > 0
