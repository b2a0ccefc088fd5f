"""Queries on parsed URLs against their oracles in ANSI mode, Spark's own default, which other tests turn off (``get_spark``)."""

import duckdb
import pytest

from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
NAMES = ["canonicalize_urls", "classify_outcomes", "crawl_pages", "crawl_requests", "crawl_requests_rejected", "domain_link_summary",
         "duplicate_url_groups", "filter_allowed", "filter_crawlable", "filter_valid_links", "internal_external_links", "pages_by_domain",
         "robots_allowed", "split_valid_urls", "validate_requests"]


@pytest.fixture
def ansi(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    yield spark
    spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle_in_ansi_mode(ansi, con, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](ansi, SF)
    rows = df.collect()
    cur = con.execute(oracle_sql()[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert rows and sorted(df.columns) == sorted(ocols) and len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


@pytest.mark.parametrize("mode", ["true", "false"])
def test_null_domain_in_either_mode(spark, mode):
    """A NULL among a crawl's domains (a page whose address has no host) matches no host and fails no row."""
    from weft.operators.rules import filter_allowed, make_rules, with_allowed
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", mode)
    try:
        rules = make_rules(spark.createDataFrame([("none", [None]), ("some", [None, "a.com"]), ("free", [])], "crawl_id string, allowed_domains array<string>"))
        urls = spark.createDataFrame([(c, u) for c in ("none", "some", "free", "other") for u in ("http://a.com/x", "http://b.a.com/", "http://c.com/", "not a url", None)],
                                     "crawl_id string, url string")
        got = sorted(map(tuple, filter_allowed(urls, rules).collect()))
        flagged = sorted((r.crawl_id, r.url) for r in with_allowed(urls, rules).filter("allowed").collect())
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    all_three = ["http://a.com/x", "http://b.a.com/", "http://c.com/"]
    assert got == flagged == [(c, u) for c in ("free", "other") for u in all_three] + [("some", u) for u in all_three[:2]]


@pytest.mark.parametrize("mode", ["true", "false"])
@pytest.mark.parametrize("name", ["classify_outcomes", "filter_allowed", "filter_valid_links", "validate_requests"])
def test_matches_oracle_on_odd_page_ids(spark, tmp_path, name, mode):
    """Pages without an id or with a negative one, which belong to no rule set or to one from the end of the list."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from __spark_entry__ import oracle_sql, queries
    pages = pq.read_table(f"{SF}/pages.parquet")
    ids = [None if i == 17 else i if i < 30 else 17 - i for i in range(pages.num_rows)]
    pq.write_table(pages.set_column(0, "page_id", pa.array(ids, pa.int64())), tmp_path / "pages.parquet")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", mode)
    try:
        df = queries()[name](spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    cur = duckdb.connect().execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')").execute(oracle_sql()[name])
    orows, ocols = cur.fetchall(), [d[0] for d in cur.description]
    assert rows and len(rows) == len(orows) and digest(df.columns, rows)[0] == digest(ocols, orows)[0]
