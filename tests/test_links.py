"""Links resolved against their page's address, which is parsed once for the page."""

from weft.operators import links as L

SF = "/root/testdata/sf0.001"
ANCHORS = "".join(f'<a href="{h}">t</a>' for h in ("/a", "b?y=2&x=1", "../c", "//Other.org/d", "#f", "?q", "http://x.org/e.pdf", "mailto:a@b.c", "https:g", "b?x=1&y=2", "http://"))
URLS = ["http://www.Site.org:80/dir/page?z=1#top", "https://site.org", "http://[bad", "", None, "mailto:someone@site.org", "http://bücher.de/x/"]


def test_base_of_the_page_gives_the_same_outlinks(spark):
    pages = spark.createDataFrame([(i, u, ANCHORS) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    rows = lambda df: sorted(map(tuple, df.select("page_id", "src_url", "pos", "href", "text", "dst_url").collect()), key=repr)
    carried = L.outlinks(L.page_links(L.with_base(pages), keep=("base",)), base="base")
    alone = L.outlinks(L.page_links(pages))
    assert carried.columns == alone.columns
    got = rows(carried)
    assert got == rows(alone)
    found = {(r[0], r[5]) for r in got}
    assert (0, "http://site.org/dir/b?x=1&y=2") in found and (0, "http://site.org/c") in found and (2, "mailto:a@b.c") in found
    assert len(got) == len(found)


def test_link_summary_reads_the_pages_once(spark):
    from __spark_entry__ import queries
    plan = queries()["domain_link_summary"](spark, SF)._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    assert sum("html" in leaves.apply(i).toString() for i in range(leaves.size())) == 1


def test_crawl_edges_parse_the_address_for_the_page(spark, monkeypatch):
    from weft.operators import frontier as FR
    pages = spark.createDataFrame([(i, "c", u, f"<p>text</p>{ANCHORS}", 200) for i, u in enumerate(URLS) if u], "page_id long, crawl_id string, url string, html string, status int")
    robots = spark.createDataFrame([], "origin string, body string")
    bases, outlinks = [], L.outlinks
    monkeypatch.setattr(L, "outlinks", lambda links, *args, **named: bases.append(named.get("base")) or outlinks(links, *args, **named))
    monkeypatch.setattr("weft.operators.robots.robots_allowed", lambda urls, _: urls.selectExpr("*", "true AS robots_allowed"))
    got = {tuple(r) for r in FR.crawl_edges(pages, robots).collect()}
    links = outlinks(L.page_links(pages.filter("html <> ''")))
    known = L.with_canonical(links, "src_url", None, "src").filter("src IS NOT NULL")
    assert got == {("c", r.src, r.dst_url) for r in known.select("src", "dst_url").collect()}
    assert ("c", "http://site.org/dir/page?z=1#top", "http://site.org/c") in got
    assert bases == ["base"]
