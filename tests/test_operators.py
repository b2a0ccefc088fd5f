"""Small cases of operators whose oracles run on the driver tables only."""

import datetime as dt

import pytest

from weft.operators import frontier, jobs, pages, robots


def test_robots_spelling(spark):
    urls = spark.createDataFrame([(u,) for u in ("http://a.com/private/x", "http://a.com/f%c3%bcr", "http://a.com/ok", "http://a.com/x/y.pdf", "http://a.com/x/y.pdf?z",
                                                  "http://b.com/p", "http://c.com/any")], "url string")
    files = spark.createDataFrame([("http://a.com", "\ufeffUser-agent:\t*\nDisallow:\t/private\nDisallow: /f\u00fcr\nDisallow: /*/*.pdf$ # c\nAllow: /private/y"),
                                   ("http://b.com", "User-agent: *\nDisallow: /p\nAllow: /p")], "origin string, body string")
    got = {r.url: r.robots_allowed for r in robots.robots_allowed(urls, files).collect()}
    assert [u for u, ok in got.items() if not ok] and {u for u, ok in got.items() if not ok} == {"http://a.com/private/x", "http://a.com/f%c3%bcr", "http://a.com/x/y.pdf"}


def test_frontier_keeps_crawls_apart(spark):
    seeds = spark.createDataFrame([("c1", "a", None), ("c2", "a", 1)], "crawl_id string, url string, max_depth int")
    edges = spark.createDataFrame([("c1", "a", "b"), ("c1", "b", "c"), ("c1", "c", "d"), ("c1", "d", "e"), ("c2", "a", "x"), ("c2", "x", "y"), ("c1", "c", "a")], "crawl_id string, src_url string, dst_url string")
    got = sorted((r.crawl_id, r.url, r.depth) for r in frontier.crawl_frontier(seeds, edges).collect())
    assert got == [("c1", "a", 0), ("c1", "b", 1), ("c1", "c", 2), ("c1", "d", 3), ("c2", "a", 0), ("c2", "x", 1)]


def test_quota_keeps_repeated_rows(spark):
    t = dt.datetime(2024, 1, 2)
    events = spark.createDataFrame([(1, "u", t), (1, "u", t), (1, "v", t), (2, "w", t)], "user_id long, url string, ts timestamp")
    out = jobs.within_quota(events, spark.createDataFrame([(1, 2)], "user_id long, monthly_quota int")).collect()
    assert len(out) == 4 and sorted(r.n or 0 for r in out) == [0, 0, 1, 2]


def test_update_sets_only_what_is_given(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    table = spark.createDataFrame([(1, "running"), (2, "running")], "id long, status string")
    changes = spark.createDataFrame([(1, "crawled", t[0], t[0]), (1, "stopped", None, t[1])], "id long, status string, completed_at timestamp, ts timestamp")
    got = {r.id: (r.status, r.completed_at) for r in jobs.update_jobs(table, changes).collect()}
    assert got == {1: ("stopped", t[0]), 2: ("running", None)}


def test_job_by_id_is_one_row(spark):
    table = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert jobs.job_by_id(table, 1).count() == 1
    for missing in (2, 3):
        with pytest.raises(LookupError):
            jobs.job_by_id(table, missing)


def test_upsert_answers(spark):
    t = dt.datetime(2024, 1, 2)
    target = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], "crawl_id string, url string, v int")
    new = spark.createDataFrame([("c", "b", 3, t), ("c", "x", 4, t), ("c", "x", 5, t + dt.timedelta(1))], "crawl_id string, url string, v int, ts timestamp")
    out = pages.upsert_pages(target, new)
    assert sorted((r.url, r.v, r.inserted) for r in out.collect()) == [("a", 1, False), ("b", 3, False), ("x", 5, True)]


def test_upsert_counts_earlier_charges(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)] + [dt.datetime(2024, 2, 1)]
    jobs_ = spark.createDataFrame([("c", 9), ("d", 9), ("e", 8)], "id string, user_id long")
    quotas = spark.createDataFrame([(9, 2)], "user_id long, monthly_quota int")
    target = spark.createDataFrame([("c", "a", t[0])], "crawl_id string, url string, ts timestamp")
    new = spark.createDataFrame([("c", "a", t[4]), ("c", "x", t[2]), ("c", "x", t[3]), ("d", "y", t[5]), ("d", "z", t[8]), ("e", "q", t[1]), ("gone", "w", t[1])], target.schema)
    got = sorted((r.crawl_id, r.url, r.inserted, r.quota_exceeded, r.pages_remaining) for r in pages.upsert_outcomes(target, new, jobs_, quotas).collect())
    assert got == [("c", "a", False, False, 1), ("c", "x", True, False, 0), ("d", "y", False, True, 0), ("d", "z", True, False, 1), ("e", "q", False, True, 0)]
    one = spark.createDataFrame([("c", "n", t[6])], target.schema)
    quota1 = spark.createDataFrame([(9, 1)], "user_id long, monthly_quota int")
    assert [(r.inserted, r.quota_exceeded) for r in pages.upsert_outcomes(target, one, jobs_, quota1).collect()] == [(False, True)]
    assert [(r.inserted, r.quota_exceeded) for r in pages.upsert_outcomes(target.limit(0), one, jobs_, quota1).collect()] == [(True, False)]


def test_visited_side_does_not_move(spark):
    seeds = spark.createDataFrame([("c", f"u{i}") for i in range(5)], "crawl_id string, url string")
    first = frontier._Bucketed("visited", seeds.selectExpr("crawl_id", "url", "0 as depth"))
    first.add(spark.createDataFrame([("c", "u9", 1)], "crawl_id string, url string, depth int"))
    cand = spark.createDataFrame([("c", "u1"), ("c", "u7")], "crawl_id string, url string").hint("merge")
    left = cand.groupBy("crawl_id", "url").count().join(first.read().select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")
    assert [r.url for r in left.collect()] == ["u7"]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan and "Bucketed: true" in plan and plan.split("== Initial Plan ==")[0].count("Exchange") == 1  # that of the candidates' own groups


def test_many_domains_and_rules_are_looked_up(spark):
    many = [f"site{i}.example{i % 7}.org" for i in range(20_000)] + ["co.uk", "b.co.uk"]
    rule = spark.createDataFrame([("m", many, True, False, ["/Admin"]), ("s", ["a.com", "x.a.com"], False, False, []), ("f", [], True, False, ["/x"])],
                                 "crawl_id string, allowed_domains array<string>, allow_subdomains boolean, ignore_paths boolean, excluded_paths array<string>")
    cases = [("m", "http://site7.example0.org/", True), ("m", "http://www.deep.site7.example0.org/q", True), ("m", "http://site7.example1.org/", False), ("m", "http://z.b.co.uk/", True),
             ("m", "http://co.uk/admin/x", False), ("m", "http://org/", False), ("s", "http://a.com/", True), ("s", "http://y.a.com/", False), ("s", "http://x.a.com/", True), ("f", "http://any.net/x", True),
             ("none", "http://q.net/", True), ("m", "no url", False), (None, "http://q.net/", True)]
    urls = spark.createDataFrame([(c, u) for c, u, _ in cases] * 2, "crawl_id string, url string")
    from weft.operators import rules
    want = sorted([(c or "", u) for c, u, ok in cases if ok] * 2)
    assert sorted((r.crawl_id or "", r.url) for r in rules.filter_allowed(urls, rule).collect()) == want
    assert sorted((r.crawl_id or "", r.url) for r in rules.with_allowed(urls, rule).filter("allowed").collect()) == want
    body = "User-agent: *\n" + "\n".join(f"Disallow: /p{i}/*/x{i}$" for i in range(5000)) + "\nDisallow: /p1/\nAllow: /p1/ok*\nDisallow: /*.bad\nAllow: /"
    files = spark.createDataFrame([("http://a.com", body)], "origin string, body string")
    asked = {"http://a.com/p7/q/x7": False, "http://a.com/p7/q/x7/": True, "http://a.com/p1/no": False, "http://a.com/p1/okay": True, "http://a.com/z.bad?x": False, "http://a.com": True, "http://b.com/p1/": True,
             "no url": True}
    got = robots.robots_allowed(spark.createDataFrame([(u,) for u in [*asked, *asked]], "url string"), files).collect()
    assert len(got) == 2 * len(asked) and {r.url: r.robots_allowed for r in got} == asked


def test_sketches_merge_in_any_order(spark):
    rounds = [spark.range(i * 3000, i * 3000 + 6000).selectExpr("cast(id % 2 as string) as crawl_id", "concat('u', id) as url") for i in range(4)]
    sketches = [frontier.visited_sketches(r) for r in rounds]
    counts = [sorted((r.crawl_id, r.visited) for r in frontier.approximate_visited_count(frontier.merge_sketches(*order)).collect()) for order in (sketches, sketches[::-1])]
    assert counts[0] == counts[1]
    assert all(abs(n - 7500) <= 0.08 * 7500 for _, n in counts[0])


def test_metadata_fields(spark):
    t = dt.datetime(2024, 1, 2)
    rows = [(1, 1, "a", "waiting", t, '{"url": "u", "n": {"deep": [1, 2]}}'), (2, 1, "a", "active", t + dt.timedelta(1), None), (3, 1, "b", "active", t, "{no json"), (4, 1, "c", "completed", t, "{}")]
    e = spark.createDataFrame(rows, "event_id long, crawl_id long, job_id string, state string, ts timestamp, metadata string")
    got = {r.job_id: (r.added_at, r.u, r.d) for r in jobs.active_jobs(e).selectExpr("job_id", "added_at", "try_variant_get(metadata, '$.url', 'string') u", "try_variant_get(metadata, '$.n.deep[1]', 'int') d").collect()}
    assert got == {"a": (t, "u", 2), "b": (t, None, None)}
