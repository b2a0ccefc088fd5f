"""Streams in several micro-batches: late events, restarts, replays, clearing; equal to the batch operators after each batch."""

import datetime as dt
import os
import random


from weft.operators import jobs as J
from weft.sources.keyed import KeyedTable
from weft.streaming import live

SCHEMA = "event_id long, crawl_id long, job_id string, state string, ts timestamp"
T0 = dt.datetime(2024, 1, 2)


def put(spark, root, n, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")


def stream(spark, root, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def events(seed, n, start=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        crawl = 1 if r.random() < 0.4 else r.randint(2, 9)
        out.append((start + i, crawl, f"j{r.randint(0, 25)}", r.choice(live.STATES), T0 + dt.timedelta(minutes=r.randint(0, 50))))
    return out


def same_as_batch(spark, tables, rows):
    e = spark.createDataFrame(rows, SCHEMA)
    latest = J.latest_job_state(e)
    assert tables.queue_stats().collect() == J.queue_stats(latest).collect()
    ids = spark.createDataFrame([(i, T0 + dt.timedelta(days=i), "running") for i in range(12)], "id long, created_at timestamp, status string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(tables.crawl_stats(ids, 8)) == key(J.crawl_stats(ids, latest.select("crawl_id", "job_id", "state"), 8))
    want = J.active_job_counts(e).join(J.final_status(e), "crawl_id", "left").select("crawl_id", "active", "status", "completed_at")
    assert sorted(map(str, tables.active().collect())) == sorted(map(str, want.collect()))


def test_equal_to_batch_after_every_batch_and_restart(spark, tmp_path):
    """Late events (out of order within and across batches, inside the watermark), one query start for each batch."""
    root, rows = str(tmp_path), []
    for n in range(4):
        rows += events(n, 120, 1000 * n)
        put(spark, root, n, rows[-120:])
        query, tables = live.live_jobs(stream(spark, root), f"{root}/out", None, live.NOW)
        query.awaitTermination()
        same_as_batch(spark, tables, rows)


def test_replayed_epoch_changes_nothing(spark, tmp_path):
    tables = live.LiveJobs(spark, str(tmp_path))
    row = [(1, 0, 1, 2, 0, 0, 0, None, None, None)]
    changes = spark.createDataFrame(row, "crawl_id long, " + live._CHANGE)
    tables.apply(changes, 0)
    tables.apply(changes, 1)
    tables.apply(changes, 1)
    assert tables.queue_stats().first().asDict() == {"waiting_count": 2, "active_count": 4, "completed_count": 0, "failed_count": 0}
    assert [(r.total, r.waiting, r.active) for r in tables.by_crawl().collect()] == [(6, 2, 4)]


def test_state_is_cleared_when_crawls_end(spark, tmp_path):
    root, minute = str(tmp_path), dt.timedelta(minutes=1)
    many = [(i, 1, f"j{i}", "active", T0) for i in range(40)]
    done = [(100 + i, 1, f"j{i}", "completed", T0 + minute) for i in range(40)]
    put(spark, root, 0, many)
    put(spark, root, 1, done)
    for n in (2, 3, 4):  # another crawl goes on, and moves the watermark
        put(spark, root, n, [(200 + n, 2, "k", "active", T0 + n * 60 * minute)])
    query, tables = live.live_jobs(stream(spark, root), f"{root}/out", None, live.NOW, late="1 minute", grace_ms=60_000)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > 40 and held[-1] < 15, held
    got = {r.crawl_id: r for r in tables.by_crawl().collect()}
    assert (got[1].total, got[1].status, got[1].completed_at) == (40, "crawled", T0 + minute) and (got[2].open, got[2].status) == (1, None)


def test_feed_has_updates_and_errors(spark, tmp_path):
    root = str(tmp_path)
    jobs = spark.createDataFrame([(1, T0, "running")], "id long, created_at timestamp, status string")
    put(spark, root, 0, [(1, 1, "a", "active", T0), (2, 7, "b", "waiting", T0)])
    put(spark, root, 1, [(3, 1, "a", "failed", T0)])
    query, tables = live.live_jobs(stream(spark, root), f"{root}/out", jobs, live.NOW)
    query.awaitTermination()
    got = sorted((r.v, r.type, r.crawl_id, r.message, r.active, r.failed) for r in tables.feed().collect())
    assert got == [(0, "crawlUpdate", 1, None, 1, 0), (0, "error", 7, "Failed to update crawl 7", None, None), (1, "crawlUpdate", 1, None, 0, 1)]
    sent = []
    tables.publish(spark.createDataFrame([(1,)], "crawl_id long"), jobs.drop("status"), 9, lambda rows, epoch: sent.append((rows.first(), epoch)))
    assert sent[0][0].type == "error" and sent[0][0].message == "Queue update failed" and sent[0][1] == 9


def test_urls_expire(spark, tmp_path):
    root, hour = str(tmp_path), dt.timedelta(hours=1)
    schema = "crawl_id long, url string, ts timestamp"
    for n, rows in enumerate([[(1, "a", T0), (1, "a", T0), (2, "a", T0)], [(1, "a", T0 + hour / 2), (1, "b", T0 + 9 * hour)], [(1, "c", T0 + 9 * hour)], [(1, "a", T0 + 10 * hour)]]):
        put(spark, root, n, rows, schema)
    query = live.dedupe_urls(stream(spark, root, schema), "1 hour").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(**live.NOW).start()
    query.awaitTermination()
    got = sorted((r.crawl_id, r.url) for r in spark.read.schema(schema).parquet(f"{root}/out").collect())
    assert got == [(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "a")]  # the first (1, a) has expired when it comes again


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", ("k",), buckets=8)
    assert t.read().count() == 0 and t.manifest() == (-1, {})
    t.upsert(spark.range(100).selectExpr("concat('k', id) as k", "id as v"), epoch=0)
    before = t.manifest()[1]
    files = {f for f in t.read().inputFiles()}
    assert t.upsert(spark.createDataFrame([("k5", 500), ("new", 1)], "k string, v long"), epoch=3)
    after = t.manifest()
    touched = {b for b in after[1] if after[1][b] != before.get(b)}
    assert after[0] == 3 and 1 <= len(touched) <= 2
    assert files & set(t.read().inputFiles()) and all(os.path.exists(f.removeprefix("file://")) for f in files)
    assert not t.upsert(spark.createDataFrame([("k5", 9)], "k string, v long"), epoch=3)  # a replay
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 101 and got["k5"] == 500 and got["new"] == 1 and got["k7"] == 7
    assert [r.v for r in t.of(spark.createDataFrame([("k9",), ("none",)], "k string")).collect()] == [9]
    t.upsert(spark.createDataFrame([], "k string, v long"))
    assert t.read().count() == 101 and t.manifest()[0] == 4


def test_documents_are_upserted(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, 0, [("c", 1, "u1", 0, "<title>old</title><p>a", T0), ("c", 2, "u2", 0, "<p>b", T0)], live.PAGE_SCHEMA)
    put(spark, root, 1, [("c", 1, "u1", 1, "<title>new</title><p>c", T0), ("c", 3, "u3", 1, "", T0), ("c", 4, "u4", 1, None, T0)], live.PAGE_SCHEMA)
    live.stream_documents(stream(spark, root, live.PAGE_SCHEMA), f"{root}/out", live.NOW).awaitTermination()
    got = sorted((r.url, r.title, r.content_text, r.depth) for r in live.document_table(spark, f"{root}/out").read().collect())
    assert got == [("u1", "new", "c", 1), ("u2", None, "b", 0)]


def test_state_entries_do_not_grow_with_jobs(spark, tmp_path):
    """A call to the state store costs many times what a job does: there is one for each page, not for each job or crawl."""
    root, rows = str(tmp_path), [(i, i % 2500, f"j{i % 5000}", live.STATES[i * 7 % 5], T0 + dt.timedelta(seconds=i % 3000)) for i in range(10_000)]
    for n in range(2):
        put(spark, root, n, rows[n::2])
    query, tables = live.live_jobs(stream(spark, root), f"{root}/out", None, live.NOW)
    query.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
    assert 1000 < max(updated) <= live.PARTS * (live.PAGES + 3), updated
    same_as_batch(spark, tables, rows)
