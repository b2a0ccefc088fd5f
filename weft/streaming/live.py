"""Structured Streaming operators.

Job events arrive as a stream (``event_id, crawl_id, job_id, state, ts``). A job
changes state, so counting events overcounts. ``job_changes`` keeps the latest
state of every job in Spark's keyed state and puts out, for what a micro-batch
touched, by how much each count changed. Everything live is built from that:
a table of counts per crawl of which a batch rewrites only the parts it
touches, the queue's totals, and a feed of the crawls that changed. Work per
batch follows the batch, not all jobs ever seen. A replayed batch finds its
epoch committed and changes nothing.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from weft.operators import jobs as J
from weft.session import checkpoint_dir
from weft.sources.keyed import KeyedTable
from weft.sources.tables import job_event_columns, read_pages, read_table

PAGE_SCHEMA = "crawl_id STRING, page_id BIGINT, url STRING, depth INT, html STRING, fetched TIMESTAMP"
STATES = ["waiting", "active", "delayed", "completed", "failed"]
#: Events may be this late; a crawl's jobs are forgotten this long after its last job ended; pieces of a crawl; keys of the state and pages of each.
LATE, GRACE_MS, SALTS, PARTS, PAGES = "1 hour", 24 * 3600 * 1000, 32, 256, 16
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- keyed state -----------------------------------------------------------------------------------

class JobStates(StatefulProcessor):
    """Latest state of the jobs of one part of the key space; puts out how the counts of each piece of a crawl in it changed.

    A call of this function, or one to the state store, costs many times what a job does. So a part holds many pieces (crawl,
    salt), and its state is pages (map) of whole pieces, each page the columns of its jobs; a batch reads and writes a page that
    it touches once for each Arrow batch of rows. An event older than what is known of its job changes nothing.

    A timer clears the pieces without open job that had no event for ``grace_ms`` of event time. A part has one timer at a time,
    so that happens after ``grace_ms`` to twice that; a crawl that goes on later starts again with no jobs, and its counts go on
    from what was put out.
    """

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "crawl array<string>, salt array<int>, job_id array<string>, state array<string>, us array<long>, event_id array<long>")
        self.timer = handle.getValueState("timer", "at long")

    def _load(self, page: int) -> dict[tuple, dict[str, tuple]]:
        """A page as piece -> job -> (state, time, event id)."""
        pieces = {}
        for crawl, salt, job, *known in zip(*(self.pages.getValue((page,)) or ())):
            pieces.setdefault((crawl, salt), {})[job] = tuple(known)
        return pieces

    def _store(self, page: int, pieces: dict[tuple, dict[str, tuple]]) -> None:
        rows = [(*piece, job, *known) for piece, jobs in pieces.items() for job, known in jobs.items()]
        if rows:
            self.pages.updateValue((page,), tuple(map(list, zip(*rows))))
        else:
            self.pages.removeKey((page,))

    @staticmethod
    def _last(jobs: dict[str, tuple]) -> tuple:
        """Time, id and state of the last job to end."""
        return max(((us, job, state) for job, (state, us, _) in jobs.items() if state in J.TERMINAL_STATES), default=(None, None, None))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        before, after, deltas, latest = {}, {}, {}, 0
        for chunk in rows:
            latest = max(latest, int(chunk["us"].max()))
            newest = chunk.sort_values(["page", "us", "event_id"]).drop_duplicates(["crawl", "salt", "job_id"], keep="last")
            events = zip(*(newest[c].tolist() for c in ("page", "crawl", "salt", "job_id", "state", "us", "event_id")))
            for page, here in groupby(events, key=lambda e: e[0]):
                pieces, touched = self._load(page), set()
                for _, crawl, salt, job, state, us, event_id in here:
                    piece = (crawl, salt)
                    jobs = pieces.setdefault(piece, {})
                    if piece not in before:
                        before[piece], deltas[piece] = self._last(jobs), dict.fromkeys(STATES, 0)
                    old = jobs.get(job)
                    if old is not None and (old[1], old[2]) >= (us, event_id):
                        continue
                    jobs[job] = (state, us, event_id)
                    if old is not None:
                        deltas[piece][old[0]] -= 1
                    deltas[piece][state] += 1
                    touched.add(piece)
                if touched:
                    after.update((piece, self._last(pieces[piece])) for piece in touched)
                    self._store(page, pieces)
        if not self.timer.exists():
            self._set_timer(latest // 1000 + self.grace_ms)
        out = sorted((p for p in after if any(deltas[p].values()) or after[p] != before[p]), key=str)
        if out:
            us, job, state = zip(*(after[p] for p in out))
            yield pd.DataFrame({"crawl": [p[0] for p in out], "salt": pd.array([p[1] for p in out], "int32"), **{f"d_{s}": [deltas[p][s] for p in out] for s in STATES},
                                "last_us": pd.array(us, "Int64"), "last_job": list(job), "last_state": list(state)})

    def _set_timer(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        now, due = timerValues.getCurrentWatermarkInMs(), []
        for (page,) in list(self.pages.keys()):
            pieces = self._load(page)
            ends = {p: None if any(k[0] in J.OPEN_STATES for k in jobs.values()) else max(k[1] for k in jobs.values()) // 1000 + self.grace_ms for p, jobs in pieces.items()}
            left = {p: jobs for p, jobs in pieces.items() if ends[p] is None or ends[p] > now}
            if len(left) < len(pieces):
                self._store(page, left)
            due += [ends[p] or now + self.grace_ms for p in left]
        if due:
            self._set_timer(min(due))
        else:
            self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


_CHANGE = "salt int, " + ", ".join(f"d_{s} long" for s in STATES) + ", last_us long, last_job string, last_state string"


def job_changes(events: DataFrame, late: str = LATE, grace_ms: int = GRACE_MS, salts: int = SALTS, parts: int = PARTS, pages: int = PAGES) -> DataFrame:
    """Stream of ``crawl_id, salt, d_<state>..., last_us, last_job, last_state``: for each piece of a crawl that a micro-batch
    touched, the change of its jobs by state, and its last job to end. A crawl is ``salts`` pieces by job id, so that a hot one
    spreads; the pieces of all crawls are dealt to ``parts`` keys of the state with ``pages`` pages each (like the number of
    shuffle partitions fixed for the life of a checkpoint; more pages where many millions of jobs are kept)."""
    crawl = events.schema["crawl_id"].dataType.simpleString()
    keyed = events.select(F.col("crawl_id").cast("string").alias("crawl"), F.pmod(F.xxhash64("job_id"), F.lit(salts)).cast("int").alias("salt"), "job_id", "state",
                          F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    place = F.pmod(F.xxhash64("crawl", "salt"), F.lit(parts * pages)).cast("int")
    keyed = keyed.withColumn("page", place).withColumn("part", F.pmod("page", F.lit(parts)))
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    changes = (keyed.withWatermark("ts", late).groupBy("part")
               .transformWithStateInPandas(JobStates(grace_ms), f"crawl string, {_CHANGE}", "Update", "EventTime"))
    return changes.select(F.col("crawl").cast(crawl).alias("crawl_id"), *changes.columns[1:])


# ---- tables kept by a stream -------------------------------------------------------------------------

def _start(stream: DataFrame, root: str, write: Callable[[DataFrame, int], None], mode: str, trigger: dict | None):
    def once(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            write(batch, epoch)
        finally:
            batch.unpersist()

    return (stream.writeStream.outputMode(mode).foreachBatch(once).option("checkpointLocation", f"{root}/_checkpoint")
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


class LiveJobs:
    """Counts by crawl, queue totals and the feed of a stream of job events, all under one folder."""

    def __init__(self, spark: SparkSession, root: str, crawl_type: str = "long"):
        self.spark, self.root = spark, root
        counts = ", ".join(f"n_{s} long" for s in STATES)
        self.counts = KeyedTable(spark, f"{root}/counts", f"crawl_id {crawl_type}, salt int, {counts}, last_us long, last_job string, last_state string", ("crawl_id",))

    @staticmethod
    def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
        joined = old.alias("o").join(new.alias("n"), ["crawl_id", "salt"], "full_outer")
        counts = [(F.coalesce(f"o.n_{s}", F.lit(0)) + F.coalesce(f"n.d_{s}", F.lit(0))).alias(f"n_{s}") for s in STATES]
        last = [F.when(F.col("n.d_active").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("last_us", "last_job", "last_state")]
        return joined.select("crawl_id", "salt", *counts, *last)

    def apply(self, changes: DataFrame, epoch: int) -> None:
        """One micro-batch of ``job_changes``; a replayed epoch changes nothing."""
        before = self._totals(epoch)
        changed = changes.agg(*(F.coalesce(F.sum(f"d_{s}"), F.lit(0)).alias(s) for s in STATES))
        now = changed.select(*((F.col(s) + F.lit(before[s])).alias(s) for s in STATES))
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/totals/v={epoch}")
        self.counts.upsert(changes, self._merged, epoch)

    def _totals(self, before: int | None = None) -> dict[str, int]:
        try:
            every = self.spark.read.schema(", ".join(f"{s} long" for s in STATES) + ", v long").parquet(f"{self.root}/totals")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return dict.fromkeys(STATES, 0)
        row = (every if before is None else every.filter(F.col("v") < before)).orderBy(F.desc("v")).first()
        return {s: row[s] if row else 0 for s in STATES}

    def queue_stats(self) -> DataFrame:
        """R2: A1 over the latest state of every job, from the totals alone."""
        now = self._totals()
        return self.spark.range(1).select(*(F.lit(now[s]).cast("bigint").alias(f"{s}_count") for s in J.REPORTED_STATES))

    def by_crawl(self, crawls: DataFrame | None = None) -> DataFrame:
        """Per crawl (of all, or of those in ``crawls``): ``total, waiting, active, completed, failed, open, is_complete, status,
        completed_at``; the last two (A10) where no job is open."""
        rows = self.counts.read() if crawls is None else self.counts.of(crawls)
        g = rows.groupBy("crawl_id").agg(*(F.sum(f"n_{s}").alias(s) for s in STATES), F.max_by("last_state", F.struct("last_us", "last_job")).alias("last"),
                                         F.max("last_us").alias("us"))
        total, still = sum((F.col(s) for s in STATES[1:]), F.col(STATES[0])), sum((F.col(s) for s in J.OPEN_STATES[1:]), F.col(J.OPEN_STATES[0]))
        over = (still == 0) & F.col("last").isNotNull()
        return g.select("crawl_id", total.alias("total"), "waiting", "active", "completed", "failed", still.alias("open"), (still == 0).alias("is_complete"),
                        F.when(over, F.when(F.col("last") == "completed", "crawled").otherwise("failed")).alias("status"),
                        F.when(over, F.timestamp_micros("us")).alias("completed_at"))

    def crawl_stats(self, jobs: DataFrame, n: int = 10) -> DataFrame:
        """J5 of the ``n`` newest crawls; only their parts of the counts are read."""
        top = J.recent_jobs(jobs, n).select("id", "status", "created_at")
        return J.crawl_stats_of(top, self.by_crawl(top.select(F.col("id").cast(self.counts.read().schema["crawl_id"].dataType).alias("crawl_id"))))

    def active(self) -> DataFrame:
        """Open jobs per crawl, and for crawls without any the final status (A10)."""
        return self.by_crawl().select("crawl_id", F.col("open").alias("active"), "status", "completed_at")

    # -- S9 --

    def publish(self, changes: DataFrame, jobs: DataFrame, epoch: int, sink: Callable[[DataFrame, int], None] | None = None) -> None:
        """One message for each crawl that the batch touched, to ``sink(rows, epoch)`` or to the feed.

        ``type`` is 'crawlUpdate' with the crawl's statistics (J5), or 'error' with a message: 'Failed to update crawl <id>' for a
        crawl without a job row, 'Queue update failed' if the statistics could not be made; that does not stop the stream.
        """
        try:
            touched = changes.select("crawl_id").distinct()
            own = jobs.join(touched.withColumnRenamed("crawl_id", "id"), "id", "left_semi").select("id", "status", "created_at")
            known = J.crawl_stats_of(own, self.by_crawl(touched)).select(F.lit("crawlUpdate").alias("type"), F.lit(None).cast("string").alias("message"), "*")
            lost = touched.join(own.select(F.col("id").alias("crawl_id")), "crawl_id", "left_anti").select(
                F.lit("error").alias("type"), F.concat(F.lit("Failed to update crawl "), F.col("crawl_id").cast("string")).alias("message"), "crawl_id")
            self._send(known.unionByName(lost, allowMissingColumns=True), epoch, sink)
        except Exception as e:  # the feed may fail, the counts are already committed
            logging.getLogger(__name__).exception("feed of epoch %s", epoch)
            failed = self.spark.createDataFrame([("error", "Queue update failed", str(e)[:500])], "type string, message string, detail string")
            self._send(failed, epoch, sink)

    def _send(self, rows: DataFrame, epoch: int, sink: Callable[[DataFrame, int], None] | None) -> None:
        if sink is not None:
            sink(rows, epoch)
        else:
            rows.write.mode("overwrite").parquet(f"{self.root}/feed/v={epoch}")

    def feed(self) -> DataFrame:
        """Every message so far: ``type, message, crawl_id, total, ..., status, v`` (the epoch)."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/feed")


def live_jobs(events: DataFrame, root: str, jobs: DataFrame | None = None, trigger: dict | None = None, sink: Callable[[DataFrame, int], None] | None = None,
              late: str = LATE, grace_ms: int = GRACE_MS):
    """Keep counts, totals and (with ``jobs``) the feed of a stream of job events under ``root``; returns (query, ``LiveJobs``)."""
    live = LiveJobs(events.sparkSession, root, events.schema["crawl_id"].dataType.simpleString())

    def write(changes: DataFrame, epoch: int) -> None:
        live.apply(changes, epoch)
        if jobs is not None:
            live.publish(changes, jobs, epoch, sink)

    return _start(job_changes(events, late, grace_ms), root, write, "update", trigger), live


def throughput(events: DataFrame, width: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Job events per tumbling window and state (late rows beyond the watermark are dropped)."""
    return (events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "state")
            .agg(F.count("*").cast("bigint").alias("n"))
            .select(F.col("window.start").alias("window_start"), "state", "n"))


def dedupe_urls(urls: DataFrame, expiry: str | None = None) -> DataFrame:
    """Process a URL once per crawl. With ``expiry`` a stream forgets keys after that much event time."""
    if not urls.isStreaming or expiry is None:
        return urls.dropDuplicates(["crawl_id", "url"])
    return urls.withWatermark("ts", expiry).dropDuplicatesWithinWatermark(["crawl_id", "url"])


def document_table(spark: SparkSession, root: str) -> KeyedTable:
    """S10's stored page rows, keyed by (crawl_id, url)."""
    from weft.operators.pages import STORED_SCHEMA
    return KeyedTable(spark, f"{root}/documents", STORED_SCHEMA, ("crawl_id", "url"))


def stream_documents(pages: DataFrame, root: str, trigger: dict | None = None):
    """Extract the documents of each micro-batch of pages (S1, H10, E2) and upsert them (S6) into ``document_table(root)``:
    a page fetched again takes the place of its earlier row."""
    from weft.operators.html import documents
    from weft.operators.pages import latest_by_key, nest_documents
    from weft.operators.rules import drop_empty_documents

    table = document_table(pages.sparkSession, root)

    def write(batch: DataFrame, epoch: int) -> None:
        latest = latest_by_key(read_pages(batch.sparkSession, batch), ("crawl_id", "url"), "fetched")
        table.upsert(nest_documents(drop_empty_documents(documents(latest, keep=("crawl_id", "url", "depth")))), epoch=epoch)

    return _start(pages, root, write, "append", trigger)


# ---- the driver tables as streams, to completion (availableNow) ----------------------------------------

NOW = {"availableNow": True}


def _root(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/weft-stream-{name}/{uuid.uuid4().hex}"


def in_order(df: DataFrame, by: str, root: str, n: int = 4) -> DataFrame:
    """``df`` as a stream of ``n`` micro-batches in the order of ``by``: each slice is written after the one before."""
    spark, cuts = df.sparkSession, [None, *df.select(F.percentile_approx(by, [i / n for i in range(1, n)])).first()[0], None]
    for low, high in zip(cuts[:-1], cuts[1:]):
        part = df if low is None else df.filter(F.col(by) >= F.lit(low))
        part = part if high is None else part.filter(F.col(by) < F.lit(high))
        part.coalesce(1).write.mode("append").parquet(f"{root}/input")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/input")


def job_event_stream(spark: SparkSession, sf_dir: str, root: str, n: int = 4) -> DataFrame:
    """The driver's ``events`` table mapped to job events (as ``sources.tables.job_events``), as a stream of ``n`` batches by time."""
    return in_order(job_event_columns(read_table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp")), "ts", root, n)


def live_jobs_table(spark: SparkSession, sf_dir: str, name: str, jobs: DataFrame | None = None) -> LiveJobs:
    """``live_jobs`` run over all events; jobs are kept until the end, so that counts are those of the whole table."""
    root = _root(spark, name)
    query, live = live_jobs(job_event_stream(spark, sf_dir, root), root, jobs, NOW, grace_ms=3650 * GRACE_MS)
    query.awaitTermination()
    return live


def stream_throughput_table(spark: SparkSession, sf_dir: str, width: str = "5 minutes") -> DataFrame:
    """R5 over the events stream. Update mode: a batch writes the windows it changed; the last one of each counts, and
    the watermark lets Spark drop the state of windows that are over."""
    root = _root(spark, "throughput")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/v={epoch}")

    _start(throughput(job_event_stream(spark, sf_dir, root), width), root, write, "update", NOW).awaitTermination()
    every = spark.read.schema("window_start TIMESTAMP, state STRING, n BIGINT, v INT").parquet(f"{root}/out")
    return every.groupBy("window_start", "state").agg(F.max_by("n", "v").alias("n"))


def stream_unique_urls_table(spark: SparkSession, sf_dir: str, expiry: str | None = "3650 days") -> DataFrame:
    """R3 over the events stream, written by the file sink (exactly once); no key expires within ``expiry`` of event time."""
    root = _root(spark, "urls")
    urls = job_event_stream(spark, sf_dir, root).select("crawl_id", F.col("job_id").alias("url"), "ts")
    (dedupe_urls(urls, expiry).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/_checkpoint")
     .trigger(**NOW).start().awaitTermination())
    return spark.read.schema("crawl_id BIGINT, url STRING, ts TIMESTAMP").parquet(f"{root}/out").select("crawl_id", "url")


def stream_documents_table(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """R6 over page rows in the order of their fetch: the stored documents."""
    root = _root(spark, "documents")
    stream_documents(in_order(pages, "fetched", root), root, NOW).awaitTermination()
    return document_table(spark, root).read()
