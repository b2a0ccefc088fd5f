"""Sharding by minimax contiguous partition.

Atomic groups (rows with equal group key) stand in a fixed order; the smallest capacity for which a greedy left-to-right
filling needs no more than the wanted number of shards is found by binary search, and the order is cut there.

Only a bounded summary is ever on the driver. The key space is first cut into equal slices. A cut can fall
only into a few slices: for any capacity between the two bounds known so far, the k-th cut lies between the greedy cut of
the lower bound (slices whole) and that of the upper bound (slices divisible). Those slices are summarised again at a finer
step, until the slices in question are single groups; then the search is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: First slices, and finer slices of one slice.
FIRST_BITS, FINER_BITS = 12, 6
KEY_BITS = 64


class Slices:
    """Ordered slices of the key space: first key, key bits left, bytes, groups, largest group."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)
        self.at = [0]
        for r in self.rows:
            self.at.append(self.at[-1] + r[2])

    def whole(self, capacity: int, shards: int) -> list[int]:
        """Greedy cuts (byte positions) that keep slices whole; stops early where a slice is larger than the capacity."""
        cuts, at = [], 0
        for _ in range(shards):
            i = bisect_right(self.at, at + capacity) - 1
            at = max(at, self.at[i])
            cuts.append(at)
        return cuts

    def divisible(self, capacity: int, shards: int) -> list[int]:
        """Greedy cuts that may divide any slice of several groups at any byte: never before the true greedy cuts."""
        cuts, at = [], 0
        for _ in range(shards):
            to = min(at + capacity, self.at[-1])
            i = bisect_right(self.at, to) - 1
            if i < len(self.rows) and self.rows[i][3] == 1:
                to = max(at, self.at[i])
            cuts.append(at := to)
        return cuts

    def smallest(self, low: int, high: int, shards: int, greedy) -> int:
        """The smallest capacity in [low, high] for which the greedy filling ends within the shards."""
        while low < high:
            mid = (low + high) // 2
            if greedy(mid, shards)[-1] >= self.at[-1]:
                high = mid
            else:
                low = mid + 1
        return low


def _summary(groups: DataFrame, first, bits: int) -> list[tuple[int, int, int, int, int]]:
    """At most 2**FIRST_BITS rows, or 2**FINER_BITS for each slice asked for; keys are counted from 0 here."""
    out = groups.groupBy(F.col("place").bitwiseAND(F.lit(-1 << bits if bits < 63 else 0)).alias("first")) if first is None else first
    return [((r.first) & (1 << 64) - 1, bits, r.bytes, r.groups, r.most) for r in out.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("most")).collect()]


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys (unsigned) at which shards 1.. begin, and the smallest feasible capacity, of groups (place, bytes).

    ``place`` is the group's signed 64-bit key, ordered here as unsigned.
    """
    bits = KEY_BITS - FIRST_BITS
    s = Slices(_summary(groups, None, bits))
    if not s.rows:
        return [], 0
    while True:
        total, most = s.at[-1], max(r[4] for r in s.rows)
        low = s.smallest(max(most, -(-total // shards)), total, shards, s.divisible)
        high = s.smallest(max(r[2] for r in s.rows), total, shards, s.whole)
        # every capacity from low to high puts its k-th cut between these two positions; balanced cuts lie before them
        early, late = s.whole(low, shards), s.divisible(high, shards)
        fair = [total * (k + 1) // shards for k in range(shards)]
        open_, slack = set(), 2 * max(r[2] for r in s.rows if r[3] > 1) if any(r[3] > 1 for r in s.rows) else 0
        for k in range(shards - 1):
            lo, hi = min(early[k], fair[k] - slack), max(late[k], fair[k] + slack)
            for i in range(max(0, bisect_right(s.at, lo) - 1), min(len(s.rows), bisect_left(s.at, hi) + 1)):
                if s.rows[i][3] > 1 and s.rows[i][1] > 0:
                    open_.add(i)
        if not open_:
            break
        step = {}
        for i in open_:
            step.setdefault(s.rows[i][1], []).append(s.rows[i][0])
        rows = [r for i, r in enumerate(s.rows) if i not in open_]
        for bits, firsts in step.items():
            finer = max(0, bits - FINER_BITS)
            signed = [f - (1 << 64) if f >> 63 else f for f in firsts]
            mask, fine = -1 << bits, -1 << finer
            inside = groups.filter(F.col("place").bitwiseAND(F.lit(mask)).isin(signed))
            rows += _summary(groups, inside.groupBy(F.col("place").bitwiseAND(F.lit(fine)).alias("first")), finer)
        s = Slices(rows)
    capacity = s.smallest(max(most, -(-total // shards)), total, shards, s.whole)
    return _balanced(s, capacity, shards), capacity


def _balanced(s: Slices, capacity: int, shards: int) -> list[int]:
    """Cuts for the smallest capacity, each as near to an equal share of what is left as the capacity allows.

    The greedy cuts are the latest ones possible, greedy cuts from the right the earliest; any cut between them that is
    within the capacity of the one before keeps the rest feasible.
    """
    latest = s.whole(capacity, shards)
    earliest, at = [0] * shards, s.at[-1]
    for k in range(shards - 1, 0, -1):
        at = s.at[bisect_left(s.at, max(0, at - capacity))]
        earliest[k - 1] = at
    keys, at, end = [], 0, s.at[-1]
    for k in range(shards - 1):
        want = at + (end - at) / (shards - k)
        i = bisect_left(s.at, want)
        near = min((s.at[j] for j in (i - 1, i) if 0 <= j < len(s.at)), key=lambda x: abs(x - want))
        at = max(earliest[k], min(near, latest[k], s.at[bisect_right(s.at, at + capacity) - 1]))
        i = bisect_left(s.at, at)
        keys.append(s.rows[i][0] if i < len(s.rows) else 1 << 64)
    return keys


def assign(spark: SparkSession, docs: DataFrame, shards: int, text: str = "text", id_col: str = "doc_id", overhead: int = 16,
           rows_per_bucket: int = 500_000) -> DataFrame:
    """Every row's shard and place in it: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size: UTF-8 bytes of the text plus ``overhead``; a null text has none and is a group of its own. Rows with equal texts
    are one atomic group (equality by 64-bit hash: a collision would only join two groups). Shard loads are as equal as
    whole groups allow: no contiguous cut of the order has a smaller largest shard. Repeated rows, null ids and ties are
    rows like any other; an empty table gives no rows; other columns are ignored.
    slot: rows of a shard are numbered from 0 without gaps. They are dealt to buckets by a hash of the row and of its place in
    the table, so a shard of one hot group, or of one row that repeats, is still numbered by many tasks. Whole texts are read.
    """
    body = F.col(text)
    rows = written(spark, docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(F.coalesce(body, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.when(body.isNull(), F.lit(0)).otherwise(F.xxhash64(body)).alias("place"),
        F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("part")), "rows")
    groups = written(spark, rows.groupBy("place").agg(F.sum("size").alias("bytes")), "groups")
    keys, _ = cut_keys(groups, shards)
    # unsigned order of the signed key: flip the sign bit
    flipped = F.col("place").bitwiseXOR(F.lit(-(1 << 63)))
    shard = sum((F.when(flipped >= F.lit(k - (1 << 63)), 1).otherwise(0) for k in keys if k < 1 << 64), F.lit(0))
    n = rows.count()
    buckets = max(1, -(-n // (rows_per_bucket * shards)) * 8)
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
                         F.pmod(F.xxhash64("doc_id", "text_crc32", "part"), F.lit(buckets)).alias("bucket"))
    return number(placed, ["shard"], "bucket", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def number(rows: DataFrame, by: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Gapless ``slot`` from 0 within ``by``: a row number in each bucket, plus the rows of the buckets before it."""
    from pyspark.sql import Window as W
    counts = rows.groupBy(*by, bucket).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy(*by).orderBy(bucket)) - F.col("n")).drop("n")
    inside = rows.withColumn("slot", F.row_number().over(W.partitionBy(*by, bucket).orderBy(*order)).cast("long") - 1)
    return inside.join(before, [*by, bucket]).withColumn("slot", F.col("slot") + F.col("before")).drop("before")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark, table(spark, sf_dir, "documents"), shards=40)
