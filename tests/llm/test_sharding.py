import zlib
from collections import defaultdict

import numpy as np
import pytest

from weft.llm.sharding import Slices, assign, cut_keys, op1_sharding

SF = "/root/testdata/sf0.001"


def brute_capacity(sizes, shards):
    def need(cap):
        n, at = 1, 0
        for s in sizes:
            if at + s > cap:
                n, at = n + 1, 0
            at += s
        return n
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("n,shards,hot", [(30, 4, 0), (3000, 7, 0), (20000, 40, 0), (500, 8, 4000), (5, 8, 0)])
def test_capacity_is_the_smallest(spark, n, shards, hot):
    r = np.random.default_rng(n)
    keys = r.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    sizes = r.integers(1, 400, n)
    sizes[0] += hot
    df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes)], "place long, bytes long")
    cuts, capacity = cut_keys(df, shards)
    order = sorted((int(k) & (1 << 64) - 1, int(s)) for k, s in zip(keys, sizes))
    assert capacity == brute_capacity([s for _, s in order], shards)
    load = defaultdict(int)
    for k, s in order:
        load[sum(k >= c for c in cuts)] += s
    assert max(load.values()) == capacity and cuts == sorted(cuts)


def test_cases(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 7), i) for i in range(300)] + [(None, "x", 1), (7, None, 1), (8, None, 2), (9, "", 3), (9, "", 3), (10, "é" * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumnRenamed("shard", "size")
    out = assign(spark, df, 5, rows_per_bucket=10).collect()
    assert len(out) == len(rows)
    slots, where = defaultdict(list), defaultdict(set)
    text = defaultdict(set)
    for i, t, _ in rows:
        text[i].add(t)
    for r in out:
        slots[r.shard].append(r.slot)
        assert any((len(t.encode()) if t else 0) + 16 == r["size"] and zlib.crc32((t or "").encode()) == r.text_crc32 for t in text[r.doc_id])
        where[(r.text_crc32, r["size"])].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(where[(zlib.crc32(b"same text"), 25)]) == 1
    assert assign(spark, df.limit(0), 5).count() == 0


def test_query(spark):
    out = op1_sharding(spark, SF).collect()
    load = defaultdict(int)
    for r in out:
        load[r.shard] += r["size"]
    assert len(out) == 200 and set(load) <= set(range(40))
    assert max(load.values()) <= max(max(r["size"] for r in out) * 2, sum(load.values()) / 40 * 2)


def test_slices_never_pass_the_end():
    s = Slices([(0, 0, 5, 1, 5), (1, 0, 5, 1, 5)])
    assert s.whole(5, 3) == [5, 10, 10] and s.whole(4, 3) == [0, 0, 0] and s.divisible(5, 2) == [5, 10]
