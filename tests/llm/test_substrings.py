import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from weft.llm.common import prefix_hashes
from weft.llm.substrings import op5_substrings, remove_repeats, sort_suffixes

SF = "/root/testdata/sf0.001"


def brute(rows, size=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[p : p + size] for _, b in raw for p in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        mask, far = bytearray(len(b)), 0
        for p in range(len(b) - size + 1):
            if n[b[p : p + size]] > 1:
                for q in range(max(p, far), p + size):
                    mask[q] = 1
                far = p + size
        spans = sum(1 for p in range(len(b)) if mask[p] and (p == 0 or not mask[p - 1]))
        kept = bytes(c for c, m in zip(b, mask) if not m)
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_sort_suffixes():
    r = random.Random(2)
    text = bytes(r.choices(b"ab", k=600)) + b"ab" * 150 + b"a" * 200
    data = np.frombuffer(text, np.uint8)
    start = np.array(r.sample(range(len(text) - 40), 500))
    group = np.array([r.randrange(4) for _ in start])
    order, common = sort_suffixes(data, prefix_hashes(data), start, group, 40)
    key = [(group[i], text[start[i] : start[i] + 40]) for i in order]
    assert key == sorted(key)
    for k in range(1, len(order)):
        (g, x), (h, y) = key[k - 1], key[k]
        assert common[k] == (next((n for n in range(40) if x[n] != y[n]), 40) if g == h else 0)


@pytest.mark.parametrize("group", [4096, 2])
def test_against_brute_force(spark, group):
    r = random.Random(11)

    def words(n):
        return " ".join("".join(r.choices("abcdé", k=r.randint(2, 7))) for _ in range(n))
    common, tail = words(90), words(60)
    rows = [(i, words(40) + " " + common[r.randint(0, 60) : len(common) - r.randint(0, 60)] + " " + words(30)) for i in range(40)]
    rows += [(100 + i, words(r.randint(0, 40)) + common[i * 7 :] + tail[: 250 + i]) for i in range(12)]
    rows += [(200, "x" * 700), (201, "ab" * 150 + "q" + "x" * 205), (202, None), (203, ""), (204, "y" * 200), (205, "y" * 200), (206, "z" * 201), (207, "w" * 199), (208, "w" * 199)]
    rows += [(300, rows[3][1]), (301, rows[3][1][:-1] + "!"), (302, "#" + rows[3][1]), (303, words(2) + rows[5][1][50:]), (304, tail[10:209]), (305, tail[10:211]), (400, rows[7][1]), (400, rows[7][1]), (400, words(50)), (None, rows[8][1])]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, covered string")
    assert rows_of(remove_repeats(spark, df, group=group)) == brute(rows)
    assert remove_repeats(spark, df.limit(0)).count() == 0


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = rows_of(op5_substrings(spark, SF))
    assert got == brute(rows) and sum(x[2] for x in got) > 0


def test_rows_without_id_and_equal_crc32(spark):
    r = random.Random(5)
    block, one, other = ("".join(r.choices("abcdefgh ", k=n)) for n in (400, 100, 600))
    ends = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(200_000)]
    by_sum = {zlib.crc32((one + block + e).encode()): one + block + e for e in ends}
    same = next((by_sum[c], other + e) for e in ends if (c := zlib.crc32((other + e).encode())) in by_sum)
    for i in (None, 7):
        rows = [(i, same[0]), (i, same[1]), (8, block)]
        want = brute(rows)
        assert sorted(n for _, _, n, _, _ in want) == [0, 400, 400]
        assert rows_of(remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == want
