import math

import duckdb
import numpy as np

from weft.llm import neighbours
from weft.llm.neighbours import nearest, op13_neighbours, scan

SF = "/root/testdata/sf0.001"


def brute(rows, queries, k):
    """{query: [(score, id), ...]}, nearest first."""
    out = {}
    for qi, q in queries:
        s = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qi)
        out[qi] = [(-x, i) for x, i in s[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def right(got, rows):
    """Scores are the inner products, in order, ties by id, own ids left out."""
    v = dict(rows)
    for q, best in got.items():
        assert all(abs(s - math.fsum(a * b for a, b in zip(v[q], v[i]))) <= 1e-9 * max(1, abs(s)) and i != q for s, i in best)
        assert best == sorted(best, key=lambda x: (-x[0], x[1]))


def test_recall_with_lists(spark, monkeypatch):
    r = np.random.default_rng(4)
    centres = r.standard_normal((30, 24))
    x = centres[r.integers(0, 30, 3000)] + 0.6 * r.standard_normal((3000, 24))
    x *= r.uniform(0.2, 3, (3000, 1))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*v, "x") for v in rows], "vec_id long, embedding array<double>, list string")
    want = brute(rows, [v for v in rows if v[0] % 20 == 0], 20)
    for chunk, group in ((neighbours.CHUNK, neighbours.GROUP), (40, 7)):  # lists in one task, and cut on both sides
        monkeypatch.setattr(neighbours, "CHUNK", chunk)
        monkeypatch.setattr(neighbours, "GROUP", group)
        got = found(nearest(spark, df, df.filter("vec_id % 20 = 0")))
        right(got, rows)
        assert all(len(b) == 20 for b in got.values()) and recall(got, want) >= 0.9


def test_exact_where_all_lists_are_read(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(a) for a in r.integers(-3, 4, 5)]) for i in range(300)]
    rows += [(400 + i, [1.0, 2.0, 3.0, 0.0, -1.0]) for i in range(500)]  # many copies, ties everywhere
    rows += [(1000, [5.0]), (1001, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]), (1002, [1e150, -1e150])]
    bad = [(2000, None), (2001, [0.0] * 5), (2002, [1.0, None]), (2003, [float("nan"), 1.0]), (2004, [float("-inf")]), (2005, []), (None, [1.0])]
    rows = [x for x in rows if any(x[1])]
    df = spark.createDataFrame(rows[:-1] + bad + rows[:2], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0 or vec_id in (1000, 1001)")
    want = brute(rows[:-1], [x for x in rows[:-1] if x[0] % 20 == 0 or x[0] in (1000, 1001)], 20)
    assert found(nearest(spark, df, asked, recall=1.0, lists=1)) == want
    assert recall(found(nearest(spark, df, asked)), want) >= 0.9
    three = df.filter("vec_id < 3")
    assert found(nearest(spark, three, three)) == brute([x for x in rows if x[0] < 3], [x for x in rows if x[0] < 3], 20)
    assert nearest(spark, df.limit(0), asked).count() == 0 and nearest(spark, df, asked.limit(0)).count() == 0
    one = df.filter("vec_id = 0")
    assert nearest(spark, one, one).count() == 0


def test_large_components(spark):
    rows = [(i, [1e200 * (i + 1), -1e199 * i]) for i in range(5)] + [(5, [1e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest(spark, df, df.filter("vec_id = 5")))
    assert [i for _, i in got[5]] == [4, 3, 2, 1, 0]


def test_early_abandoning_keeps_the_nearest():
    r = np.random.default_rng(2)
    x = r.standard_normal((4000, 96)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:200] + 0.05 * r.standard_normal((200, 96)).astype(np.float32)
    d = ((q[:, None, :] - x[None]) ** 2).sum(axis=2)
    kth = np.sort(d, axis=1)[:, 9]
    rows, cols = scan(x, q, kth, 10)
    true = {(i, int(j)) for i in range(200) for j in np.argsort(d[i], kind="stable")[:10]}
    assert len(true & set(zip(rows.tolist(), cols.tolist()))) >= 0.98 * len(true)
    assert len(rows) < 4 * len(true)
    rows, cols = scan(x, q, np.full(200, np.inf), 10)  # no threshold yet: exact
    assert true <= set(zip(rows.tolist(), cols.tolist()))


def test_query(spark):
    rows = [(i, [float(a) for a in v]) for i, v in duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()]
    df = op13_neighbours(spark, SF)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = found(df), brute(rows, [v for v in rows if v[0] % 20 == 0], 20)
    right(got, rows)
    assert got.keys() == want.keys() and all(len(b) == 20 for b in got.values()) and recall(got, want) >= 0.9
