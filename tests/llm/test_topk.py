import numpy as np
import pytest

from weft.llm.topk import op2_topk, quantised, search

SF = "/root/testdata/sf0.001"


def brute(rows, queries, k):
    out = set()
    for qi, q in queries:
        s = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != qi)
        out |= {(qi, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -x))) for n, (x, i) in enumerate(s[:k])}
    return out


def rows_of(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("block", [1 << 20, 3 * 8 * 9])
def test_against_brute_force(spark, block):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-40, 40, 9)]) for i in range(200)] + [(200 + i, [1.0] * 9) for i in range(30)] + [(300, [0.0] * 9), (301, []), (302, [5.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.filter("id % 20 = 0 or id = 301")
    assert rows_of(search(spark, df, q, 5, block_bytes=block)) == brute(rows, [x for x in rows if x[0] % 20 == 0 or x[0] == 301], 5)
    assert rows_of(search(spark, df.filter("id < 3"), q, 5, block_bytes=block)) == brute(rows[:3], [x for x in rows if x[0] % 20 == 0 or x[0] == 301], 5)


def test_left_out_and_large(spark):
    rows = [(0, [0.5, -0.25], 1), (1, [1.0, None], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 0.0], 1), (5, [1e12, 1e12], 1), (6, [2.0, 3e13], 2), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    v = quantised(df)
    assert sorted(r.id for r in v.filter("id is not null").collect()) == [0, 5, 6]
    good = [(i, [np.floor(256 * x) for x in e]) for i, e, _ in rows if i in (0, 5, 6)]
    assert rows_of(search(spark, v, v, 5)) == brute(good, good, 5)
    assert search(spark, v.limit(0), v.limit(0), 5).count() == 0
    assert search(spark, v, v.limit(0), 5).count() == 0


def test_query(spark):
    import duckdb

    from weft.llm.topk import OP2_SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert rows_of(op2_topk(spark, SF)) == set(con.execute(OP2_SQL).fetchall())
