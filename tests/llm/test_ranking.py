import math
import random
import re
from collections import Counter

import duckdb

from weft.llm import ranking
from weft.llm.ranking import OP12_SQL, count_terms, op12_ranking, rank

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))


def brute(docs, items, k):
    docs = [(i, c) for i, c in ((i, fold(t)) for i, t in docs) if c]
    n, length, df = len(docs), sum(c.total() for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 25 + 75 * c.total() * n // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in fold(text).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def key(r):
    return r[0], r[1]


def test_terms():
    text = "Ab-c é漢 É x_y\x00Ünï 42 x  a`b{c}\x7fz[9]" * 3 + "Q" * 100
    assert {t.decode(): n for t, n in count_terms(text.encode()).items()} == fold(text)
    old, ranking.CHUNK_BYTES = ranking.CHUNK_BYTES, 7
    try:
        assert {t.decode(): n for t, n in count_terms(text.encode()).items()} == fold(text)
    finally:
        ranking.CHUNK_BYTES = old
    assert not count_terms(b"") and not count_terms(b" .\n")


def test_against_brute_force(spark):
    r = random.Random(3)
    names = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i % 500 if i % 7 else None, " ".join(r.choices(names, k=r.randint(0, 60)))) for i in range(900)]
    docs += [(600 + i, "the same text w1 w2") for i in range(300)] + [(1, None), (2, ""), (3, "..."), (None, "only here"), (4, "w1 " * 30000)]
    items = [(i, " ".join(r.choices(names, k=r.randint(1, 25)))) for i in range(40)] + [(90, "the same text"), (91, "Only HERE"), (92, "nowhere"), (93, ""), (94, None), (95, "w1 w1 w1 the w1"), (96, "w1")]
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, n int, term string").repartition(7)
    for block in (1 << 20, 300):
        got = [tuple(x) for x in rank(spark, d, spark.createDataFrame([(*x, 1) for x in items + [(None, "w1"), (96, "w9999")]], "item_id long, text string, rank int"), 10, block).collect()]
        assert sorted(got, key=key) == sorted(brute(docs, items, 10), key=key)
    every = spark.createDataFrame(items, "item_id long, text string")
    assert rank(spark, d.limit(0), every).count() == 0 and rank(spark, d, every.limit(0)).count() == 0
    few = [(1, "a b"), (2, "a")]
    assert sorted(tuple(x) for x in rank(spark, spark.createDataFrame(few, "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect()) == brute(few, [(1, "a b c")], 10)


def test_query(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = {tuple(r) for r in op12_ranking(spark, SF).collect()}
    assert got == set(con.execute(OP12_SQL).fetchall())
    docs, items = (con.execute(f"select {c}, text from {t}").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert got == set(brute(docs, items, 10))
