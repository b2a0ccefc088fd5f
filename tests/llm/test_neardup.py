import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from weft.llm.graph import components
from weft.llm.neardup import likeliest, near_duplicates, op4_neardup, registers

SF = "/root/testdata/sf0.01"


def brute(rows, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    sets = [(i, shingles(t)) for i, t in rows]
    by = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(n)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = {}
    for n, (i, s) in enumerate(sets):
        if s:
            ids.setdefault(i, n)
            root[find(n)] = find(ids[i])
        near = defaultdict(int)
        for x in s:
            for m in by[x]:
                if m > n:
                    near[m] += 1
        for m, c in near.items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                root[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(i, least.get(find(n), i))
    return sorted((i, len(s), least[find(n)], i == least[find(n)]) for n, (i, s) in enumerate(sets))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert rows_of(op4_neardup(spark, SF)) == brute(rows, 4, 80)


def test_families_chains_and_cases(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(6):  # edited copies of one original: each close to it, not to one another
        base = r.choices(vocab, k=150)
        rows.append((f * 100 + 50, " ".join(base)))
        for c in range(40):
            copy = list(base)
            for p in r.sample(range(150), 4):
                copy[p] = r.choice(vocab)
            rows.append((f * 100 + (c if c < 50 else c + 1), " ".join(copy)))
    chain = r.choices(vocab, k=100)
    for c in range(30):
        chain = list(chain)
        for p in r.sample(range(100), 2):
            chain[p] = r.choice(vocab)
        rows.append((1000 + c, " ".join(chain)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE\ttwo"), (2005, "One three"), (2006, "x " * 40_000), (2007, "x x x x x x"), (2008, rows[0][1]), (2008, rows[60][1]), (2009, rows[0][1])]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    assert rows_of(near_duplicates(spark, df, k=5)) == brute(rows, 5, 80) == rows_of(near_duplicates(spark, df, k=5, block=10))
    assert near_duplicates(spark, df.limit(0)).count() == 0
    odd = near_duplicates(spark, spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert {tuple(x) for x in odd} == {(None, 2, None, True), (1, 2, 1, True)}


@pytest.mark.parametrize("overlap", [0.3, 0.6, 0.8, 0.95])
def test_likelihood(overlap):
    r = np.random.default_rng(1)
    est, true = [], []
    for _ in range(60):
        pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
        n = int(r.integers(300, 1500))
        a, b = pool[:n], pool[int(n * (1 - overlap)) : int(n * (1 - overlap)) + n]
        true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        est.append(likeliest(registers(a)[None].astype(int), registers(b)[None].astype(int), np.array([float(len(a))]), np.array([float(len(b))]))[0])
    assert abs(np.mean(est) - np.mean(true)) < 0.02 and np.abs(np.array(est) - true).max() < 0.2
    assert (np.maximum(registers(a), registers(b)) == registers(np.union1d(a, b))).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 5), (7, 7), (9, 5), (200, 160), (None, 4)] + [(1000, i) for i in range(1001, 1050)]
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 200: 100, 3: 3, 5: 3, 9: 3, **{i: 1000 for i in range(1000, 1050)}}


def test_words_that_agree_modulo_a_power_of_two(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64, whatever the base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one {a} two three four"), (2, f"one {b} two three four")]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]
