import os
import random
import subprocess
import sys

import duckdb
import regex

from weft.llm.decontaminate import COVER, blocks, contaminated, op8_decontaminate, tilings

SF = "/root/testdata/sf0.001"


def tokens(t):
    alone = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]"
    return regex.findall(rf"(?V1)[[\p{{L}}\p{{M}}\p{{N}}]&&{alone}]|[[\p{{L}}\p{{M}}\p{{N}}]--{alone}]+", (t or "").lower())


def brute(item, text, k):
    """Greedy string tiling by comparing all positions: the longest match of unmarked tokens first, ties by place."""
    a, b = tokens(item), tokens(text)
    if 0 < len(a) < k:
        return (len(a) if any(b[i : i + len(a)] == a for i in range(len(b))) else 0), len(a)
    ma, mb, tiled = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return tiled, len(a)
        ma[i : i + n], mb[j : j + n] = [True] * n, [True] * n
        tiled += n


def test_against_brute_force(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choices("abcdefgh", k=r.randint(0, 14)))) for i in range(12)] + [(50, None), (None, "a b c d e"), (51, ""), (52, "x x x x x x")]
    docs = [(i, " ".join(r.choices("abcdefgh", k=r.randint(0, 30))), "s") for i in range(40)] + [(90, None, "s"), (91, "", "s"), (92, "x " * 5000, "s"), (93, "X, x; x-x\nx x. x", "s"), (None, "x x x x x x", "s")]
    docs += [(94, docs[3][1], "s"), (94, docs[3][1], "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, coverage string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.item_id, x.tiled_tokens, x.item_tokens) for x in tilings(spark, d, b, k=3, least=0.3).collect())
    want = []
    for i, t, _ in docs:
        for j, q in items:
            if j is not None and q and len(t or "") < 5000:
                n, of = brute(q, t, 3)
                if n and n >= 0.3 * of:
                    want.append((-1 if i is None else i, j, n, of))
    words = set(tokens("x"))
    want += [(92, 52, 6, 6)] + [(92, j, len(tokens(q)), len(tokens(q))) for j, q in items if j is not None and q and len(tokens(q)) < 3 and set(tokens(q)) <= words]
    assert got == sorted(want)
    assert tilings(spark, d.limit(0), b).count() == 0 and tilings(spark, d, b.limit(0)).count() == 0


def test_reordered_passages_and_blocks(spark):
    s = ["one two three four five", "red green blue white black", "north south east west up"]
    item = " . ".join(s)
    d = spark.createDataFrame([(1, f"noise here {s[2]} more noise {s[0]} and then {s[1]} end"), (2, "one two red green north south blue three four"), (3, s[1])], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, "completely other words in this item"), (9, "tiny item")], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.tiles, x.coverage) for x in tilings(spark, d, b).collect()] == [(1, 7, 3, 1.0)]
    assert len(blocks(spark, b, block_bytes=20)) > 1
    assert [x.doc_id for x in d.filter(contaminated(spark, b)).collect()] == [1]


def test_short_items_and_scripts(spark):
    d = spark.createDataFrame([(1, "She said “Forty-Two, OK?” and left"), (2, "forty and two ok"), (3, "前文。機械学習は楽しいですか？はい。後文"), (4, "機械 学習"), (5, "ÉCOLE NORMALE SUPÉRIEURE de Lyon"),
                               (6, "กขค x"), (7, None), (8, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "forty two ok"), (2, "機械学習は楽しいですか"), (3, "école normale supérieure de lyon"), (4, "..."), (5, "ขค")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.item_tokens, r.tiled_tokens) for r in tilings(spark, d, b).collect())
    assert got == [(1, 1, 3, 3), (3, 2, 11, 11), (5, 3, 5, 5), (6, 5, 2, 2)]
    for doc, item, of, n in got:
        text, q = (x.filter(f"{c} = {i}").first().text for x, c, i in ((d, "doc_id", doc), (b, "item_id", item)))
        assert (n, of) == brute(q, text, 4)


def test_runs_where_executors_have_no_copy(tmp_path):
    """The queries that send values to executors, from a folder outside the repository: workers cannot import the library."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from weft.session import get_spark
import __spark_entry__, corpus_pipeline as cp
spark = get_spark("outside", cpus=2)
def importable(_):
    import importlib.util
    yield importlib.util.find_spec("weft") is not None
assert not any(spark.sparkContext.parallelize(range(2), 2).mapPartitions(importable).collect())
queries = __spark_entry__.queries()
for name in sys.argv[1:]:
    assert queries[name](spark, {SF!r}).count() > 0, name
docs = cp.table(spark, {SF!r}, "documents")
assert 0 < cp.unseen_by_benchmarks(spark, docs, {SF!r}).count() < docs.count()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ["op3_secrets", "op4_neardup", "op5_substrings", "op6_quality", "op8_decontaminate", "op11_alignment", "op12_ranking", "op13_neighbours", "documents"]
    out = subprocess.run([sys.executable, "-c", code, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in out.stdout, out.stderr[-3000:]


def test_query_finds_whole_passages(spark):
    got = {(r.doc_id, r.item_id) for r in op8_decontaminate(spark, SF).collect()}
    whole = set(duckdb.sql(f"select d.doc_id, b.item_id from '{SF}/documents.parquet' d, '{SF}/benchmark.parquet' b where contains(d.text, b.text)").fetchall())
    assert whole and whole <= got
    docs, items = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()), dict(duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall())
    for d, i in sorted(got - whole)[:5] + sorted(whole)[:3]:
        if len(docs[d]) < 6000:
            n, of = brute(items[i], docs[d], 4)
            assert n >= COVER * of
