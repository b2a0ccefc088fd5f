import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from weft.llm.quality import classify

from .test_decontaminate import brute as cover
from .test_neardup import brute as duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in cp.STAGES:
        out.append((docs, docs := cp.written(spark, f(spark, docs, SF), "t")))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])
    before, after = stages[0]
    scored = classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scored.filter("predicted = 1"))
    good = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    kept = set(ids(after))
    assert sum(i in kept for i, q in good.items() if q) > 0.97 * sum(good.values()) and sum(i in kept for i, q in good.items() if not q) < 0.5 * sum(not q for q in good.values())
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == [i for i, _, _, kept in duplicates(rows, cp.WORDS, cp.PERCENT) if kept]
    before, after = stages[2]
    items = [t for t, in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    gone = set(ids(before)) - set(ids(after))
    assert gone
    for r in before.collect():
        whole = any(t in r.text for t in items)
        assert not whole or r.doc_id in gone
        if r.doc_id in gone and len(r.text) < 4000:
            assert any(n >= cp.bench.COVER * of for n, of in (cover(t, r.text, cp.bench.SEED) for t in items) if of)
    before, after = stages[3]
    assert set(ids(after)) <= set(ids(before)) and len(ids(after)) > 0.3 * len(ids(before))
    before, after = stages[4]
    assert ids(after) == ids(before)
    load = [r["b"] for r in after.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(load) <= max(max(r["size"] for r in after.collect()), 2 * sum(load) / 40)


def test_cases(spark):
    rows = [(1, "a b c d e f g", None, None, None, "x"), (1, "a b c d e f g", None, None, None, "x"), (2, "A b c d e f g", "en", "s", 3, "y"), (None, None, None, None, None, None), (None, "q", "en", "s", 1, "z"), (5, "", "en", "s", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tokens string")
    kept = cp.one_of_each(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "q"), (2, "A b c d e f g"), (5, "")] and kept.columns == docs.columns
    words = "the quick brown fox jumps over a lazy dog and runs on"
    more = [(1, "first clean text of its own", "en", "s", 1, "x"), (1, "second and quite unrelated clean text", "en", "s", 2, "x"), (None, words, "en", "s", 3, "x"), (None, words, "en", "s", 4, "x"), (None, words + " .", "en", "s", 5, "x"),
            (None, "another nameless text that nothing else resembles", "en", "s", 6, "x"), (7, words, "en", "s", 7, "x"), (8, "alone", None, None, None, None)]
    kept = cp.one_of_each(spark, spark.createDataFrame(more, docs.schema), SF)
    assert sorted((r.doc_id or 0, r.n_chars or 0) for r in kept.collect()) == [(0, 6), (1, 1), (1, 2), (7, 7), (8, 0)]
    for _, f in cp.STAGES:
        assert f(spark, docs, SF).count() <= 6 and f(spark, docs.limit(0), SF).count() == 0
    assert cp.target_mix(spark, docs, SF).columns == docs.columns
