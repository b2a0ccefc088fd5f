import duckdb
import numpy as np
import pytest

from weft.llm.mixing import DIMS, LEAST_SHARE, OP10_SQL, bounded, marginals, mix, mixed, op10_mixing, tempered, topic, tokens

SF = "/root/testdata/sf0.01"


def test_query_and_sql(spark):
    out = op10_mixing(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(OP10_SQL)
    assert out.columns == [c[0] for c in want.description]
    rows = {tuple(r) for r in out.collect()}
    assert rows == set(want.fetchall()) and len(rows) > 100


def test_marginals_are_met(spark):
    r = np.random.default_rng(2)
    rows = [(i, None if i % 50 == 0 else f"s{min(int(r.exponential(2)), 6)}", r.choice(["en", "de"]), r.choice(["a", "b", "c"]), int(r.integers(1, 50)), 0.5) for i in range(4000)]
    df = spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in row) for row in rows], "doc_id long, source string, lang string, topic string, tokens long, weight double")
    out = mix(spark, df).toPandas()
    assert len(out) == 4000 and out.probability.max() == 1 and out.probability.min() > 0
    total = out.tokens.sum()
    for d in DIMS:
        g = out.groupby(d, dropna=False)
        got, own = (out.weight * out.tokens).groupby(out[d].fillna("?")).sum(), out.tokens.groupby(out[d].fillna("?")).sum()
        want = (own / total) ** 0.8
        assert got.to_numpy() == pytest.approx((total * want / want.sum()).to_numpy(), rel=1e-6)
    assert abs(out.drawn.mean() - out.probability.mean()) < 0.03


def test_cases(spark):
    df = spark.createDataFrame([(1, "a b\nc", "s"), (None, None, None), (3, "", "s"), (3, "", "s"), (4, "x " * 100_000, "s")], "doc_id long, text string, source string")
    from pyspark.sql import functions as F
    docs = df.select("*", F.lit("en").alias("lang"), topic().alias("topic"), tokens().alias("tokens"))
    out = mix(spark, docs).collect()
    assert sorted(r.tokens for r in out) == [1, 1, 1, 3, 100_001] and len({(r.doc_id, r.drawn) for r in out if r.doc_id == 3}) == 1
    assert mix(spark, docs.limit(0)).count() == 0


CELLS = "source string, lang string, topic string, tokens long"


def test_contradicting_targets_drop_no_cell(spark):
    rows = [(f"s{i}", "en", "a", 200) for i in range(100)] + [("big", "en", "a", 1000), ("big", "de", "a", 79_000)]
    cells = tempered(spark.createDataFrame(rows, CELLS))
    with pytest.warns(UserWarning, match="contradict"):
        out = mixed(spark, cells)
    got, met = out.toPandas(), marginals(out).filter("dim != 'topic'").toPandas()
    assert got.probability.min() > 0.01 and (got.probability * got.tokens).sum() == pytest.approx(LEAST_SHARE * 100_000)
    assert 0.01 < met.error.max() < 0.5 and met.expected.sum() == pytest.approx(2 * LEAST_SHARE * 100_000)


def test_small_probabilities_are_not_cut(spark):
    # a target that asks for a billionth of the hot cell: met, so its probability is small, but not 0
    docs = spark.createDataFrame([("hot", "en", "a", 10**12), ("s", "en", "a", 10**3)], CELLS)
    cells = tempered(docs, temper=0.0)
    assert 0 < min(r.probability for r in bounded(spark, cells, 1e-9).collect()) < 1e-6


def test_one_rare_cell_does_not_thin_the_others(spark):
    rows = [("hot", 50_000_000), *((f"s{i}", 5_000_000) for i in range(19)), ("rare", 1)]
    cells = tempered(spark.createDataFrame([(s, lang, "a", n) for s, n in rows for lang in ("en", "de")], CELLS))
    total = 2 * sum(n for _, n in rows)
    for share, want in ((None, LEAST_SHARE), (0.6, 0.6)):
        out = mixed(spark, cells, share=share)
        got = out.toPandas()
        assert (got.probability * got.tokens).sum() == pytest.approx(want * total) and got.probability.max() == pytest.approx(1)
        assert got[got.source == "rare"].probability.min() == pytest.approx(1)
        assert marginals(out).toPandas().error.max() < 0.01
        hot, other = (got[got.source == s].probability.mean() for s in ("hot", "s1"))
        assert other / hot == pytest.approx(10**0.2, rel=0.01) or other == pytest.approx(1)


def test_columns_named_like_cells(spark):
    rows = [(i, "ab"[i % 2], "en", "short", 10, f"x{i}", "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long, _source string, __lang string")
    out = mix(spark, docs)
    assert out.columns == [*docs.columns, "weight", "probability", "drawn"]
    assert {(r.doc_id, r._source) for r in out.select("doc_id", "_source").collect()} == {(i, f"x{i}") for i in range(40)}
