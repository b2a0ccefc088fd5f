import zlib

import duckdb
import numpy as np
import pyarrow as pa

from weft.llm.quality import FEATURES, classify, features, fit, op6_quality

SF = "/root/testdata/sf0.01"


def test_features():
    x = features(pa.array(["ab cd. ab\nab cd. ab", None, "", "ÀB 1 |", "w " * 600_000, " \n "]))
    f = {n: x[:, i] for i, n in enumerate(FEATURES)}
    assert x.shape == (6, len(FEATURES)) and np.isfinite(x).all()
    assert f["distinct_words"][0] == 2 / 6 and f["commonest_word"][0] == 4 / 6 and f["distinct_lines"][0] == 0.5 and f["upper"][0] == 0
    assert f["log_words"][4] == np.log1p(600_000) and f["distinct_words"][4] == 1 / 600_000 and f["marked_words"][3] == 1 / 3
    assert (x[1] == x[2]).all()


def test_model_learns_main_effects_and_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (6000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 0.8)).astype(float)
    m = fit(x[:4000], y[:4000], rounds=150)
    assert (0, 1) in m.pairs
    assert ((m.score(x[4000:]) >= 0.5) == (y[4000:] > 0)).mean() > 0.9
    assert fit(np.zeros((0, 4)), np.zeros(0)).score(np.zeros((2, 4))).tolist() == [0.5, 0.5]


def test_held_out_accuracy_and_columns(spark):
    out = op6_quality(spark, SF).toPandas()
    label = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").df()
    assert len(out) == 1000 and (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    both = out[out.held_out].merge(label, on="doc_id")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.5


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a fine text", "x"), (1, "a fine text", "x"), (None, None, None), (3, "", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (None, 1)], "doc_id long, quality int")
    out = classify(docs, labels)
    rows = out.collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert classify(docs.limit(0), labels.limit(0)).count() == 0
    assert {round(r.score, 6) for r in classify(docs, labels.limit(0)).collect()} == {0.5}
