"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; cyclic boosting visits the features in turn and adds to each feature's lookup table what a
shallow tree over its bins finds in the current residuals. Pairs of features are then ranked by what a coarse grid explains
of the remaining residuals, and the best get grids of their own, boosted the same way. A score is a sum of looked-up values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pieces, shingles, table, utf8, words

#: The model is fitted on at most so many labelled rows, those with the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000

FEATURES = ("log_bytes", "log_words", "word_bytes", "word_bytes_sd", "longest_word", "letters", "digits", "upper", "stops", "other_marks",
            "newlines", "spaces", "one_byte_words", "marked_words", "distinct_words", "commonest_word", "distinct_shingles", "distinct_lines")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGITS, _STOPS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:'\"-?")
_LETTERS = _UPPER | _class("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_BLANKS = _class(" \t\r\v\f\n")
_MARKS = ~(_LETTERS | _DIGITS | _STOPS | _BLANKS)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: how many hashes, how many different ones, and the most frequent one's count."""
    total = np.bincount(doc, minlength=n)
    if not len(h):
        return total, total, total
    key = np.sort((h >> np.uint64(24)) | (doc.astype(np.uint64) << np.uint64(40)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    of = (key[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, np.diff(np.r_[first, len(key)]))
    return total, np.bincount(of, minlength=n), most


def _some_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    hist = np.zeros((n, 256))
    for i in range(n):
        hist[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    word, doc, start, end = words(data, offsets)
    length = (end - start).astype(float)
    count, different, most = _distinct(word, doc, n)
    per = np.maximum(count, 1)
    mean = np.bincount(doc, length, n) / per
    square = np.bincount(doc, length * length, n) / per
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    marked = np.r_[0, np.cumsum(_MARKS[data])]
    n_sh, d_sh, _ = _distinct(*shingles(word, doc, 4), n)
    # lines: hashes of the words between two line ends, in order
    line = np.r_[0, np.cumsum(data == 10)][start] + doc
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    lines = mix(np.add.reduceat(word * (np.arange(len(word)) - np.repeat(head, np.diff(np.r_[head, len(word)])) + 1).astype(np.uint64), head)) if len(head) else word
    n_ln, d_ln, _ = _distinct(lines, doc[head] if len(head) else doc, n)
    bytes_ = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(0, square - mean * mean)), np.log1p(longest),
        *(hist @ c / bytes_ for c in (_LETTERS, _DIGITS, _UPPER, _STOPS, _MARKS)), hist[:, 10] / bytes_, hist @ _BLANKS / bytes_,
        np.bincount(doc, length == 1, n) / per, np.bincount(doc, marked[end] > marked[start], n) / per,
        different / per, most / per, d_sh / np.maximum(n_sh, 1), d_ln / np.maximum(n_ln, 1)])


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text (null: empty)."""
    data, offsets = utf8(column)
    parts = [_some_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


class AdditiveModel:
    """Lookup tables by feature and by pair of features, on the scale of log odds."""

    def __init__(self, intercept: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.intercept, self.cuts, self.tables, self.pairs = intercept, cuts, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = self.intercept + sum((t[b[:, j]] for j, t in enumerate(self.tables)), np.zeros(len(x)))
        for (i, j), t in self.pairs.items():
            f += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-f))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, position) of the best cut of ordered bins with gradient and curvature sums; position 0 is no cut."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """What a shallow tree over ordered bins adds to each of them."""
    if depth:
        _, k = _best_cut(g, h, ridge)
        if k:
            return np.r_[_tree(g[:k], h[:k], ridge, depth - 1), _tree(g[k:], h[k:], ridge, depth - 1)]
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree of depth 2 over a grid: one cut along one axis, then each half is cut along the other."""
    best, gain_of = None, -1.0
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        _, k = _best_cut(a.sum(1), b.sum(1), ridge)
        out, gain = np.zeros(a.shape), 0.0
        for rows in ((slice(0, k), slice(k, None)) if k else (slice(None),)):
            leaf = _tree(a[rows].sum(0), b[rows].sum(0), ridge, 1)
            out[rows] = leaf
            gain += float((leaf * a[rows].sum(0)).sum())
        if gain > gain_of:
            best, gain_of = (out if axis == 0 else out.T), gain
    return best, gain_of


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 250, rate: float = 0.08, ridge: float = 2.0, n_pairs: int = 6) -> AdditiveModel:
    """Cyclic boosting of logistic loss. Without rows of both classes the model is the share of class 1 (0.5 without rows)."""
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = AdditiveModel(float(np.log(p / (1 - p))), cuts, [np.zeros(len(c) + 1) for c in cuts], {})
    if len(np.unique(y)) < 2:
        return model
    b, f = model.bins(x), np.full(len(y), model.intercept)

    def residual():
        q = 1 / (1 + np.exp(-f))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = residual()
            step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), ridge)
            t += step
            f += step[b[:, j]]
    g, h = residual()
    found = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = (len(model.tables[i]), len(model.tables[j]))
            cell = b[:, i] * shape[1] + b[:, j]
            grid = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
            found.append((_grid_tree(*grid, ridge)[1], i, j))
    for _, i, j in sorted(found, reverse=True)[:n_pairs]:
        model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(rounds // 5):
        for (i, j), t in model.pairs.items():
            g, h = residual()
            cell = b[:, i] * t.shape[1] + b[:, j]
            step = rate * _grid_tree(*(np.bincount(cell, v, t.size).reshape(t.shape) for v in (g, h)), ridge)[0]
            t += step
            f += step[b[:, i], b[:, j]]
    return model


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5 (a null id is not)."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``most`` labelled documents. Of repeated labels of a document the highest counts, and of repeated documents the
    smallest text; null labels and ids don't. Without labels every text scores 0.5."""
    known = labels.filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    to = F.arrow_udf(lambda t: pa.array(list(features(t)), pa.list_(pa.float64())), "array<double>")
    one = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a repeated id counts once
    rows = one.select("doc_id", "quality", to("text").alias("x")).toArrow()  # at most ``most`` rows
    rows = rows.sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows.column("quality").to_numpy().astype(float))


def score(model: AdditiveModel, text: str = "text") -> F.Column:
    return F.arrow_udf(lambda t: pa.array(model.score(features(t))), "double")(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from ``least`` on); only the text decides a score.

    Null and empty texts are scored like any other; repeated rows get equal scores; columns of those names are replaced.
    """
    model = train(docs, labels)
    return docs.withColumns({"held_out": held_out(), "score": score(model, text)}).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
