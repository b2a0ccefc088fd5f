"""Exact top-k search by inner product with a three-phase uniform threshold.

A score is the sum of ``lists`` local scores, one for each slice of the components. Phase 1 gathers the head of each local
list; the k-th best score among the heads is a safe cutoff: the true k-th best is at least as high. A score that reaches the
cutoff has a local score of at least cutoff / lists in some list. Phase 2 broadcasts the cutoffs and collects all such
entries; phase 3 adds up their remaining local scores exactly and keeps what reaches the cutoff. The lists of phase 2 are made
one after the other, and only for entries that can still reach the cutoff.

Vectors stay where they are. Queries go to all of them in blocks of bounded size, one pass for each block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

#: Bytes of one broadcast block of queries, and of the score matrix that one step makes.
BLOCK_BYTES, STEP_BYTES = 32 << 20, 16 << 20
_EXACT = float(1 << 53)


def _matrix(values: np.ndarray, dim: int) -> np.ndarray:
    """Rows of components as one matrix; missing last components are zero."""
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        out[i, : min(len(v), dim)] = v[:dim]
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices as they are if no inner product can reach 2**53 in floating point, else as Python's integers."""
    if q.size == 0 or x.size == 0 or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return q, x
    return tuple(np.array([[int(a) for a in row] for row in m.tolist()], object) for m in (q, x))


def _heads(scores: np.ndarray, k: int) -> np.ndarray:
    """Whether an entry is among the k best of its row, ties included."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    kth = np.sort(scores, axis=1)[:, -k] if scores.dtype == object else np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    return scores >= kth[:, None]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query: higher score first, then smaller id."""
    if score.dtype == object:
        order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], vec[i])), int)
    else:
        order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return query[keep], vec[keep], score[keep]


def _merged(kept, new, k: int):
    return _best(*(new if kept is None else (np.concatenate(z) for z in zip(kept, new))), k)


def _batches(batches, dim: int, rows: int):
    """(ids, matrix) of at most ``rows`` vectors."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            ids, v = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
            flat, off = v.flatten().to_numpy(zero_copy_only=False), np.asarray(v.offsets)
            n = np.diff(off)
            if len(n) and (n == n[0]).all():
                m = np.zeros((len(n), dim))
                m[:, : min(int(n[0]), dim)] = flat.reshape(len(n), -1)[:, :dim] if n[0] else 0
            else:
                m = _matrix([flat[a:b] for a, b in zip(off[:-1] - off[0], off[1:] - off[0])], dim)
            yield ids, m


def _sufficient(q: np.ndarray, x: np.ndarray, edges: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the entries that reach their query's cutoff.

    List by list: what the lists to come can add is at most the product of the lengths of the components left, so an entry that
    cannot reach the cutoff any more is not scored further; and an entry without a local score of cutoff / lists in any list
    cannot have reached it.
    """
    if q.dtype == object:
        total = q @ x.T
        i, j = np.nonzero(total.astype(float) >= cut[:, None])
        return i, j, total[i, j]
    lists = len(edges) - 1
    share = np.where(np.isfinite(cut), cut / lists, -np.inf)
    share -= 1e-6 * np.abs(np.where(np.isfinite(share), share, 0))
    left = [[np.sqrt(np.einsum("ij,ij->i", m[:, a:], m[:, a:])) for a in edges[1:]] for m in (q, x)]
    rows = cols = None
    part, collected = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)), bool)
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if rows is None:
            local = q[:, a:b] @ x[:, a:b].T
            part += local
            collected |= local >= share[:, None]
            alive = part + np.multiply.outer(left[0][n], left[1][n]) * (1 + 1e-9) >= cut[:, None]
            if n + 1 < lists and 4 * alive.sum() > alive.size:
                continue  # most are left: the next list is cheaper for all of them than picked one by one
            rows, cols = np.nonzero(alive)
            part, collected = part[rows, cols], collected[rows, cols]
        else:
            local = np.einsum("ij,ij->i", q[rows, a:b], x[cols, a:b])
            part = part + local
            collected = collected | (local >= share[rows])
            alive = part + left[0][n][rows] * left[1][n][cols] * (1 + 1e-9) >= cut[rows]
            rows, cols, part, collected = (z[alive] for z in (rows, cols, part, collected))
    reach = collected & (part >= cut[rows])
    return rows[reach], cols[reach], part[reach]


_OUT = "query_id long, vec_id long, score long"


def _emit(query, vec, score):
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], pa.int64())], names=["query_id", "vec_id", "score"])


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, lists: int = 4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best vectors (id, v) of each query (id, v) by integer inner product: (query_id, rank, vec_id, score).

    Components must be integral doubles. A query's own id is no candidate. Ties go to the smaller id; fewer candidates than k
    give all of them, none gives no rows. Vectors of unequal length are compared over their common components. A query id
    that occurs repeatedly is asked once, with its smallest vector; a repeated candidate row is a candidate each time. A
    product beyond a long counts as the nearest long. Other columns are not looked at.
    """
    asked = queries.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    vectors = vectors.filter(F.col("id").isNotNull()).select("id", "v")
    n, dim = int(size[0]), max(1, int(size[1]))
    per = max(1, block_bytes // (8 * dim))
    blocks = -(-n // per)
    asked = written(spark, asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))), "queries")
    found = []
    edges = np.linspace(0, dim, min(lists, dim) + 1).astype(int)
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).select("id", "v").toArrow()  # about block_bytes, by the split above
        ids = rows.column("id").to_numpy()
        q = _matrix([np.asarray(v, float) for v in rows.column("v").to_pylist()], dim)
        step = max(256, STEP_BYTES // max(8, 8 * len(ids)))
        sent = spark.sparkContext.broadcast((ids, q))

        def heads(batches, sent=sent):
            ids, q = sent.value
            kept = None
            for vec, x in _batches(batches, dim, step):
                qx, x = _exact(q, x)
                parts = [qx[:, a:b] @ x[:, a:b].T for a, b in zip(edges[:-1], edges[1:])]
                own = ids[:, None] == vec[None, :]
                total = sum(parts)
                near = np.zeros(own.shape, bool)
                for p in parts:
                    near |= _heads(np.where(own, -np.inf, p) if p.dtype != object else p, k)
                i, j = np.nonzero(near & ~own)
                kept = _merged(kept, (ids[i], vec[j], total[i, j]), k)
            if kept is not None and len(kept[0]):
                yield _emit(*kept)

        head = vectors.mapInArrow(heads, _OUT)
        ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = head.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        cut = {r.query_id: r.score for r in kth.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).collect()}
        # a hair below, so that rounding can only let more through
        cutoffs = spark.sparkContext.broadcast(np.array([float(cut[i]) - 1e-9 * abs(cut[i]) if i in cut else -np.inf for i in ids.tolist()]))

        def entries(batches, sent=sent, cutoffs=cutoffs):
            (ids, q), cut = sent.value, cutoffs.value
            kept = None
            for vec, x in _batches(batches, dim, step):
                i, j, total = _sufficient(*_exact(q, x), edges, cut)
                other = ids[i] != vec[j]
                kept = _merged(kept, (ids[i[other]], vec[j[other]], total[other]), k)
            if kept is not None and len(kept[0]):
                yield _emit(*kept)

        found.append(written(spark, vectors.mapInArrow(entries, _OUT), "entries"))
        sent.unpersist()
        cutoffs.unpersist()
    if not found:
        found = [spark.createDataFrame([], _OUT)]
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): components floor(scale * x); vectors that are null or hold a null or non-finite component are left out."""
    v = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings"))
    return search(spark, v, v.filter(F.col("id") % 50 == 0), k=5)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
