"""Approximate nearest neighbours by inner product: inverted lists scanned dimension by dimension, with early abandoning.

Vectors get one more component, so that all have the same length; the largest inner product is then the smallest distance.
They are rotated at random and put into lists around centroids. Each query looks into its nearest lists. There, rotated vectors
lie in blocks of columns: after each block, a hypothesis test on the partial distance decides which candidates can still be
nearer than the query's k-th best, and only those read the next block. What is left is measured exactly on the original
vectors, in double precision.

The work is a grouped join of lists with the queries that look into them. Lists are cut into chunks of bounded size, and so are
the queries of a list, so no list has to fit into one task. Equal vectors are one candidate with the smallest ids (k + 1 of them
are enough), and equal queries are one query, so copies cost nothing. Only the centroids and the number of lists to look into
are learnt from bounded samples; every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Sent, table, written

#: Most rows and bytes of the sample from which centroids are fitted; queries by which the number of lists to look into is chosen.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES = 20_000, 16 << 20, 100
#: Share of the true neighbours of those queries that must lie in the lists looked into.
RECALL = 0.96
#: Vectors of a chunk, queries of a group, columns of a block, bytes of a step's matrix; the test's confidence (in deviations).
CHUNK, GROUP, COLUMNS, STEP_BYTES, DEVIATIONS = 16_384, 4_096, 16, 16 << 20, 2.1
#: A query vector is hot if more than one query in so many is equal to it.
HOT_SHARE = 1000
_SLACK = 1e-4  # single-precision distances of vectors of length 1 are right to far less


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v, h1, h2): v in double precision, and two hashes that stand for it. Null ids and vectors that are null, empty, all zero or
    hold null or non-finite components are left out. Of rows that share an id, the smallest vector counts."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))) & F.exists(column, lambda x: x != 0)
    v = vectors.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(column, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    return v.select("id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))


def _one_each(spark: SparkSession, rows: DataFrame) -> DataFrame:
    again = written(spark, rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "again")
    if again.isEmpty():
        return rows
    one = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("v", "h1", "h2")).alias("r")).select("id", "r.*")
    return rows.join(again, "id", "left_anti").unionByName(one)


class Space:
    """Scaling, the added component, rotation and centroids. Vectors are padded with zeros to ``dim`` components."""

    def __init__(self, dim: int, longest: float, sample: np.ndarray, lists: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.dim, self.longest = dim, longest
        self.turn = np.linalg.qr(r.standard_normal((dim + 1, dim + 1)))[0].astype(np.float32)
        x = self.place(sample)
        self.centroids = x[r.permutation(len(x))[:lists]]
        for _ in range(8):
            near = self.lists(x, 1)[:, 0]
            count = np.bincount(near, minlength=len(self.centroids))
            order = np.argsort(near, kind="stable")
            sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(count)[:-1]].clip(max=len(x) - 1), axis=0)
            self.centroids = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], self.centroids).astype(np.float32)

    def place(self, v: np.ndarray) -> np.ndarray:
        """Vectors scaled to length 1 by the added component, rotated."""
        u = v / self.longest
        return self._turned(u, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", u, u))))

    def ask(self, v: np.ndarray) -> np.ndarray:
        """Queries scaled to length 1, rotated; their added component is zero."""
        top = np.abs(v).max(axis=1, keepdims=True)
        u = v / top
        return self._turned(u / np.linalg.norm(u, axis=1, keepdims=True), np.zeros(len(v)))

    def _turned(self, u: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.c_[u, more].astype(np.float32) @ self.turn

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n lists nearest to each place, nearest first."""
        out = np.empty((len(x), n), np.int32)
        norm = np.einsum("ij,ij->i", self.centroids, self.centroids)
        step = max(1, STEP_BYTES // (4 * len(norm)))
        for i in range(0, len(x), step):
            d = norm - 2 * (x[i : i + step] @ self.centroids.T)
            if n == 1:
                out[i : i + step, 0] = d.argmin(axis=1)
            else:
                out[i : i + step] = np.argsort(d, axis=1, kind="stable")[:, :n]
        return out


def matrix(column, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` components; missing last ones are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    size = np.diff(off)
    out = np.zeros((len(size), dim), flat.dtype)
    if len(flat):
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)
        keep = at < dim
        out[row[keep], at[keep]] = flat[keep]
    return out


def _list_column(m: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), kind))


def _indexed(space):
    def run(batches):
        s = space.value
        for b in batches:
            v = matrix(b.column("v"), s.dim)
            place = s.place(v)
            yield pa.RecordBatch.from_arrays([pa.array(s.lists(place, 1)[:, 0], pa.int32()), b.column("ids"), b.column("h1"), _list_column(v, pa.float64()), _list_column(place, pa.float32())],
                                             names=["list", "ids", "h1", "v", "place"])
    return run


def _probing(space, n: int):
    def run(batches):
        s = space.value
        for b in batches:
            v = matrix(b.column("v"), s.dim)
            place = s.ask(v)
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), _list_column(v, pa.float64()), _list_column(place, pa.float32()), _list_column(s.lists(place, n), pa.int32())],
                                             names=["h1", "h2", "v", "place", "lists"])
    return run


def scan(places: np.ndarray, asked: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that may be among the k nearest, by partial distances over blocks of columns.

    reach: the square of the largest distance of interest for each query. A candidate whose partial squared distance over m of
    the D rotated columns is above reach * m / D * (1 + DEVIATIONS / sqrt(m))^2 is abandoned; over all columns the bound is reach.
    """
    dim = places.shape[1]
    cuts = [*range(0, dim, COLUMNS), dim]
    blocks = [np.ascontiguousarray(places[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    norms = [np.einsum("ij,ij->i", x, x) for x in blocks]
    found = []
    step = max(1, STEP_BYTES // (4 * max(1, len(places))))
    for i in range(0, len(asked), step):
        q, r = asked[i : i + step], reach[i : i + step]
        whole, rows, cols, part = True, None, None, np.zeros((len(q), len(places)), np.float32)
        for (a, b), x, norm in zip(zip(cuts[:-1], cuts[1:]), blocks, norms):
            if whole:
                part += np.einsum("ij,ij->i", q[:, a:b], q[:, a:b])[:, None] + norm - 2 * (q[:, a:b] @ x.T)
            else:
                d = q[rows, a:b] - x[cols]
                part += np.einsum("ij,ij->i", d, d)
            bound = r * (b / dim) * (1 + DEVIATIONS / np.sqrt(b)) ** 2 if b < dim else r
            if whole:
                near = part <= bound[:, None] + _SLACK
                if b < dim and 4 * near.sum() > near.size:
                    continue  # most are left: the next block is cheaper for all of them than picked one by one
                whole = False
                rows, cols = np.nonzero(near)
                part = part[rows, cols]
            else:
                near = part <= bound[rows] + _SLACK
                rows, cols, part = rows[near], cols[near], part[near]
        # beyond the k nearest of each query by these distances (a slack for rounding kept) nothing can be among the k best
        order = np.lexsort((part, rows))
        rows, cols, part = rows[order], cols[order], part[order]
        first = np.searchsorted(rows, np.arange(len(q) + 1))
        kth = np.full(len(q), np.inf)
        full = np.diff(first) >= k
        kth[full] = part[first[:-1][full] + k - 1]
        keep = part <= kth[rows] + _SLACK
        found.append((rows[keep] + i, cols[keep]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


_FOUND = "h1 long, h2 long, id long, score double"


def _searched(dim: int, longest: float, k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"h1": [], "h2": [], "id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            v, q = matrix(vectors.column("v"), dim), matrix(queries.column("v"), dim)
            places, asked = matrix(vectors.column("place"), dim + 1), matrix(queries.column("place"), dim + 1)
            top = np.abs(q).max(axis=1)
            length = top * np.linalg.norm(q / top[:, None], axis=1)
            # squared distance of unit vectors = 2 - 2 * (their inner product, scaled)
            reach = 2 - 2 * (queries.column("kth").to_numpy() / longest / length)
            rows, cols = scan(places, asked, reach, k)
            ids = vectors.column("ids").combine_chunks()
            id_flat, id_at = ids.flatten().to_numpy(), np.asarray(ids.offsets)
            id_at = id_at - id_at[0]
            n = np.diff(id_at)[cols]
            score = np.empty(len(rows))
            for a in range(0, len(rows), 65_536):
                score[a : a + 65_536] = np.einsum("ij,ij->i", q[rows[a : a + 65_536]], v[cols[a : a + 65_536]])
            row = np.repeat(rows, n)
            at = np.repeat(id_at[cols], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ident, score = id_flat[at], np.repeat(score, n)
            order = np.lexsort((ident, -score, row))
            row, ident, score = row[order], ident[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, ident, score = (z[place < k] for z in (row, ident, score))
            out = {"h1": queries.column("h1").to_numpy()[row], "h2": queries.column("h2").to_numpy()[row], "id": ident, "score": score}
        return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})
    return run


def _looked(index: DataFrame, probes: DataFrame, sizes: DataFrame, dim: int, longest: float, k: int) -> DataFrame:
    """The k best of each query in the lists it looks into, chunk by chunk. probes: (h1, h2, v, place, kth, list)."""
    asked = probes.groupBy("list").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    left = index.join(F.broadcast(sizes.join(asked, "list")), "list")  # one row for each list at most
    left = left.select("list", F.pmod("h1", "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "ids", "v", "place")
    right = probes.join(F.broadcast(sizes.join(asked, "list")), "list")
    right = right.select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod("h2", "groups").cast("int").alias("group"), "h1", "h2", "v", "place", "kth")
    return left.groupBy("list", "chunk", "group").cogroup(right.groupBy("list", "chunk", "group")).applyInArrow(_searched(dim, longest, k), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _truth(spark: SparkSession, index: DataFrame, ids: np.ndarray, v: np.ndarray, k: int, dim: int) -> DataFrame:
    """(query's number, list) of the k best distinct vectors of each of a few queries, by brute force over the whole index."""
    sent = spark.sparkContext.broadcast(v)

    def run(batches):
        q = sent.value
        for b in batches:
            score = q @ matrix(b.column("v"), dim).T
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            lists = b.column("list").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), top.shape[1])), pa.array(lists[top].ravel(), pa.int32()), pa.array(np.take_along_axis(score, top, 1).ravel())], names=["query", "list", "score"])

    every = index.select("list", "v").mapInArrow(run, "query long, list int, score double")
    return every.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("rank") <= k).select("query", "list")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", column: str = "embedding",
            recall: float = RECALL, lists: int | None = None) -> DataFrame:
    """The k vectors with the largest inner product found for each query: (query_id, rank, vec_id, score), ties to smaller ids.

    vectors and queries have ``id_col`` and ``column``; a query's own id is no candidate. Fewer candidates than k give all of
    them if they are found, none gives no rows. What ``usable`` leaves out takes no part. Vectors of unequal length are compared
    over their common components. ``lists`` is by default the square root of the number of different vectors, bounded by the
    sample; ``recall`` is what the number of lists looked into is chosen for. With k candidates or fewer, all lists are looked into.
    Repeated rows count once; other columns are not looked at.
    """
    rows = _one_each(spark, usable(vectors, id_col, column))
    few = W.partitionBy("h1", "h2", "v").orderBy("id")
    copies = rows.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1)
    distinct = written(spark, copies.groupBy("h1", "h2", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    asked = written(spark, _one_each(spark, usable(queries, id_col, column)), "asked")
    top = F.array_max(F.transform("v", F.abs))
    length = top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / top) * (x / top)))
    n, dim, longest = distinct.agg(F.count("*"), F.max(F.size("v")), F.max(length)).first()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(dim, asked.agg(F.max(F.size("v"))).first()[0])

    most = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * dim)))
    some = lambda df, size, rows: df.filter(F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(1 << 30)) < int(min(1.0, rows / size) * (1 << 30))).limit(2 * rows)
    sample = matrix(some(distinct, n, most).select("v").toArrow().column("v"), dim)
    if not len(sample):
        sample = matrix(distinct.select("v").limit(1).toArrow().column("v"), dim)
    lists = max(1, min(lists or round(n ** 0.5), max(1, len(sample) // 16)))
    # a hair more than the longest, so that rounding leaves the added component real
    longest *= 1 + 1e-9
    space = Sent(spark, Space(dim, longest, sample, lists))
    index = written(spark, distinct.mapInArrow(_indexed(space), "list int, ids array<long>, h1 long, v array<double>, place array<float>"), "index")
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    queried = written(spark, asked.groupBy("h1", "h2").agg(F.min("v").alias("v"), F.count("*").alias("times")), "queried")

    trial = some(queried, queried.count(), SAMPLE_QUERIES).toArrow()
    look = lists
    if n > k and trial.num_rows:
        v = matrix(trial.column("v"), dim)
        truth = _truth(spark, index, np.arange(len(v)), v, k + 1, dim).toPandas()
        order = np.argsort(space.value.lists(space.value.ask(v), lists), axis=1)  # place of each list in the query's order
        needed = np.sort(order[truth["query"].to_numpy(), truth["list"].to_numpy()])
        look = min(lists, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)

    probes = written(spark, queried.select("h1", "h2", "v").mapInArrow(_probing(space, look), "h1 long, h2 long, v array<double>, place array<float>, lists array<int>"), "probes")
    home = probes.select("h1", "h2", "v", "place", F.lit(float("-inf")).alias("kth"), F.col("lists")[0].alias("list"))
    first = written(spark, _best(_looked(index, home, sizes, dim, longest, k + 1), k + 1).drop("rank"), "home")
    kth = first.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("score").alias("score")).select("h1", "h2", F.when(F.col("n") > k, F.col("score")).otherwise(float("-inf")).alias("kth"))
    away = probes.join(kth, ["h1", "h2"], "left").select("h1", "h2", "v", "place", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), F.explode(F.slice("lists", 2, max(0, look - 1))).alias("list"))
    found = first.unionByName(_looked(index, away, sizes, dim, longest, k + 1)) if look > 1 else first
    results = _best(found, k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("best"))
    results = written(spark, results.join(queried.select("h1", "h2", "times"), ["h1", "h2"]), "results")
    space.unpersist()

    # queries equal to over one in HOT_SHARE are fewer than that: their results go to them
    hot = F.col("times") * HOT_SHARE > asked.count()
    ids = asked.select("id", "h1", "h2")
    often, key = results.filter(hot), ["h1", "h2"]
    each = (ids.join(F.broadcast(often), key).unionByName(ids.join(F.broadcast(often.select(key)), key, "left_anti").join(results.filter(~hot), key)))
    best = F.slice(F.filter("best", lambda x: x.id != F.col("id")), 1, k)
    return (each.select(F.col("id").alias("query_id"), F.posexplode(best).alias("at", "b"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.less")).alias("score")))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(spark, v, v.filter(F.col("vec_id") % 20 == 0), k=20)
