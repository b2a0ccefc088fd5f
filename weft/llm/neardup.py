"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles. Each of ``REGISTERS`` registers holds the smallest of as many exponential hashes of
the set's elements, truncated to an integer on an exponential scale (base ``BASE``): registers of a union are the maxima of
the registers, and equal registers are about as likely as the sets are similar. Bands of four registers give candidates; the
similarity of a candidate pair is first estimated by maximum likelihood from the registers and both set sizes together, and
pairs that are not far below the threshold are verified on the full sets.

Equal sets count once. Members of a band's bucket are not all paired: each is compared with the bucket's centre (the member
that shares most buckets with others, so the original of a family of edited copies). Buckets whose members are then still in
several components go on as blocks of bounded size: a task compares the registers of members of different components, verifies
the close ones on their sets (both as matrices), and emits only links that join components. A pair is looked at in the first
band where it meets, so once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, shingles, table, utf8, words, written
from .graph import components

#: 128 registers in bands of 4: a pair at 0.8 is in no common bucket with a probability of 5e-8.
REGISTERS, BAND, BASE, RATE = 128, 4, 1.001, 20.0
#: How far below the threshold an estimate may be (over 5 standard errors at 0.8).
SLACK = 0.2
#: Members and set elements of a block of a bucket; two blocks meet in a task.
BLOCK, ELEMENTS = 2048, 1_000_000
_DRAW = np.random.default_rng(20240607)
_ODD = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers (16 bits) of a set of 64-bit hashes."""
    least = np.full(REGISTERS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(elements), 512):
        np.minimum(least, (elements[i : i + 512, None] * _ODD + _ADD).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def likeliest(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from registers (rows) and set sizes."""
    more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    same = x.shape[1] - more - less
    u, v = (nx / (nx + ny))[:, None], (ny / (nx + ny))[:, None]
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)

    def p(z):
        return -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = more * np.log(np.maximum(a, tiny)) + less * np.log(np.maximum(b, tiny)) + same * np.log(np.maximum(1 - a - b, tiny))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def _sets(column: pa.Array, k: int):
    """(row, distinct shingles in order) of every text."""
    data, offsets = utf8(column)
    for i, j in pieces(offsets):
        off = offsets[i : j + 1]
        word, doc, _, _ = words(data[off[0] : off[-1]], off - off[0])
        h, of = shingles(word, doc, k)
        at = np.searchsorted(of, np.arange(j - i + 1))
        for r in range(j - i):
            yield i + r, np.unique(h[at[r] : at[r + 1]])


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands): s1, s2 are 128 bits that stand for the whole set."""
    def run(batches):
        for b in batches:
            n, s, bands = [], [], []
            for _, e in _sets(b.column(1), k):
                n.append(len(e))
                s.append(np.frombuffer(hashlib.blake2b(e.tobytes(), digest_size=16).digest(), "<i8"))
                bands.append(registers(e).view("<i8") if len(e) else np.zeros(0, "<i8"))
            s = np.array(s).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, set): all distinct shingles of each document."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.view(np.int64) for _, e in _sets(part.column(1), k)], pa.list_(pa.int64()))], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set array<long>")


def _estimate(x: pa.Array, y: pa.Array, nx: pa.Array, ny: pa.Array) -> pa.Array:
    x, y = (np.ascontiguousarray(c.flatten().to_numpy(zero_copy_only=False)).view("<u2").reshape(-1, REGISTERS).astype(np.int32) for c in (x, y))
    nx, ny = (c.to_numpy(zero_copy_only=False).astype(float) for c in (nx, ny))
    return pa.array(np.concatenate([likeliest(x[i : i + 2048], y[i : i + 2048], nx[i : i + 2048], ny[i : i + 2048]) for i in range(0, len(nx), 2048)]) if len(nx) else np.zeros(0))


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have percent * |union| <= 100 * |intersection|."""
    ends = {c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bands").alias(f"bands{c}")) for c in "ab"}
    near = (pairs.join(ends["a"], "a").join(ends["b"], "b")
            .filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
            .filter(F.arrow_udf(_estimate, "double")("bandsa", "bandsb", "na", "nb") >= percent / 100 - SLACK).select("a", "b").distinct())
    both = near.join(sets.withColumnsRenamed({"id": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _common(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[cols], by products of their incidence matrices."""
    used = np.union1d(rows, cols)
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, element, n = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    several = n > 1  # an element of one set alone is in no intersection
    element, owner = (np.cumsum(several) - 1)[element[several[element]]], owner[several[element]]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    out, step = np.zeros((len(rows), len(cols)), np.float32), max(256, (8 << 20) // (4 * len(used)))
    for first in range(0, int(several.sum()), step):
        a, b = np.searchsorted(element, [first, first + step])
        m = np.zeros((len(used), step), np.float32)
        m[owner[a:b], element[a:b] - first] = 1
        out += m[place[rows]] @ m[place[cols]].T
    return out


def _joining(percent: int):
    """Links between members of different components within two blocks of a bucket, none that joins what is joined already."""
    def solve(t: pa.Table) -> pa.Table:
        ids, comp, block = (t.column(c).to_numpy() for c in ("id", "component", "block"))
        band, (i, j) = t.column("band")[0].as_py(), (t.column(c)[0].as_py() for c in ("i", "j"))
        keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        regs = np.ascontiguousarray(keys).view("<u2").reshape(len(ids), -1)
        flat = t.column("set").combine_chunks()
        off, flat = np.asarray(flat.offsets), flat.values.to_numpy()
        sets, n = [flat[a:b] for a, b in zip(off[:-1], off[1:])], np.diff(off)
        root, links = {}, []

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for first in range(0, len(ids), 128):
            rows = np.arange(first, min(first + 128, len(ids)))
            near = (comp[rows][:, None] != comp[None, :]) & (ids[rows][:, None] < ids[None, :])
            near &= 100 * np.minimum(n[rows][:, None], n[None, :]) >= percent * np.maximum(n[rows][:, None], n[None, :])
            if i != j:
                near &= block[rows][:, None] != block[None, :]
            for b in range(band):
                near &= keys[rows, b][:, None] != keys[None, :, b]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            same = np.concatenate([(regs[rows[x[k : k + 8192]]] == regs[y[k : k + 8192]]).sum(1) for k in range(0, len(x), 8192)])
            close = same >= REGISTERS * (percent / 100 - SLACK)  # registers agree at least as often as the sets are similar
            x, y = rows[x[close]], y[close]
            if not len(x):
                continue
            ux, px = np.unique(x, return_inverse=True)
            uy, py = np.unique(y, return_inverse=True)
            both = _common(sets, ux, uy)[px, py]
            true = 100 * both >= percent * (n[x] + n[y] - both)
            for a, b in zip(x[true], y[true]):
                p, q = find(comp[a]), find(comp[b])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((ids[a], ids[b]))
        return pa.table({"a": pa.array([int(a) for a, _ in links], pa.int64()), "b": pa.array([int(b) for _, b in links], pa.int64())})

    return solve


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents whose sets of k-word shingles have a similarity of at least ``percent`` are linked; component_id is the
    smallest doc_id that links reach. Null, empty and blank texts have no shingles and are linked with nothing; a text of
    fewer words is one shingle. A null doc_id has a null component and is kept. Rows that share a doc_id are in one component,
    and are kept or not together. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = written(spark, sketches(docs, k), "sketches")
    some = sk.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = written(spark, some.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")), "sets")
    in_band = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = in_band.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1")
    members = written(spark, in_band.join(shared, ["band", "key"]), "members")
    weights = written(spark, members.groupBy("id").agg(F.sum("members").alias("weight")), "weights")
    sets = written(spark, full_sets(docs.join(weights.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), k), "full_sets")
    members = written(spark, members.drop("members").join(weights, "id"), "weighted")

    # rows that share a doc_id but not their set
    twice = some.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).filter("x <> y").select("doc_id")
    links = some.join(twice, "doc_id").join(reps.select("s1", "s2", "id"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    best = F.max(F.struct("weight", (-F.col("id")).alias("id")))
    centres = members.groupBy("band", "key").agg((-best.id).alias("centre"))
    star = members.join(centres, ["band", "key"]).filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    links = written(spark, links.unionByName(_verified(star, reps, sets, percent)), "links")
    now = members.join(components(spark, links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    now = written(spark, now.select("band", "key", "id", "component"), "assigned")
    open_ = now.join(reps.select("id", "n"), "id").groupBy("band", "key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"), F.sum("n").alias("elements")).filter("x <> y")
    parts = F.ceil(F.greatest(F.col("members") / block, F.col("elements") / ELEMENTS)).cast("int")
    now = now.join(open_.select("band", "key", parts.alias("parts")), ["band", "key"])
    now = now.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    now = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    now = now.join(reps.select("id", "bands"), "id").join(sets, "id").select("band", "key", "i", "j", "block", "id", "component", "bands", "set")
    links = written(spark, links.unionByName(now.groupBy("band", "key", "i", "j").applyInArrow(_joining(percent), "a long, b long")), "links")
    found = components(spark, links)
    return (sk.select("doc_id", "n_shingles", "s1", "s2").join(reps.select("s1", "s2", "id"), ["s1", "s2"], "left").join(found, "id", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.least("doc_id", F.coalesce("component", "id"))).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), k=4, percent=80)
