"""Removal of repeated 200-byte strings by a hash-compared suffix sort.

Sorting the suffixes at every byte of a corpus would move each byte's position several times. Two facts make that unnecessary.
(1) Every 200-byte window has an anchor: the start of its smallest 32-byte hash, leftmost at ties. That depends on the window's
bytes alone, so equal windows have equal anchors, and only windows whose anchor's 32 bytes occur elsewhere need a look. Windows
in a row mostly share their anchor; they are one record, with the hash of all the bytes they cover. (2) Records with equal
covered bytes settle all their windows at once. What remains are records at the edges of repeats: their bytes are brought
together by anchor, and there prefix hashes and binary search narrow the windows down (a range of windows can only repeat if
the bytes common to all of them do, and does if all bytes covered by it do) before the suffixes left over are merge-sorted,
comparing two suffixes by binary search for their common extension. Neighbours in that order that agree on 200 bytes repeat.
Equalities found by hash are verified on the bytes.

An anchor with more different surroundings than ``GROUP`` is not sorted in one task: the hashes of its single windows are
counted instead, which is exact as well and can be pre-aggregated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pieces, powers, prefix_hashes, span_hashes, table, utf8, written

#: Bytes of a string that must not repeat, and of an anchor. Surroundings of one anchor that one task sorts.
SIZE, ANCHOR, GROUP = 200, 32, 4096
_SEGMENT = 8 << 20
_LOW = np.uint64((1 << 24) - 1)


def _records(data: np.ndarray, offsets: np.ndarray):
    """Windows of packed texts by anchor: (anchor hash, hash of covered bytes, text, anchor's byte, least and most bytes before it)."""
    n, span, w = len(data), 1, SIZE - ANCHOR + 1
    prefix = prefix_hashes(data)
    h = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * powers(n + 1)[1][: n - ANCHOR + 1])
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # at ties of the high bits the leftmost
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    anchor = (least & _LOW).astype(np.int64)
    p = np.arange(len(anchor))
    text = np.searchsorted(offsets, p, side="right") - 1
    inside = p + SIZE <= offsets[text + 1]
    p, anchor, text = p[inside], anchor[inside], text[inside]
    if not len(p):
        return None
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(p)] - 1
    at = anchor[first]
    lo, hi = at - p[last], at - p[first]
    covered = span_hashes(prefix, p[first], p[last] + SIZE) ^ mix((lo * 256 + hi).astype(np.uint64))
    return h[at], covered, text[first], at - offsets[text[first]], lo, hi


def records(docs: DataFrame) -> DataFrame:
    """(anchor, covered, doc, version, place) of documents (doc, version, text); place packs the anchor's byte, lo and hi."""
    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(2))
            for i, j in pieces(offsets):
                for s in range(0, max(1, int(offsets[j] - offsets[i])) if j == i + 1 else 1, _SEGMENT):
                    off = offsets[i : j + 1] - offsets[i] if j > i + 1 else np.array([0, min(int(offsets[j] - offsets[i]) - s, _SEGMENT + SIZE - 1)])
                    if off[-1] < SIZE or (got := _records(data[offsets[i] + s : offsets[i] + s + off[-1]], off)) is None:
                        continue
                    anchor, covered, text, at, lo, hi = got
                    row = pa.array(text + i)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(covered.view(np.int64)), b.column(0).take(row), b.column(1).take(row),
                                                      pa.array((at + s) << 16 | lo << 8 | hi)], names=["anchor", "covered", "doc", "version", "place"])

    return docs.mapInArrow(run, "anchor long, covered long, doc long, version long, place long")


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] equals data[b:b+n], row by row."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 4096):
        s = slice(i, i + 4096)
        step = np.arange(int(n[s].max()) if len(n[s]) else 0)
        use = step[None, :] < n[s][:, None]
        top = len(data) - 1
        out[s] = ((data[np.minimum(a[s][:, None] + step, top)] == data[np.minimum(b[s][:, None] + step, top)]) | ~use).all(1)
    return out


def _extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, up to ``most``: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = span_hashes(prefix, a, a + mid) == span_hashes(prefix, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sort_suffixes(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, group: np.ndarray, most: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (``most`` bytes each) by group and then bytes, and each one's common bytes with the one before it.

    A bottom-up merge sort: in a merge, each suffix finds its place in the other run by binary search, and a comparison takes
    a binary search for the common extension. Groups that are sorted already take no part in later merges.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(g)])
    base, length = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(len(g)) - base  # within the group
    width = 1
    while len(size) and width < size.max():
        on = np.flatnonzero(length > width)
        run = place[on] // (2 * width) * (2 * width)
        right = place[on] >= run + width
        other = np.where(right, run, run + width)
        end = np.minimum(np.where(right, run + width, run + 2 * width), length[on])
        low, high, own = np.minimum(other, end), end.copy(), start[order[on]]
        low0 = low.copy()
        while (open_ := low < high).any():
            x = np.flatnonzero(open_)
            mid = (low[x] + high[x]) >> 1
            a, b = own[x], start[order[base[on[x]] + mid]]
            c = _extension(prefix, a, b, most)
            da, db = (data[np.minimum(s + c, len(data) - 1)].astype(np.int16) for s in (a, b))
            after = np.where(c == most, right[x], db < da)  # whether the other one comes before this one
            low[x], high[x] = np.where(after, mid + 1, low[x]), np.where(after, high[x], mid)
        to = place[on] - np.where(right, run + width, run) + low - low0 + run
        moved = order.copy()
        moved[base[on] + to] = order[on]
        order = moved
        width *= 2
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        at = np.flatnonzero(g[1:] == g[:-1]) + 1
        common[at] = _extension(prefix, start[order[at]], start[order[at - 1]], most)
    return order, common


def _edges(anchor: np.ndarray, data: np.ndarray, offsets: np.ndarray, lo: np.ndarray, hi: np.ndarray, asked: np.ndarray):
    """Repeated windows of the records of whole groups: (record, least, most bytes before the anchor), for those asked for."""
    out = []
    if len(anchor) < 2:
        return out
    prefix = prefix_hashes(data)
    zero = offsets[:-1] + hi  # the anchor's byte
    width = 128
    rec, low = [], []
    for start in (0, 128):
        r = np.flatnonzero((hi >= start) & (lo < start + width))
        rec.append(r)
        low.append(np.full(len(r), start))
    rec, low = np.concatenate(rec), np.concatenate(low)
    while len(rec):
        high = low + width - 1
        core = mix(span_hashes(prefix, zero[rec] - low, zero[rec] - high + SIZE) + mix(anchor[rec].view(np.uint64) + low.astype(np.uint64)))
        _, core, n = np.unique(core, return_inverse=True, return_counts=True)
        keep = n[core] > 1
        rec, low, core = rec[keep], low[keep], core[keep]
        if width <= 8 or not len(rec):
            break
        cl, ch = np.maximum(low, lo[rec]), np.minimum(low + width - 1, hi[rec])
        a, z = zero[rec] - ch, zero[rec] - cl + SIZE
        hull = mix(span_hashes(prefix, a, z) + mix(core.astype(np.uint64) * np.uint64(65536) + (cl * 256 + ch).astype(np.uint64)))
        _, first, hull, n = np.unique(hull, return_index=True, return_inverse=True, return_counts=True)
        settled = (n[hull] > 1) & _same_bytes(data, a, a[first[hull]], z - a)
        several = np.bincount(hull, settled, len(n)) > 1
        settled &= several[hull]
        out.append((rec[settled & asked[rec]], cl[settled & asked[rec]], ch[settled & asked[rec]]))
        head = np.zeros(len(rec), bool)
        head[first] = True
        wanted = np.bincount(core, ~settled & asked[rec], core.max() + 1) > 0
        keep = wanted[core] & (~settled | head)
        rec, low = rec[keep], low[keep]
        width //= 2
        rec, low = np.r_[rec, rec], np.r_[low, low + width]
        inside = (hi[rec] >= low) & (lo[rec] < low + width)
        rec, low = rec[inside], low[inside]
    if len(rec):
        cl, ch = np.maximum(low, lo[rec]), np.minimum(low + width - 1, hi[rec])
        n = ch - cl + 1
        at = np.repeat(cl, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rec, core = np.repeat(rec, n), np.repeat(core, n)
        start = zero[rec] - at
        order, common = sort_suffixes(data, prefix, start, core * 512 + at)
        again = np.flatnonzero(common == SIZE)
        again = again[_same_bytes(data, start[order[again]], start[order[again - 1]], np.full(len(again), SIZE))]
        twice = np.unique(order[np.r_[again, again - 1]])
        twice = twice[asked[rec[twice]]]
        out.append((rec[twice], at[twice], at[twice]))
    return out


_MEMBER = "anchor long, doc long, version long, place long, asked boolean, bytes binary"
_FOUND = "doc long, version long, start long, end long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _unpack(place: np.ndarray):
    return place >> 16, (place >> 8) & 255, place & 255


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches that spans cover; stretches that touch are one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    s, e = begin[order], np.maximum.accumulate(end[order])
    cut = np.r_[True, s[1:] > e[:-1]]
    return s[cut], e[np.r_[np.flatnonzero(cut)[1:] - 1, len(e) - 1]]


def _lists(v: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list column's values and offsets; a null is an empty list."""
    if v.null_count:
        v = pa.array([x if x is not None else [] for x in v.to_pylist()], v.type)
    return v.flatten(), np.asarray(v.offsets) - (v.offsets[0].as_py() if len(v.offsets) else 0)


def _merged(by_doc: DataFrame) -> DataFrame:
    """Settled places of each document as maximal stretches; the lists of members stay as they are."""
    def run(batches):
        for b in batches:
            flat, off = _lists(b.column(2))
            at, lo, hi = _unpack(flat.to_numpy(zero_copy_only=False).astype(np.int64))
            begin, end = at - hi, at - lo + SIZE
            spans = [_union(begin[x:y], end[x:y]) for x, y in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"start": x, "end": y} for x, y in zip(*z)] for z in spans], _SPANS), b.column(3), b.column(4)],
                                             names=["doc", "version", "settled", "members", "crowded"])

    member = "array<struct<anchor: long, place: long, asked: boolean>>"
    return by_doc.mapInArrow(run, f"doc long, version long, settled array<struct<start: long, end: long>>, members {member}, crowded {member}")


def _members(joined: DataFrame) -> DataFrame:
    """The covered bytes of the records that need a closer look: from (doc_id, text, doc, version, members)."""
    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            flat, off = _lists(b.column(4))
            rows = np.repeat(np.arange(b.num_rows), np.diff(off))
            place = flat.field("place").to_numpy()
            at, lo, hi = _unpack(place)
            a, z = offsets[rows] + at - hi, offsets[rows] + at - lo + SIZE
            for i in range(0, len(rows), 4096):
                s = slice(i, i + 4096)
                row = pa.array(rows[s])
                yield pa.RecordBatch.from_arrays([flat.field("anchor").slice(i, 4096), b.column(2).take(row), b.column(3).take(row), pa.array(place[s]), flat.field("asked").slice(i, 4096),
                                                  pa.array([data[x:y].tobytes() for x, y in zip(a[s], z[s])], pa.binary())], names=["anchor", "doc", "version", "place", "asked", "bytes"])

    return joined.mapInArrow(run, _MEMBER)


def _windows(joined: DataFrame) -> DataFrame:
    """Single windows of records at crowded anchors, from (doc_id, text, doc, version, crowded): (x, y, asked, doc, version,
    start, end); x, y stand for the window's 200 bytes."""
    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            flat, off = _lists(b.column(4))
            rows = np.repeat(np.arange(b.num_rows), np.diff(off))
            places, asked = flat.field("place").to_numpy(), flat.field("asked")
            for i in range(0, len(rows), 1024):
                at, lo, hi = _unpack(places[i : i + 1024])
                base = offsets[rows[i : i + 1024]]
                text = np.concatenate([data[x:y] for x, y in zip(base + at - hi, base + at - lo + SIZE)])
                own = np.r_[0, np.cumsum(hi - lo + SIZE)]
                prefix, n = prefix_hashes(text), hi - lo + 1
                rec = np.repeat(np.arange(len(at)), n)
                before = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = own[rec] + hi[rec] - before
                # two different hashes: of the whole window, and of its halves with another weight
                x = span_hashes(prefix, start, start + SIZE)
                y = mix(span_hashes(prefix, start, start + SIZE // 2) * np.uint64(0xD6E8FEB86659FD93) + span_hashes(prefix, start + SIZE // 2, start + SIZE))
                row = pa.array(rows[i + rec])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), asked.take(pa.array(i + rec)), b.column(2).take(row), b.column(3).take(row),
                                                  pa.array(at[rec] - before), pa.array(at[rec] - before + SIZE)], names=["x", "y", "asked", "doc", "version", "start", "end"])

    return joined.mapInArrow(run, f"x long, y long, asked boolean, {_FOUND}")


def _settle(members: DataFrame) -> DataFrame:
    """Repeated stretches (doc, version, start, end) of members that stand in order of anchor, whole groups in a partition."""
    def solve(t: pa.Table):
        t = t.combine_chunks()
        raw = t.column("bytes").combine_chunks()
        data, offsets = utf8(raw.cast(pa.large_binary()))
        place = t.column("place").to_numpy()
        at, lo, hi = _unpack(place)
        for rec, cl, ch in _edges(t.column("anchor").to_numpy(), data, offsets, lo, hi, np.asarray(t.column("asked").to_numpy(zero_copy_only=False), bool)):
            row = pa.array(rec)
            yield pa.RecordBatch.from_arrays([t.column("doc").take(row).combine_chunks(), t.column("version").take(row).combine_chunks(), pa.array(at[rec] - ch), pa.array(at[rec] - cl + SIZE)], names=["doc", "version", "start", "end"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            anchor = t.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last group may go on in the next batch
            if whole:
                yield from solve(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None and held.num_rows:
            yield from solve(held)

    return members.mapInArrow(run, _FOUND)


def _remove(joined: DataFrame, with_text: bool) -> DataFrame:
    """The last step, from (doc_id, text, doc, version, settled, found): what stays of each text, and its digest."""
    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            lists = [_lists(b.column(c)) for c in (4, 5)]
            ends = [[f.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end")] for f, _ in lists]
            for i in range(b.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                s, e = _union(*(np.concatenate([ends[c][k][lists[c][1][i] : lists[c][1][i + 1]] for c in (0, 1)]) for k in (0, 1)))
                edge = np.r_[0, np.column_stack([s, e]).ravel(), len(raw)]
                kept = b"".join(raw[x:y].tobytes() for x, y in zip(edge[::2], edge[1::2]))
                for k, v in zip(out, (len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                    out[k].append(v)
            kind = {"kept_sha256": pa.string(), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kind.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", *out])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(spark: SparkSession, docs: DataFrame, with_text: bool = True, group: int = GROUP) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Bytes covered by a 200-byte string that also starts elsewhere in the table (at another place of the same text, overlapping
    or not, or in another row) are removed; all is judged on the input. Texts are their UTF-8 bytes, a null one has none;
    shorter texts stay whole. Every row is a document, also where doc_ids are null or repeated: rows with equal ids and texts
    repeat each other. Other columns are ignored; an empty table gives no rows. kept may cut through a UTF-8 character.
    """
    key = ["doc", "version"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # 128 bits in two columns, so that no two texts share a key, also where many rows have a null id or the same one
    docs = docs.select("*", F.xxhash64("doc_id", "text").alias("doc"), F.xxhash64(F.lit("version"), "text", "doc_id").alias("version"))
    every = records(docs.select("doc", "version", "text"))  # made twice: cheaper than keeping a row for every 70 bytes
    anchors = written(spark, every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("covered").alias("x"), F.max("covered").alias("y")).filter("n > 1")
                      .select("anchor", (F.col("x") != F.col("y")).alias("mixed")), "anchors")  # a table, so that Spark can split the skewed join
    repeated = written(spark, every.join(anchors, "anchor"), "repeated")
    place = F.struct("doc", "version", "place")
    classes = written(spark, repeated.filter("mixed").groupBy("anchor", "covered").agg(F.count("*").alias("n"), F.min(place).alias("head")), "classes")
    crowds = classes.groupBy("anchor").agg((F.count("*") > group).alias("crowd"))
    looked = (repeated.filter("mixed").join(classes.join(crowds, "anchor"), ["anchor", "covered"])
              .withColumn("asked", F.col("n") == 1).withColumn("one", F.when(F.col("asked") | (place == F.col("head")), F.struct("anchor", "place", "asked"))))
    none = F.lit(None).cast("struct<anchor: long, place: long, asked: boolean>")
    places = repeated.filter("NOT mixed").select(*key, "place", none.alias("member"), none.alias("crowded")).unionByName(
        looked.select(*key, F.when(~F.col("asked"), F.col("place")).alias("place"), F.when(~F.col("crowd"), F.col("one")).alias("member"), F.when(F.col("crowd"), F.col("one")).alias("crowded")))
    by_doc = written(spark, _merged(places.groupBy(*key).agg(F.collect_list("place").alias("settled"), F.collect_list("member").alias("members"), F.collect_list("crowded").alias("crowded"))), "by_doc")

    def with_list(name: str) -> DataFrame:  # all columns of ``docs``, so that the texts are shuffled once for all uses
        return docs.join(by_doc.select(*key, name).filter(F.size(name) > 0), key).select(*docs.columns, name)

    single = _windows(with_list("crowded"))
    twice = single.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").select("x", "y")
    found = _settle(_members(with_list("members")).repartition("anchor").sortWithinPartitions("anchor")).unionByName(
        single.filter("asked").join(twice, ["x", "y"]).select(*key, "start", "end"))
    found = found.distinct().groupBy(*key).agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = docs.join(by_doc.select(*key, "settled"), key, "left").join(found, key, "left").select(*docs.columns, "settled", "found")
    out = _remove(joined, with_text)
    return out if with_text else out.drop("kept")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"), with_text=False)
