"""Benchmark decontamination by greedy string tiling.

Running Karp-Rabin hashes of k tokens are the seeds; a document and a benchmark item that share seeds are compared. Seeds that
follow one another on a diagonal form maximal matches. The longest match is marked as a tile in both texts, again and again,
with what is left of the other matches, until none has k unmarked tokens. The share of the item's tokens under tiles decides:
tiles may lie in any order, so reordered passages count in full.

An item with fewer tokens than a tile needs is found as a whole: all of its tokens in a row.

Documents never move. The benchmark goes to them in blocks of bounded size, one pass for each block.
"""

from __future__ import annotations

import heapq
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, pieces, shingles, table, utf8, word_hashes

#: Tokens of the shortest tile; share of an item's tokens under tiles that makes a document contaminated; bytes of a block.
SEED, COVER, BLOCK_BYTES = 4, 0.4, 8 << 20

# Ranges of the scripts that put no spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han, Yi); each of
# their characters is a token.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
             (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _classes() -> np.ndarray:
    """What each code point is: 0 parts tokens, 1 belongs to one (letters, marks, digits), 2 is one."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in _UNSPACED:
        out[a : b + 1] *= 2
    return out


def _class_bytes(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of UTF-8 text the class of its character, and whether it is a character's first byte."""
    if not len(data) or data.max() < 128:
        return kinds[data], np.ones(len(data), bool)
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    size = np.diff(np.r_[at, len(data)])
    code = np.where(size == 1, data[at], data[at] & (0xFF >> (size + 1))).astype(np.int64)
    for i in range(1, 4):
        more = size > i
        code[more] = code[more] << 6 | (data[at[more] + i] & 0x3F)
    return np.repeat(kinds[np.minimum(code, 0x10FFFF)], size), head


def _tokens(column: pa.Array, kinds: np.ndarray, k: int):
    """By pieces of whole texts: (first text's number, hashes of tokens, where each text begins in them, hashes of k tokens in a
    row, where each text begins in those). Texts are lower-cased; those of under k tokens have no such rows."""
    data, offsets = utf8(pc.utf8_lower(column))
    for i, j in pieces(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        kind, head = _class_bytes(part, kinds)
        before = np.r_[np.uint8(0), kind[:-1]]
        bound = np.zeros(len(part) + 1, bool)
        bound[off] = True
        start = np.flatnonzero((kind > 0) & ((before == 0) | bound[:-1] | (head & ((kind == 2) | (before == 2)))))
        stop = np.r_[kind, np.uint8(0)]  # a token ends where the next one begins or a byte of none follows
        none = np.flatnonzero((stop == 0) | bound)
        end = np.minimum(np.r_[start[1:], len(part)], none[np.searchsorted(none, start, side="right")]) if len(start) else start
        token = word_hashes(part, start, end)
        doc = np.searchsorted(off, start, side="right") - 1
        count = np.bincount(doc, minlength=n)
        seed, of = shingles(token, doc, k)
        fit = count[of] >= k
        yield i, token, np.r_[0, np.cumsum(count)], seed[fit], np.r_[0, np.cumsum(np.maximum(0, count - k + 1))]


class Block:
    """Benchmark items with their seeds, sorted for lookup; items too short for a seed are kept by their length."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, k: int, kinds: np.ndarray):
        self.ids, self.k, self.kinds, self.short = ids, k, kinds, {}
        token, at, seed, item, place = [], [0], [], [], []
        for i, tokens, starts, seeds, seed_at in _tokens(texts, kinds, k):
            number = np.repeat(np.arange(len(seed_at) - 1), np.diff(seed_at))
            place.append(np.arange(len(seeds)) - seed_at[number])
            item.append(number + i)
            seed.append(seeds)
            at.extend((starts[1:] + at[-1]).tolist())
            token.append(tokens)
        self.token, self.at = (np.concatenate(token) if token else np.zeros(0, np.uint64)), np.array(at)
        seed, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seed, item, place))
        order = np.argsort(seed, kind="stable")
        self.item, self.place = item[order], place[order]
        self.seed, self.first = np.unique(seed[order], return_index=True)
        self.first = np.r_[self.first, len(order)]
        for n in range(1, k):
            mine = np.flatnonzero(np.diff(self.at) == n)
            if len(mine):
                whole = shingles(self.token[(self.at[mine][:, None] + np.arange(n)).ravel()], np.repeat(np.arange(len(mine)), n), n)[0]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], mine[order]

    def _whole(self, token: np.ndarray, at: np.ndarray):
        """(text's number, item's number, item's tokens, occurrences) of short items, for packed texts."""
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for n, (known, items) in self.short.items():
            row, of = shingles(token, doc, n)
            fit = np.diff(at)[of] >= n
            row, of = row[fit], of[fit]
            a, b = np.searchsorted(known, row), np.searchsorted(known, row, side="right")
            hit = np.flatnonzero(b > a)
            count = (b - a)[hit]
            entry = np.repeat(a[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pair, times = np.unique(np.stack([np.repeat(of[hit], count), items[entry]], 1), axis=0, return_counts=True)
            for (d, x), t in zip(pair.tolist(), times.tolist()):
                yield d, x, n, t

    def pairs(self, texts: pa.Array):
        """(text's number, item's number, item's tokens, tiled tokens, tiles) wherever there is a tile."""
        if not len(self.ids):
            return
        for i, token, at, seed, seed_at in _tokens(texts, self.kinds, self.k):
            for d, x, n, _ in self._whole(token, at):
                yield i + d, x, n, n, 1
            if not len(self.seed):
                continue
            found = np.searchsorted(self.seed, seed)
            found[found == len(self.seed)] = 0
            hit = np.flatnonzero(self.seed[found] == seed)
            doc = np.searchsorted(seed_at, hit, side="right") - 1
            for d in np.unique(doc):
                mine = hit[doc == d] if len(hit) < 1000 else hit[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")]
                to = found[mine]
                n = self.first[to + 1] - self.first[to]
                where = np.repeat(mine - seed_at[d], n)
                entry = np.repeat(self.first[to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                items, places = self.item[entry], self.place[entry]
                order = np.lexsort((places, where - places, items))
                items, places, where = items[order], places[order], where[order]
                cut = np.flatnonzero(np.r_[True, items[1:] != items[:-1], True])
                for a, b in zip(cut[:-1], cut[1:]):
                    x = items[a]
                    item = self.token[self.at[x] : self.at[x + 1]]
                    tiled, tiles = tile(item, token[at[d] : at[d + 1]], places[a:b], where[a:b], self.k)
                    if tiles:
                        yield i + int(d), int(x), len(item), tiled, tiles


def tile(item: np.ndarray, text: np.ndarray, places: np.ndarray, where: np.ndarray, k: int) -> tuple[int, int]:
    """Tokens of ``item`` under tiles, and the number of tiles. Seeds (place in the item, in the text) by diagonal, then place."""
    new = np.r_[True, (places[1:] != places[:-1] + 1) | (where[1:] != where[:-1] + 1)]
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(places)]) + k - 1
    heap = [(-int(n), int(p), int(t)) for n, p, t in zip(length, places[first], where[first])
            if (item[p : p + n] == text[t : t + n]).all()]  # hashes of tokens agree, not only those of seeds
    heapq.heapify(heap)
    in_item, in_text, left, tiles = np.zeros(len(item), bool), set(), len(item), 0
    while heap and left >= k:
        n, p, t = heapq.heappop(heap)
        n = -n
        used = in_item[p : p + n].copy()
        if in_text:
            used |= np.fromiter((t + x in in_text for x in range(n)), bool, n)
        if not used.any():
            in_item[p : p + n] = True
            in_text.update(range(t, t + n))
            left -= n
            tiles += 1
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, used, True].astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= k:
                heapq.heappush(heap, (-int(b - a), p + int(a), t + int(b) - int(b - a)))
    return len(item) - left, tiles


def blocks(spark: SparkSession, benchmark: DataFrame, k: int = SEED, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark as broadcast blocks of about ``block_bytes`` of text; null ids and null texts are left out."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    out, kinds = [], _classes()
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toArrow().sort_by("item_id")
        if part.num_rows:
            out.append(Sent(spark, Block(part.column("item_id").to_numpy(), part.column("text").combine_chunks(), k, kinds)))
    return out


def tilings(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = SEED, least: float = COVER) -> DataFrame:
    """Pairs of a document and an item of which at least ``least`` is tiled:
    (doc_id, item_id, item_tokens, tiled_tokens, tiles, coverage).

    Tokens are runs of letters, marks and digits of the lower-cased text; in scripts without spaces each character is a token.
    Items of fewer than ``k`` tokens match where all their tokens stand in a row (one tile); items without tokens match nothing,
    and null and empty texts have no tokens. Whole texts are read, however long. Repeated documents give repeated rows (null
    ids included), repeated items count once for each different text. Other columns, whatever their names, are not looked at. No document with a pair is left out, and each is one row per item.
    """
    def run(block):
        def of(batches):
            b = block.value
            for batch in batches:
                rows = [r for r in b.pairs(batch.column(1)) if r[3] >= least * r[2]]
                doc = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array([int(b.ids[r[1]]) for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)),
                                                  pa.array([r[3] / r[2] for r in rows], pa.float64())], names=["doc_id", "item_id", "item_tokens", "tiled_tokens", "tiles", "coverage"])
        return of

    schema = "doc_id long, item_id long, item_tokens long, tiled_tokens long, tiles long, coverage double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [texts.mapInArrow(run(b), schema) for b in blocks(spark, benchmark, k)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def contaminated(spark: SparkSession, benchmark: DataFrame, text: str = "text", k: int = SEED, least: float = COVER) -> F.Column:
    """Whether a document's text covers any item of the benchmark: a column, so documents need no join to be filtered."""
    def run(block):
        def of(t: pa.Array) -> pa.Array:
            out = np.zeros(len(t), bool)
            for row, _, n, tiled, _ in block.value.pairs(t):
                out[row] |= tiled >= least * n
            return pa.array(out)
        return F.arrow_udf(of, "boolean")(F.col(text))

    return reduce(lambda a, b: a | b, map(run, blocks(spark, benchmark, k)), F.lit(False))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tilings(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
