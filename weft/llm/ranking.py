"""Ranked lexical search, term at a time with a limit on accumulators.

A document's score for an item is the sum over the item's terms of an integer weight (rare terms weigh more) times an integer
impact (how often the document holds the term, against its length). Documents never move: one pass counts, for every document,
its terms and the items' terms in it; their counts are then scored inside tasks, block by block.

An item's terms are taken rarest first. Every document with the term gets an accumulator until the most that the terms still
to come can add is less than the k-th best partial score: no new document can then be among the k best, and the remaining
terms only update the documents that have one, exactly. The k-th best partial score is the highest of three: that of the
documents with the rarest terms over the whole table (a first pass over the counts), that of the documents this task has
finished, and that of the block.

Items go to the documents in blocks of bounded size, one pass for each block.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, table, written

#: Bytes of the items' texts that go out in one broadcast block.
BLOCK_BYTES = 4 << 20
#: The rarest terms of an item that together occur in so many times k documents give the first threshold.
FIRST = 4

# Terms are ASCII letters and digits and everything beyond ASCII, A-Z lower-cased; any other byte parts them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(text: bytes) -> Counter:
    """How often a text holds each of its terms. A long text is counted piece by piece, cut between terms."""
    text, out, at = text.translate(_FOLD), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK_BYTES)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def _counts(terms):
    """Per document with any term: its id, its number of terms, and (term's number, occurrences) of the items' terms."""
    def run(batches):
        numbers = terms.value
        for batch in batches:
            ids, n, ends, number, tf = [], [], [0], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                count = count_terms(text or b"")
                if not count:
                    continue
                ids.append(i)
                n.append(count.total())
                for t in numbers.keys() & count.keys():
                    number.append(numbers[t])
                    tf.append(count[t])
                ends.append(len(number))
            hits = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(tf, pa.int64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)], ["doc_id", "n", "hits"])
    return run


def _best(score: np.ndarray, doc: np.ndarray, none: np.ndarray, k: int):
    order = np.lexsort((doc, none, -score))[:k]
    return score[order], doc[order], none[order]


def _scored(sent, k: int, first: bool):
    """Runs one block of items over counted documents: each task's k best of each item (``first``: by the rarest terms only)."""
    def run(batches):
        items, n_terms, cutoffs = sent.value
        best = [None] * len(items)
        for batch in batches:
            hits = batch.column(2)
            size = np.diff(np.asarray(hits.offsets))
            flat = hits.flatten()
            term, impact = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("term", "impact"))
            doc = np.repeat(np.arange(len(size)), size)
            order = np.argsort(term, kind="stable")
            doc, impact = doc[order], impact[order]
            at = np.searchsorted(term[order], np.arange(n_terms + 1))
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            acc = np.zeros(len(size), np.int64)
            for x, (terms, weights, rest, rarest) in enumerate(items):
                have = at[terms + 1] > at[terms]
                if not have.any():
                    continue
                acc[:] = 0
                cut = max(int(cutoffs[x]), int(best[x][0][-1]) if best[x] is not None and len(best[x][0]) == k else 0)
                some = None  # documents with an accumulator, once no more are made
                for pos in range(rarest if first else len(terms)):
                    if some is None and rest[pos] < cut:
                        some = np.flatnonzero(acc)
                        partial = acc[some]
                    if not have[pos]:
                        continue
                    t, w = terms[pos], weights[pos]
                    d, add = doc[at[t] : at[t + 1]], impact[at[t] : at[t + 1]]
                    if some is None:
                        acc[d] += w * add
                        if rest[pos + 1] < acc.max():
                            made = acc[acc > 0]
                            if len(made) >= k:
                                cut = max(cut, int(np.partition(made, len(made) - k)[len(made) - k]))
                    else:
                        to = np.searchsorted(d, some)
                        to[to == len(d)] = 0
                        same = d[to] == some
                        partial[same] += w * add[to[same]]
                if some is None:
                    some = np.flatnonzero(acc)
                    partial = acc[some]
                keep = partial >= max(cut, 1)
                some, partial = some[keep], partial[keep]
                if len(some):
                    new = (partial, ids[some], none[some])
                    best[x] = _best(*(new if best[x] is None else (np.concatenate(z) for z in zip(best[x], new))), k)
        for x, found in enumerate(best):
            if found is not None:
                score, doc, none = found
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), x, np.int64)), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())], ["item", "doc_id", "score"])
    return run


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k highest-scoring documents (doc_id, text) of each item (item_id, text): (item_id, rank, doc_id, score).

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. With N documents
    that hold any term, L terms in all of them, n in this one, df documents with the term and tf occurrences in this one, a
    term adds floor(1000 ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf + 8m)), m = 25 + (75 n N div L), for each time the
    item holds it. Scores are above 0; equal ones go by doc_id, null last. Null and empty texts hold no terms. Rows are documents,
    also with repeated or null ids. An item_id that occurs repeatedly is asked once, with its smallest text; items without id are
    left out. An empty table gives no rows. Whole texts are counted; other columns are not looked at.
    """
    asked = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    asked = written(spark, asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "items")
    found = [_rank_block(spark, docs, asked.filter(F.col("block") == block), k) for block in range(blocks)]
    ranked = found[0]
    for part in found[1:]:
        ranked = ranked.unionByName(part)
    return ranked


def _rank_block(spark: SparkSession, docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = [(r.item_id, count_terms(r.text.encode())) for r in asked.orderBy("item_id").collect()]  # about block_bytes of text
    names = sorted({t for _, c in rows for t in c})
    terms = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counts(terms), "doc_id long, n long, hits array<struct<term:int,tf:long>>")
    counted = written(spark, counted, "counts")
    terms.unpersist()
    n, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # decimals: the product of three counts may leave 64 bits
    m = F.lit(25) + F.expr(f"(cast('{75 * n}' as decimal(30, 0)) * cast(n as decimal(19, 0))) div cast('{max(1, length)}' as decimal(19, 0))")
    impact = F.transform("hits", lambda h: F.struct(h.term.alias("term"), F.call_function("div", h.tf * 1_000_000_000, h.tf * 1000 + F.col("m") * 8).alias("impact")))
    postings = counted.select("doc_id", "n", m.alias("m"), "hits").select("doc_id", "n", impact.alias("hits"))
    stats = {r.term: (r.df, r.top) for r in postings.select(F.explode("hits").alias("h")).groupBy(F.col("h.term").alias("term")).agg(F.count("*").alias("df"), F.max("h.impact").alias("top")).collect()}  # at most the block's terms
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, (df, _) in stats.items()}
    number = {t: i for i, t in enumerate(names)}
    plans = []
    for _, c in rows:
        mine = sorted((stats[number[t]][0], number[t], times) for t, times in c.items() if number[t] in stats)
        weights = [weight[t] * times for _, t, times in mine]
        rest = [0]
        for (_, t, _), w in zip(reversed(mine), reversed(weights)):
            rest.append(rest[-1] + w * stats[t][1])
        enough = np.cumsum([0, *(df for df, _, _ in mine)])
        plans.append((np.array([t for _, t, _ in mine], np.int64), np.array(weights, np.int64), rest[::-1], min(len(mine), int(np.searchsorted(enough, FIRST * k)))))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    schema, scored = "item long, doc_id long, score long", postings.select("doc_id", "n", "hits")
    start = spark.sparkContext.broadcast((plans, len(names), np.zeros(len(rows), np.int64)))
    head = scored.mapInArrow(_scored(start, k, True), schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    cutoffs = np.zeros(len(rows), np.int64)
    for r in head.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).collect():
        cutoffs[r.item] = r.score
    start.unpersist()
    sent = spark.sparkContext.broadcast((plans, len(names), cutoffs))
    ranked = scored.mapInArrow(_scored(sent, k, False), schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = spark.createDataFrame(list(enumerate(r[0] for r in rows)), "item long, item_id long")
    out = written(spark, ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    sent.unpersist()
    return out


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
terms AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM texts WHERE text IS NOT NULL),
tf AS (SELECT kind, id, term, count(*) AS tf FROM terms GROUP BY ALL),
docs AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tf WHERE kind = 'd' GROUP BY id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus WHERE kind = 'd' GROUP BY term, n_docs),
lengths AS (SELECT id, 25 + (75 * n * n_docs) // n_terms AS m FROM docs, corpus),
scores AS (
  SELECT i.id AS item_id, d.id AS doc_id, CAST(sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m))) AS BIGINT) AS score
  FROM tf i JOIN tf d ON i.term = d.term AND i.kind = 'i' AND d.kind = 'd' JOIN weights ON weights.term = i.term JOIN lengths ON lengths.id = d.id
  GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
