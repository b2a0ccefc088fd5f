"""Training corpus from raw documents: quality, near duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate as bench
from weft.llm import mixing, neardup, quality, sharding
from weft.llm.common import table, written

#: A document stays from this score on; near duplicates share this much of their 5-word shingles; number of shards;
#: share of the tokens that the mix keeps.
LEAST_SCORE, WORDS, PERCENT, SHARDS, MIX_SHARE = 0.3, 5, 80, 40, 0.4


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows among ``docs``.

    Only the text decides: null and empty texts are scored like any other, rows with repeated or null ids one by one, whole texts
    however long. Without labels every text scores 0.5 and stays; an empty table gives no rows; all columns are kept as they are.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(model) >= LEAST_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Rows that share a doc_id, and rows without one, are documents of their own: they stay unless they are near duplicates of
    another row, and a row with an id of its own stays before them. Of equal rows one stays. Texts without words (null, empty)
    are in no group and stay; whole texts are compared; an empty table gives no rows; all columns are kept as they are.
    """
    shared = written(spark, docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "shared")
    nameless = docs.filter(F.col("doc_id").isNull())
    own, odd = docs, None
    if not (shared.isEmpty() and nameless.isEmpty()):
        own = docs.filter(F.col("doc_id").isNotNull()).join(shared, "doc_id", "left_anti").select(docs.columns)
        last = own.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0]
        odd = docs.join(shared, "doc_id", "left_semi").select(docs.columns).unionByName(nameless)
        odd = written(spark, odd.select(F.struct(*docs.columns).alias("row"), (F.lit(last + 1) + F.monotonically_increasing_id()).alias("key")), "odd")
    rows = own.select("doc_id", "text")
    if odd is not None:
        rows = rows.unionByName(odd.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    found = written(spark, neardup.near_duplicates(spark, rows, WORDS, PERCENT).select("doc_id", "kept"), "found")
    # those that go are few: joining with them leaves the texts where they are for longer than joining with those that stay
    gone = written(spark, found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    out = own.join(gone, "doc_id", "left_anti").select(docs.columns)
    return out if odd is None else out.unionByName(odd.join(gone.withColumnRenamed("doc_id", "key"), "key", "left_anti").select("row.*"))


def unseen_by_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item.

    Null and empty texts cover none and stay; whole texts are tiled, however long; rows with repeated or null ids are judged one
    by one, equal texts alike. An empty table or benchmark drops nothing; all columns are kept as they are.
    """
    return docs.filter(~bench.contaminated(spark, table(spark, sf_dir, "benchmark")))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str, share: float = MIX_SHARE) -> DataFrame:
    """A sample of about ``share`` of the tokens whose sources, languages and topics have their target shares.

    Null sources and languages are values of their own; a null or empty text has one token. A row is drawn by a hash of its
    doc_id, so rows that share one (or have none) are drawn together if their cells' probabilities agree. An empty table gives
    no rows; all columns are kept as they are.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "lang", mixing.topic().alias("topic"), mixing.tokens().alias("tokens"))
    return mixing.mix(spark, rows, share=share).filter("drawn").select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it (``sharding.assign``): null and empty texts are placed too, rows with repeated or
    null ids one by one, equal texts together. An empty table gives no rows; other columns are left behind."""
    return sharding.assign(spark, docs, SHARDS)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("decontaminate", unseen_by_benchmarks), ("mix", target_mix), ("shards", shards)]

#: SQL can express neither the trained classifier nor the tiling: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, share: float = MIX_SHARE) -> DataFrame:
    """All stages over the documents of ``sf_dir``; ``share`` of the tokens that reach the mix are expected to be drawn."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir, share) if stage is target_mix else stage(spark, docs, sf_dir), name)
    return docs
