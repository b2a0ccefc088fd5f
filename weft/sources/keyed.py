"""Tables with a key on plain Parquet, in a folder that all machines share.

Rows are dealt to buckets by a hash of their key. An upsert reads the buckets that its keys fall into, writes them anew beside
the old files, and then writes a manifest that names, for each bucket, the commit whose files count. Buckets without new keys
keep their files. Readers take the newest manifest, so they see a commit whole or not at all. The manifest's version is the
epoch of a stream (or the next number): an epoch that is there already is a replay and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """``schema`` is a DDL string; ``keys`` are some of its columns."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: tuple[str, ...], buckets: int = 32):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root, schema, list(keys), buckets

    def manifest(self) -> tuple[int, dict[int, str]]:
        """(version, commit of each bucket); version -1 before the first commit."""
        try:
            every = self.spark.read.schema("bucket int, commit string, v long").parquet(f"{self.root}/manifest")
            rows = every.filter(F.col("v") == every.select(F.max("v")).scalar()).collect()  # at most one for each bucket
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, {}
        return (rows[0].v, {r.bucket: r.commit for r in rows if r.bucket is not None}) if rows else (-1, {})

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets."""
        commits = self.manifest()[1]
        paths = [f"{self.root}/data/{commit}/bucket={b}" for b, commit in sorted(commits.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def buckets_of(self, rows: DataFrame) -> set[int]:
        return {r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # at most the number of buckets

    def of(self, rows: DataFrame) -> DataFrame:
        """The table's rows with the keys of ``rows``; other buckets are not read."""
        return self.read(self.buckets_of(rows)).join(rows.select(*self.keys).distinct(), self.keys, "left_semi")

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, epoch: int | None = None) -> bool:
        """Put ``rows`` (one for each key) into the table; whether anything was done. ``merge(old rows, new rows)`` gives the rows of
        the touched buckets; by default a new row takes the place of the old one with its key."""
        version, commits = self.manifest()
        if epoch is not None and epoch <= version:
            return False
        touched = self.buckets_of(rows)
        commit = uuid.uuid4().hex
        if touched:
            old = self.read(touched)
            replaced = merge or (lambda old, new: old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new.select(*old.columns)))
            out = replaced(old, rows).select(*old.columns).withColumn("bucket", self.bucket())
            out.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{commit}")
        commits = {**commits, **dict.fromkeys(touched, commit)}
        version = version + 1 if epoch is None else epoch
        named = self.spark.createDataFrame([*commits.items()] or [(None, None)], "bucket int, commit string")
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return True
