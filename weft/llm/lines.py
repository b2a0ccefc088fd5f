"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a text are a window. Where the same window occurs more than once in the corpus, all its
occurrences but the first (by document, then position) go; a line is removed if a removed occurrence covers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


#: Copies of a repeated row that one step puts out.
PIECE = 4096


def _lines(text: str) -> F.Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _versions(text: str) -> tuple[F.Column, F.Column]:
    """128 bits that stand for a row's text, beside its doc_id."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(F.lit(1), t).alias("v1"), F.xxhash64(F.lit(2), t).alias("v2")


_ROW = ("doc_id", "v1", "v2")


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """Every window with a non-blank character: doc_id, v1, v2 (the row), at (its first line, from 0), a, b (its lines)."""
    at = F.sequence(F.lit(0), F.size("l") - size)
    window = F.transform(at, lambda i: F.struct(i.alias("at"), *(F.xxhash64(F.lit(seed), *(F.get(F.col("l"), i + k) for k in range(size))).alias(name) for seed, name in ((0, "a"), (1, "b"))),
                                                F.concat(*(F.get(F.col("l"), i + k) for k in range(size))).rlike(r"\S").alias("full")))
    return (docs.select("doc_id", *_versions("text"), _lines("text").alias("l")).filter(F.size("l") >= size)
            .select(*_ROW, F.explode(window).alias("w")).filter("w.full").select(*_ROW, "w.at", "w.a", "w.b"))


def repeated_windows(spark: SparkSession, docs: DataFrame, size: int = 3) -> DataFrame:
    """Occurrences (doc_id, v1, v2, at) that go from a row, if it is the first of rows with its id and text."""
    spread = written(spark, windows(docs, size), "windows")
    # rows without an id come after those with one; rows equal in id and text are one place
    place = F.struct(F.col("doc_id").isNull().alias("none"), *_ROW, "at")
    first = spread.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).select("a", "b", "first")
    return spread.join(first, ["a", "b"]).filter(place != F.col("first")).select(*_ROW, "at")


def dedup_lines(spark: SparkSession, docs: DataFrame, size: int = 3) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, n_lines, n_removed, kept_text.

    Lines end at a newline and are compared as they are; a null or empty text is one empty line. Windows without any
    non-blank character are left alone, and so are texts of fewer lines. All is judged on the input: in a run of equal lines
    the first window's own later lines are covered by the windows after it, so one line of the run stays. Documents come in the
    order of doc_id (null last), then of a hash of their text; of rows with equal doc_id (or none) and text one is the first
    occurrence, and the others lose every window. Null ids are ids like others, an empty table gives no rows, whole texts are
    read, and other columns, whatever their names, are not looked at. Two 64-bit hashes stand for a window's lines.
    """
    docs = docs.select("doc_id", "text")
    covered = F.flatten(F.transform(F.col("gone"), lambda i: F.sequence(i, i + size - 1)))
    kept = F.when(F.col("gone").isNull(), F.col("l")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size("l") - 1), covered), lambda i: F.get(F.col("l"), i)))

    def shown(rows: DataFrame) -> DataFrame:
        return rows.withColumn("l", _lines("text")).withColumn("kept", kept).select(
            "doc_id", F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))

    def joined(rows: DataFrame, gone: DataFrame) -> DataFrame:
        """``gone`` of each row: the null ids have a join of their own, as null equals nothing."""
        own = gone.groupBy(*_ROW).agg(F.collect_set("at").alias("gone"))
        some = rows.filter(F.col("doc_id").isNotNull()).join(own.filter(F.col("doc_id").isNotNull()), list(_ROW), "left")
        none = rows.filter(F.col("doc_id").isNull()).join(own.filter(F.col("doc_id").isNull()).drop("doc_id"), ["v1", "v2"], "left")
        return some.unionByName(none)

    rows = docs.select("doc_id", "text", *_versions("text"))
    gone = repeated_windows(spark, docs, size)
    again = written(spark, rows.groupBy(*_ROW).agg(F.count("*").alias("n")).filter("n > 1"), "again")
    if again.isEmpty():
        return shown(joined(rows, gone))
    # rows that are equal in id and text: once as the first occurrence, else without any of their windows
    equal = again.select(F.struct("doc_id", "v1", "v2").alias("k"), "n")
    row = F.struct("doc_id", "v1", "v2")
    single = rows.withColumn("k", row).join(equal.select("k"), "k", "left_anti").drop("k")
    several = rows.withColumn("k", row).join(equal, "k").groupBy("k", "n").agg(F.min("text").alias("text")).select("k.*", "text", "n")
    several = written(spark, several, "several")
    every = written(spark, windows(several, size), "every").select(*_ROW, "at")
    copies = joined(several.select("doc_id", "text", "v1", "v2", "n"), every)
    # a row that repeats very often is dealt out in pieces
    dealt = copies.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 2) div {PIECE}")))).repartition("v1", "v2", "piece")
    others = shown(dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.col("n") - 1 - F.col("piece") * PIECE)))))
    return shown(joined(single.unionByName(several.drop("n")), gone)).unionByName(others)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i AS pos, [l[i + 1], l[i + 2], l[i + 3]] AS w FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM l WHERE len(l) >= 3)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM w WHERE regexp_matches(array_to_string(w, ''), '[^ \t\n\x0b\f\r]')),
gone AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM f WHERE n > 1),
s AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM l),
k AS (SELECT s.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY s.pos), '') AS kept
      FROM s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
