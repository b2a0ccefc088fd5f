"""Mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

The corpus is first reduced to a table of cells (one for each combination of source, language and topic, with its tokens).
Raking multiplies the cells' weights so that the weighted tokens meet the targets of one marginal after the other, again and
again, until all are met. Documents are then sampled with a probability in proportion to their cell's weight, or raked to an
expected size of the sample with probabilities up to 1, so that no rare cell thins the others.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

DIMS = ("source", "lang", "topic")
#: The mix of the query: shares of the corpus to this power (1 keeps them, 0 makes them equal), and rounds of raking.
TEMPER, ROUNDS = 0.8, 40
#: Least expected share of the tokens in the sample, how far a marginal may be off its target, the power of the factors where
#: the targets contradict each other, and the relative change in a round at which bounded raking ends.
LEAST_SHARE, MET, FIRM, STILL = 0.3, 0.01, 0.8, 1e-9


def topic(text: str = "text") -> F.Column:
    """A plain topic rule: legal notices, credentials, contact data, then prose by length."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.when(F.contains(t, F.lit("icense")) | F.contains(t, F.lit("opyright")), "legal")
            .when(F.contains(t, F.lit("password")) | F.contains(t, F.lit("token")) | F.contains(t, F.lit("AKIA")), "technical")
            .when(F.contains(t, F.lit("@")), "contact")
            .when(F.length(t) > 4000, "long").otherwise("short"))


def tokens(text: str = "text") -> F.Column:
    """Pieces between spaces and line ends: at least 1, so that no document is without weight."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (1 + 2 * F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long")


def tempered(cells: DataFrame, dims=DIMS, temper: float = TEMPER) -> DataFrame:
    """Targets: each value's share of all tokens to the power ``temper``, scaled to sum to all tokens (columns t_<dim>)."""
    for d in dims:
        own, every = W.partitionBy(d), W.partitionBy(F.lit(1))
        cells = cells.withColumn("_m", F.sum("tokens").over(own)).withColumn("_n", F.count("*").over(own)).withColumn("_all", F.sum("tokens").over(every))
        cells = cells.withColumn("_p", F.pow(F.col("_m") / F.col("_all"), F.lit(temper)))
        cells = cells.withColumn(f"t_{d}", F.col("_all") * F.col("_p") / F.sum(F.col("_p") / F.col("_n")).over(every))
    return cells.drop("_m", "_n", "_all", "_p")


def rake(spark: SparkSession, cells: DataFrame, dims=DIMS, rounds: int = ROUNDS, at_once: int = 10) -> DataFrame:
    """cells (dims, tokens, t_<dim>) with ``weight``: after the last round the weighted tokens of each value of the last
    dimension equal its target, those of the others to the extent that raking has converged.

    The cell table has a row for each combination of values, whatever the size of the corpus; it stays in one partition, so
    no step shuffles. It is written every ``at_once`` rounds to keep plans short.
    """
    cells = cells.withColumn("weight", F.lit(1.0))
    for done in range(0, rounds, at_once):
        cells = cells.coalesce(1)
        for _ in range(min(at_once, rounds - done)):
            for d in dims:
                cells = cells.withColumn("weight", F.col("weight") * F.col(f"t_{d}") / F.sum(F.col("weight") * F.col("tokens")).over(W.partitionBy(d)))
        cells = written(spark, cells, "cells")
    return cells


def _fitted(at: str, *by: str) -> F.Column:
    """The factor f for which the cells with the same ``by`` have ``at`` expected tokens at probability least(1, g * f).

    With the cells in order of g, f is the largest (at - tokens of the cells after this one) / (g * tokens up to this one).
    """
    own = W.partitionBy(*(by or (F.lit(1),)))
    upto = own.orderBy("g", "tokens").rowsBetween(W.unboundedPreceding, 0)
    return (F.col(at) - (F.sum("tokens").over(own) - F.sum("tokens").over(upto))) / F.sum(F.col("g") * F.col("tokens")).over(upto)


def bounded(spark: SparkSession, cells: DataFrame, share: float, dims=DIMS, rounds: int = ROUNDS, firm: float = 1.0, at_once: int = 2) -> DataFrame:
    """cells (dims, tokens, t_<dim>) with ``probability``, at most 1, so that ``share`` of all tokens are expected to be drawn.

    A value that has fewer tokens than its target at that size is asked for all it has, and the other values of the dimension
    share the rest in proportion to their targets (columns a_<dim>). Cells that reach probability 1 stay there and the others
    are raked on. With ``firm`` below 1 targets are wishes: each value's factor is raised to that power, which settles between
    targets that contradict each other instead of driving cells to 0.
    """
    every = W.partitionBy(F.lit(1))
    cells = cells.coalesce(1).withColumn("_size", share * F.sum("tokens").over(every))
    for d in dims:
        cells = cells.withColumn("g", F.col(f"t_{d}") / F.sum("tokens").over(W.partitionBy(d))).withColumn("_f", _fitted("_size"))
        cells = cells.withColumn("_f", F.max("_f").over(every)).withColumn(f"a_{d}", F.sum("tokens").over(W.partitionBy(d)) * F.least(F.lit(1.0), F.col("g") * F.col("_f")))
    cells = written(spark, cells.withColumn("g", F.lit(float(share))).select("*", *(F.lit(1.0).alias(f"u_{d}") for d in dims)), "bounds")
    for done in range(0, rounds, at_once):
        cells = cells.coalesce(1)
        for _ in range(min(at_once, rounds - done)):
            cells = cells.withColumn("_before", F.col("g"))
            for d in dims:
                cells = cells.withColumn("_f", _fitted(f"a_{d}", d)).withColumn("_f", F.pow(F.col(f"u_{d}") * F.max("_f").over(W.partitionBy(d)), F.lit(firm)))
                cells = cells.withColumn("g", F.col("g") / F.col(f"u_{d}") * F.col("_f")).withColumn(f"u_{d}", F.col("_f"))
        cells = written(spark, cells, "cells")
        moved = cells.agg(F.max(F.abs(F.col("g") / F.col("_before") - 1))).first()[0]
        if moved is None or moved < STILL:
            break
    cells = cells.coalesce(1).withColumn("_f", _fitted("_size"))
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("g") * F.max("_f").over(every))).drop("_f", "_size", "g", "_before", *(f"u_{d}" for d in dims))


def marginals(cells: DataFrame, dims=DIMS) -> DataFrame:
    """(dim, value, target, expected, error) of cells with a_<dim> and probability: expected tokens of the sample and their
    relative distance from the target."""
    parts = [cells.groupBy(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")).agg(F.max(f"a_{d}").alias("target"), F.sum(F.col("probability") * F.col("tokens")).alias("expected")) for d in dims]
    return reduce(DataFrame.unionByName, parts).withColumn("error", F.abs(F.col("expected") / F.col("target") - 1))


def mixed(spark: SparkSession, cells: DataFrame, dims=DIMS, rounds: int = ROUNDS, share: float | None = None) -> DataFrame:
    """cells (dims, tokens, t_<dim>) with ``weight``, ``probability`` and a_<dim>, the expected tokens asked for.

    With ``share`` None, probabilities are weights over the largest weight, if the targets are met so and at least
    ``LEAST_SHARE`` of the tokens are expected; otherwise, and with a ``share``, they are ``bounded`` ones.
    """
    every = W.partitionBy(F.lit(1))
    if share is None:
        plain = rake(spark, cells, dims, rounds).coalesce(1).withColumn("probability", F.col("weight") / F.max("weight").over(every))
        plain = written(spark, plain.select("*", *((F.col(f"t_{d}") / F.max("weight").over(every)).alias(f"a_{d}") for d in dims)), "plain")
        kept, = plain.agg(F.sum(F.col("probability") * F.col("tokens")) / F.sum("tokens")).first()
        if kept is None or (kept >= LEAST_SHARE and _error(plain, dims) <= MET):
            return plain
        share = LEAST_SHARE
    for firm in (1.0, FIRM):
        out = written(spark, bounded(spark, cells, share, dims, rounds, firm), "bounded")
        error = _error(out, dims)
        if error <= MET:
            break
    else:
        warnings.warn(f"mixing: the targets contradict each other; the worst value is {error:.1%} off its target (see marginals)", stacklevel=2)
    return out.withColumn("weight", F.col("probability") / share)


def _error(cells: DataFrame, dims) -> float:
    error = marginals(cells, dims).agg(F.max("error")).first()[0]
    return 0.0 if error is None else error


def mix(spark: SparkSession, docs: DataFrame, dims=DIMS, temper: float = TEMPER, rounds: int = ROUNDS, seed: str = "mix", share: float | None = None) -> DataFrame:
    """``docs`` (doc_id, dims, tokens, any other columns) with ``weight`` and ``probability``, and ``drawn``: whether sampled.

    ``share`` is the expected share of all tokens in the sample; without it, it follows from the rarest cell (``mixed``), but
    is at least ``LEAST_SHARE``. No probability is 0. The draw is a hash of doc_id and the seed: repeated rows and re-run tasks
    draw alike. A null source, language or topic is a value of its own; a null doc_id draws like the text 'null'. An empty
    table gives no rows.
    """
    cells = docs.groupBy(*dims).agg(F.sum("tokens").alias("tokens"))
    cells = mixed(spark, written(spark, tempered(written(spark, cells, "margins").coalesce(1), dims, temper), "targets"), dims, rounds, share)
    mark = "_"  # names of the cells' columns that no document column has
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    cells = written(spark, cells.coalesce(1).select(*(F.col(d).alias(mark + d) for d in dims), "weight", "probability"), "weights")
    same = reduce(lambda a, b: a & b, (docs[d].eqNullSafe(cells[mark + d]) for d in dims))  # Spark's statistics choose the join
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)
    return docs.drop("weight", "probability", "drawn").join(cells, same).drop(*(mark + d for d in dims)).withColumn("drawn", draw < F.col("probability"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", topic().alias("topic"), tokens().alias("tokens"))
    docs = written(spark, docs, "documents")  # ids and cells only: the texts are read once
    shown = F.when(F.col("probability") < 5e-7, F.col("probability")).otherwise(F.round("probability", 6)).alias("probability")
    return mix(spark, docs).filter("drawn").select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), shown)


def _sql() -> str:
    parts = ["""d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, CAST(1 + 2 * length(t) - length(replace(t, ' ', '')) - length(replace(t, chr(10), '')) AS BIGINT) AS tokens,
     CASE WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'legal' WHEN contains(t, 'password') OR contains(t, 'token') OR contains(t, 'AKIA') THEN 'technical'
          WHEN contains(t, '@') THEN 'contact' WHEN length(t) > 4000 THEN 'long' ELSE 'short' END AS topic FROM documents)""",
             "m0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, 1.0::DOUBLE AS w FROM d GROUP BY ALL)"]
    for dim in DIMS:
        parts.append(f"p_{dim} AS (SELECT {dim}, pow(sum(tokens) / (SELECT sum(tokens) FROM m0), {TEMPER}) AS p FROM m0 GROUP BY {dim})")
    target = ", ".join(f"(SELECT sum(tokens) FROM m0) * (SELECT p FROM p_{d} x WHERE x.{d} IS NOT DISTINCT FROM m0.{d}) / (SELECT sum(p) FROM p_{d}) AS t_{d}" for d in DIMS)
    parts.append(f"c0 AS MATERIALIZED (SELECT *, {target} FROM m0)")
    for i in range(ROUNDS * len(DIMS)):
        d = DIMS[i % len(DIMS)]
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{d} / sum(w * tokens) OVER (PARTITION BY {d}) AS w) FROM c{i})")
    last = f"c{ROUNDS * len(DIMS)}"
    parts.append(f"f AS (SELECT source, lang, topic, w, round(w / (SELECT max(w) FROM {last}), 6) AS p FROM {last})")
    same = " AND ".join(f"d.{x} IS NOT DISTINCT FROM f.{x}" for x in DIMS)
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(f.w, 6) AS weight, f.p AS probability FROM d JOIN f ON {same}
WHERE CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':mix'), 1, 13) AS BIGINT) / 4503599627370496.0 < f.p"""


OP10_SQL = _sql()
