"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes of undirected edges (a, b); component is the smallest id that can be reached.

    Each round points every node to its smallest neighbour, follows the pointers by doubling, and contracts the edges to the
    roots. Rows with a = b or a null do nothing. Every step is written, so lineage stays short.
    """
    edges = written(spark, edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "pointers")
        while True:
            up = to.filter("id <> root").select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = written(spark, to.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumped")
            to = jumped.select("id", "root")
            if jumped.filter("moved").isEmpty():
                break
        if nodes is None:
            nodes = to
        else:
            nodes = nodes.join(to.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        nodes = written(spark, nodes, "nodes")
        a, b = (to.withColumnsRenamed({"id": c, "root": f"r{c}"}) for c in "ab")
        edges = written(spark, edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return spark.createDataFrame([], "id long, component long") if nodes is None else nodes.withColumnRenamed("root", "component")
