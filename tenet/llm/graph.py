"""Connected components of an edge table, by alternating star contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.llm.common import delete, stage


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: (node, root) for each node that has an edge; root is the component's smallest node.

    Every round hangs each node's larger neighbours on its smallest one, then its smaller ones likewise; edges never grow in
    number, and a round's result is written to the shared folder. Minima are aggregated before they are shuffled, so a hub
    meets in no single task. Rounds end when the edges stay the same."""
    directed = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, now = stage(spark, directed, "edges")
    before = None
    while (seen := digest(now)) != before:
        before = seen
        both = now.union(now.select("b", "a"))
        small = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, (path, now) = path, stage(spark, star.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        delete(spark, last)
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def digest(edges: DataFrame) -> tuple:
    """Of a set of edges: their number and two XORs of their hashes, which, unlike sums, no number of edges overflows."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
