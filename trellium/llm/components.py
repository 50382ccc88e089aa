"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.work import Work


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node among itself and all neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    smaller = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, folder: Work, name: str) -> DataFrame:
    """(node, label) for every node of an edge (a, b): the smallest node reachable.

    Alternating stars: the rounds grow with the logarithm of a component's
    size, no node's neighbours are ever gathered, and each round is written to
    the shared folder, so a lost executor costs no earlier round.
    """
    oriented = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current = folder.save(oriented, f"{name}-0")
    before, step = None, 0
    while True:
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if seen == before or not seen.n:
            break
        before, step = seen, step + 1
        current = folder.save(_small_star(_large_star(current)), f"{name}-{step}")
        if step > 1:
            folder.drop(f"{name}-{step - 2}")
    return current.select(F.col("a").alias("node"), F.col("b").alias("label"))


def label_nodes(nodes: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``nodes`` with the label of ``column``; nodes without edges are their own."""
    found = labels.withColumnRenamed("node", column)
    return nodes.join(found, column, "left").withColumn("label", F.coalesce("label", F.col(column)))
