"""Connected components of a graph of links, by contraction.

Each round every node moves to the node of lowest rank (a hash of its id, so paths shrink fast) among itself
and its neighbours, links move along, and links inside a node go. Rounds grow with the logarithm of a
component's size. What is joined is written to the shared folder first: lineage stays short, and Spark can
split a partition with a node of very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b: long)."""
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(11)).alias("rank"), F.col(c).alias("node"))
    edges = written(links.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    labels = written(edges.selectExpr("explode(array(a, b)) as node").distinct().withColumn("at", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        moves = written(lowest.select(F.col("a").alias("at"), F.least("m", rank("a"))["node"].alias("to")), "moves")
        moved = edges.join(moves, edges["a"] == moves["at"]).select(F.col("to").alias("a"), "b")
        moved = moved.join(moves, moved["b"] == moves["at"]).select("a", F.col("to").alias("b")).where("a <> b")
        edges = written(moved.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
        labels = written(labels.join(moves, "at", "left").select("node", F.coalesce("to", "at").alias("at")), "labels")
    smallest = written(labels.groupBy("at").agg(F.min("node").alias("component")), "smallest")
    return labels.join(smallest, "at").select("node", "component")
