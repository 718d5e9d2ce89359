"""Connected components of an edge table, by contraction with pointer jumping. Nothing is collected; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch


def _relabelled(edges: DataFrame, to: DataFrame) -> DataFrame:
    a, b = to.select(F.col("node").alias("hi"), F.col("to").alias("_hi")), to.select(F.col("node").alias("lo"), F.col("to").alias("_lo"))
    both = edges.join(a, "hi", "left").join(b, "lo", "left").select(F.coalesce("_hi", "hi").alias("x"), F.coalesce("_lo", "lo").alias("y")).where("x <> y")
    return both.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` of every node of an edge; the label is the component's smallest node.

    Each round points every node at its smallest neighbour below it, jumps pointers until they rest, and contracts the edges; a round
    at least halves the nodes of every component that still has edges.
    """
    edges = scratch.table(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    labels = scratch.table(edges.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        to = scratch.table(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to")), "to")
        while True:
            step = to.select(F.col("node").alias("to"), F.col("to").alias("_next"))
            moved = scratch.table(to.join(step, "to", "left").select("node", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")), "jump")
            to = moved.select("node", "to")
            if moved.where("moved").isEmpty():
                break
        labels = scratch.table(labels.join(to.select(F.col("node").alias("label"), F.col("to").alias("_to")), "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
        edges = scratch.table(_relabelled(edges, to), "edges")
    return labels
