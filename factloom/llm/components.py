"""Connected components by contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges`` (``a``, ``b``); the least node names it.

    In each round every node moves to the least of itself and its neighbours, and the
    edges are rewritten; a component shrinks by half at least, so the rounds are few.
    The least neighbour is an aggregate that combines before the shuffle, and the joins
    that follow are plain ones, whose large partitions Spark splits; nothing is
    collected. Every round is written, so lost executors cost one round at most.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = stage(both(edges).filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        moves = edges.groupBy("a").agg(F.min("b").alias("_least"))
        moves = stage(moves.select("a", F.least("a", "_least").alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            to = moves.select(F.col("a").alias("component"), "to")
            labels = labels.join(to, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
            labels = stage(labels, "labels")
        first = edges.join(moves, "a").select(F.col("to").alias("a"), "b")
        second = first.join(moves.select(F.col("a").alias("b"), "to"), "b").select("a", F.col("to").alias("b"))
        edges = stage(second.filter("a <> b").distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stage(labels, "labels")
