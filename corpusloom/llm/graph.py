"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b), with ids that are hashes.

    In each round a node goes to the least among itself and its neighbours, and the edges are
    contracted. As ids are in random order, a round leaves a fixed share of the nodes in the mean,
    so the number of rounds grows with the logarithm. Minima are aggregated before they are
    shuffled; each round is written, so lost executors cost one round.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        step = written(least.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "step")
        maps.append(step)
        one = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        two = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(one, "a").join(two, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = written(moved.where("a <> b").distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].withColumnRenamed("to", "component")
    for step in maps[1:]:
        onward = step.withColumnRenamed("node", "component")
        found = found.join(onward, "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
    return written(found, "components")
