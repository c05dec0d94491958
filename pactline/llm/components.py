"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import attached, stored


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for all nodes of the links (a, b: long).

    Contraction: in every round each node joins one among itself and its neighbours, and only links
    between different nodes remain. In even rounds that is the smallest node, so stars around it,
    which is how tasks link what they compare, are one node at once. In odd rounds it is the one with
    the smallest hash, so the number of nodes falls by a constant factor every two rounds, whatever
    the shape. Each round, on the way up and down, is written to the shared folder: no plan grows with
    the number of rounds. The links of a node, and the nodes of a component, are dealt over all
    tasks where they meet a lookup.
    """
    links = links.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stored(links, "component-links")
    joined, turn = [], 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first, second = (F.xxhash64(F.lit(turn), c) if turn % 2 else F.col(c) for c in ("b", "a"))
        nearest = F.min(F.struct(first.alias("order"), F.col("b").alias("b")))
        own = F.struct(second.alias("order"), F.col("a").alias("b"))
        heads = stored(both.groupBy("a").agg(nearest.alias("nearest")).select(
            F.col("a").alias("node"), F.least(own, "nearest")["b"].alias("head")), "component-heads")
        joined.append(heads)
        for end, other in (("a", "b"), ("b", "a")):
            left = attached(left, heads.withColumnRenamed("node", end), [end], [other]).drop(
                end).withColumnRenamed("head", end)
            if end == "b":
                left = left.where(F.col("a") != F.col("b")).select(
                    F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            left = stored(left, "component-links")
        turn += 1
    if not joined:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = joined[-1]
    for heads in reversed(joined[:-1]):
        # A node's head in this round is a node of the next one, or has no more links.
        later = found.select(F.col("node").alias("head"), F.col("head").alias("last"))
        found = stored(attached(heads, later, ["head"], ["node"], "left").select(
            "node", F.coalesce("last", "head").alias("head")), "component-nodes")
    smallest = found.groupBy("head").agg(F.min("node").alias("component"))
    return attached(found, smallest, ["head"], ["node"]).select("node", "component")
