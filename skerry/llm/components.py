"""Connected components by randomised contraction (Bögeholz, Brand and Todor, 2020), each round a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (node, component): the smallest node reachable. Nodes without an edge to another are left out.

    A round maps every node to the first of itself and its neighbours, in an order that is new in each round, and puts the images in
    the place of the nodes; about half of them are left at most, so later rounds are small, and stars are done in the first. The maps
    of all rounds are joined at the end. Every step is written to the shared folder; a node with very many neighbours is a skewed join
    key, which adaptive execution splits, and its minimum is taken by partial aggregation.
    """

    def order(node: Column, i: int) -> Column:
        return F.xxhash64(node, F.lit(i)) if i else node  # by id at first: the hubs of stars have the smallest

    cur = scratch.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    maps: list[DataFrame] = []
    while not cur.isEmpty():
        i = len(maps)
        if i == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order(F.col("b"), i)).alias("least"), F.min_by("b", order(F.col("b"), i)).alias("b"))
        first = first.select(F.col("a").alias("node"), F.when(order(F.col("a"), i) < F.col("least"), F.col("a")).otherwise(F.col("b")).alias("to"))
        maps.append(scratch.write(first, f"{name}-m{i}"))
        ends = [maps[i].select(F.col("node").alias(c), F.col("to").alias(f"{c}1")) for c in "ab"]
        moved = cur.join(ends[0], "a").join(ends[1], "b").filter("a1 <> b1")
        cur = scratch.write(moved.select(F.least("a1", "b1").alias("a"), F.greatest("a1", "b1").alias("b")).distinct(), f"{name}-e{i + 1}")
        scratch.drop(f"{name}-e{i}")
    if not maps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps.pop()
    while maps:
        later = out.select(F.col("node").alias("to"), F.col("to").alias("end"))
        out = maps.pop().join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    out = scratch.write(out, f"{name}-map")
    lowest = out.groupBy("to").agg(F.min("node").alias("component"))
    return out.join(scratch.write(lowest, f"{name}-lowest"), "to").select("node", "component")
