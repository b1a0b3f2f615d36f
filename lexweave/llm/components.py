"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def connected_components(ws: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> node, component: the smallest node that links reach, for every node with a link.

    Each round hangs every node's larger neighbours on its smallest one, then the smaller ones. Minima are combined before
    they are exchanged; the joins have one row a node on one side, written before, so Spark splits hot nodes.
    Every round ends in a table in the shared folder. Edges with a null end and loops are dropped, repeated ones count once; an empty
    table gives no rows. Raises if the sets still change after `rounds` rounds (their number grows with the logarithm of the nodes).
    """
    pairs = ws.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(pairs)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.save(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
        large = ws.save(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least_below = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least_below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.save(small.unionByName(least_below.select("u", F.col("m").alias("v"))).distinct(), "edges")
        ws.drop(least, large, least_below, pairs)
        pairs, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(pairs: DataFrame) -> tuple[int, int, int]:
    """Changes when the set of pairs does: its size, and a xor and a sum of hashes (of 40 bits and either sign, so it stays small)."""
    x = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count("*"), F.coalesce(F.bit_xor(x), F.lit(0)), F.coalesce(F.sum(F.shiftright(x, 24)), F.lit(0))).first())
