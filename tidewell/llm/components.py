"""Connected components by distributed union-find.

In each round every node hooks to the neighbour (or itself) of the lowest rank, ranks being hashes of the node and the round, takes
that one's choice as its own, and the edges are contracted accordingly. Ranks are drawn anew in each round, so chains of any order
shrink by a constant factor a round on average. A round is a few joins on node ids whose skewed sides Spark splits, and its
result is written to the shared folder, so a lost executor costs one round at most. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.scratch import drop, keep


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) with a below b; null ends and loops are left out."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the smallest node of the component."""
    edges = keep(_canonical(edges), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = F.xxhash64(F.lit(len(maps)), F.col("b"))
        near = edges.union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
        hooked = keep(near.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank.alias("rank"), F.col("b"))).alias("up")).select("node", F.col("up.b").alias("up")), "hooked")
        parent = keep(hooked.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root"), "parents")
        a, b = (parent.select(F.col("node").alias(c), F.col("root").alias(f"{c}2")) for c in "ab")
        smaller = keep(_canonical(edges.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "edges")
        drop(hooked, edges)
        edges = smaller
        maps.append(parent)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for lower in reversed(maps[:-1]):
        out = lower.join(out.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    out = keep(out, "leaders")
    least = out.groupBy("root").agg(F.min("node").alias("least"))
    named = keep(out.join(least, "root").select("node", F.col("least").alias("root")), "components")
    drop(edges, out, *maps)
    return named
