"""Connected components as alternating stars, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, written

MOST_ROUNDS, HUB = 60, 1000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _least(sided: DataFrame) -> DataFrame:
    """Each u's least neighbour m, u itself included, and how many edges it has, as a written table."""
    return written(sided.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")


def _star(sided: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Each u's least neighbour beside its edges. least: of _least().

    A hub, with HUB edges or more and at least a thousandth of all, gets its neighbour from a broadcast: with so many edges each there are no more than
    2000 hubs. All other nodes meet theirs in a join whose largest key has fewer rows.
    """
    hub = F.col("n") >= max(HUB, edges // 1000)
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    others = sided.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u")
    return sided.join(hubs, "u").unionByName(others)


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every node of edges (a, b): component is its component's least node.

    Large stars link every larger neighbour of a node to the node's least neighbour, small stars the others; both keep
    components and end in one star a component after about log(n) rounds. Each step of a round is a written table, so lineage
    stays short, a lost executor costs that step's tasks only, and no plan grows large: the driver plans a query anew whenever one of its
    exchanges ends, and a whole round as one query has dozens. Loops and rows with nulls are left out.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        # every larger neighbour v of u goes to m; v > u and so v > m
        sided = _both_ways(now)
        least = _least(sided)
        large = written(_star(sided, least, mark[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-stars")
        release(now)
        release(least)
        # now a > b on each edge: u's smaller neighbours and u go to m
        sided = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = _least(sided)
        star = _star(sided, least, mark[0])
        small = star.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = written(small, tag)
        release(large)
        release(least)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first())
