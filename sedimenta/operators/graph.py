"""Undirected graphs as (a, b) edges: components, orphans, degrees and component statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.counts import numbered
from sedimenta.session import cut


def keep_known(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges whose two ends are nodes."""
    known = nodes.select(F.col(node).alias("__n"))
    return edges.join(known, F.col("a") == F.col("__n"), "left_semi").join(known, F.col("b") == F.col("__n"), "left_semi")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the lowest node of each component; nodes without edges are their own.

    Alternates large-star and small-star steps, which need a number of rounds that grows with the logarithm of the
    nodes, not with a path's length. A round only groups edges by a node and keeps a minimum, so that a node with most
    edges is an aggregation like any other. Rounds are cut by checkpoints.
    """
    links = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while True:  # a fixed point is reached on every graph; rounds grow with the logarithm of its nodes
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return nodes.select(F.col(node).alias("node")).distinct().join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free 64-bit sums of distinct edges; equal edges have equal marks."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64(F.lit(1), "v", "u").cast("decimal(38,0)"))).first())


def orphans(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes in no edge."""
    ends = edges.select(F.col("a").alias("__n")).unionByName(edges.select(F.col("b").alias("__n")))
    return nodes.join(ends, F.col(node) == F.col("__n"), "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, degree, neighbours): edges from and to each node, and how many different neighbours it has."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    each = ends.groupBy("node", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return each.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), (F.sum("o") + F.sum("i")).alias("degree"), F.count("*").alias("neighbours"))


def component_stats(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component of ``members`` (node, component, length, coverage): size, length, coverage weighted by length, edges, rank by size."""
    sums = members.groupBy("component").agg(F.count("*").alias("n_nodes"), F.sum("length").alias("length"), F.try_divide(F.sum(F.col("coverage") * F.col("length")), F.sum("length")).alias("coverage"))
    inside = edges.join(members.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.count("*").alias("n_edges"))
    out = sums.join(inside, "component", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out


def ranked_by_size(stats: DataFrame) -> DataFrame:
    """Components numbered from 1 by size, then by their lowest node."""
    return numbered(stats, [F.desc("n_nodes"), F.asc("component")], "rank")
