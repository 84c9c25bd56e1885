"""Lineage over an edge list: ancestors by rounds of joins, upstream edges, dangling edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def ancestors(edges: DataFrame, starts: DataFrame, most: int = 64) -> DataFrame:
    """(start, node, depth): every node that leads to a start, with every length of path.

    A round joins the last round's nodes with the edges into them and is staged. The graph is acyclic, so rounds end; if there are
    more than `most`, it is an error: a cycle, or paths longer than expected.
    """
    into = staged(edges.select(F.col("to_node").alias("node"), F.col("from_node").alias("parent")).distinct(), "edges")
    last = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    rounds = [last]
    for depth in range(1, most + 2):
        last = staged(last.join(into, "node").select("start", F.col("parent").alias("node"), F.lit(depth).alias("depth")).distinct(), "round")
        if last.isEmpty():
            break
        if depth > most:
            raise ValueError(f"paths of more than {most} edges, or a cycle")
        rounds.append(last)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def upstream_edges(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, from_node, to_node): the edges on all paths into each start."""
    nodes = ancestors(edges, starts).select("start", "node").distinct()
    return nodes.join(edges, nodes["node"] == edges["to_node"]).select("start", "from_node", "to_node")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_node, to_node, side) of edges whose end on that side is no known node."""
    sides = [edges.join(nodes.select(F.col("node").alias(f"{s}_node")), f"{s}_node", "left_anti").select("from_node", "to_node", F.lit(s).alias("side")) for s in ("from", "to")]
    return sides[0].unionByName(sides[1])
