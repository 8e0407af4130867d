"""Undirected graphs of names as DataFrames of edges (a, b): components, degrees, hubs, distances and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import forest
from kinfold.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.selectExpr("a as src", "b as dst").unionByName(edges.selectExpr("b as src", "a as dst")).where("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes with an edge; component is the smallest node of it. See forest.components."""
    new = forest.components(edges.selectExpr("cast(a as long) as a", "cast(b as long) as b"))
    return new.selectExpr("node as id", "root as component").unionByName(new.selectExpr("root as id", "root as component").distinct())


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "id")


def hub_of(order: str = "struct(-degree, norm)") -> F.Column:
    return F.expr(f"min_by(id, {order})")


def reach(start: DataFrame, ways: DataFrame, radius: int) -> DataFrame:
    """(piece, id): all nodes within radius of start (piece, id), over the whole graph."""
    seen = frontier = start.select("piece", "id")
    for _ in range(radius):
        frontier = frontier.join(ways, F.col("id") == F.col("src")).select("piece", F.col("dst").alias("id")).distinct()
        seen = seen.unionByName(frontier)
    return seen.distinct()


def distances(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(piece, id, distance) of all nodes that each start (piece, id) reaches."""
    ways = cut(both_ways(edges))
    seen = cut(start.select("piece", "id").withColumn("distance", F.lit(0)))
    frontier, d = seen, 0
    while not frontier.isEmpty():
        d += 1
        ahead = frontier.join(ways, F.col("id") == F.col("src")).select("piece", F.col("dst").alias("id")).distinct()
        frontier = cut(ahead.join(seen, ["piece", "id"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def split_wide(nodes: DataFrame, edges: DataFrame, radius_max: int = 2, min_size: int = 5) -> DataFrame:
    """(id, piece, flagged) from nodes (id, component, norm, degree).

    A component of min_size nodes or more whose hub (most neighbours, then smallest name) reaches a node further away than
    radius_max keeps the near nodes; the far ones fall into the components that edges among them leave, and each of those
    is looked at again. Degrees and distances are those of the whole graph. All by joins: a wide component is never
    gathered in a task."""
    big = nodes.groupBy("component").agg(F.count("*").alias("whole"), F.max("degree").alias("most")).where(F.col("whole") >= min_size)
    # a hub next to all others reaches them
    big = cut(big.where(F.col("most") < F.col("whole") - 1) if radius_max >= 1 else big)
    alone = nodes.selectExpr("id", "component as piece", "false as flagged")
    if big.isEmpty():
        return alone
    work = nodes.join(big, "component").selectExpr("id", "component as piece", "norm", "degree", "whole", "false as flagged")
    final = alone.join(big.select(F.col("component").alias("piece")), "piece", "left_anti").select("id", "piece", "flagged")
    ways = cut(both_ways(edges.join(work.selectExpr("id as a"), "a", "left_semi")))
    while True:
        large = work.groupBy("piece").agg(F.count("*").alias("n"), hub_of().alias("id"), F.min("whole").alias("whole")).where(F.col("n") >= min_size)
        near = cut(reach(large, ways, radius_max))
        # all that the hub reaches is its whole component: it is wide if that is more than the near nodes
        wide = cut(near.groupBy("piece").agg(F.count("*").alias("near")).join(large, "piece").where("near < whole").select("piece"))
        rest = work.select("id", "piece", "flagged")
        if wide.isEmpty():
            return final.unionByName(rest)
        done = rest.join(wide, "piece", "left_anti")
        marked = cut(work.join(wide, "piece", "left_semi").join(near.withColumn("near", F.lit(True)), ["piece", "id"], "left"))
        final = final.unionByName(done).unionByName(marked.where("near").select("id", "piece", F.lit(True).alias("flagged")))
        far = marked.where("near is null").select("id", "piece", "norm", "degree", "whole")
        inside = ways.where("src < dst").join(far.selectExpr("id as src", "piece"), "src").join(far.selectExpr("id as dst", "piece as other"), "dst")
        parts = connected_components(inside.where("piece = other").selectExpr("src as a", "dst as b"))
        # a piece is named by its smallest node; the near piece keeps its name, which may be a far node's
        work = cut(far.join(parts, "id", "left").selectExpr("id", "-1 - coalesce(component, id) as piece", "norm", "degree", "whole", "true as flagged"))
