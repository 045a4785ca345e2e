"""Paths by bounded expansion: trails (no edge twice), breadth-first distances, neighbourhoods, shortest paths.

A frontier grows by one join with the edges a round; seeds keep it small, and nothing is collected. While it is counted to be
small, the edges are narrowed down to its nodes, by broadcast, before anything else is done with them: Spark carries that to the
scans under the edges, so that what a round shuffles goes with the frontier and not with the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.state import saved

#: Nodes that a frontier which is broadcast may have.
BROADCAST_NODES = 300_000


def numbered(edges: DataFrame, undirected: bool = False, front: DataFrame | None = None) -> DataFrame:
    """src, dst, rel and an edge id that both directions share; parallel edges of one type are one edge.

    With front, a table made by saved() whose column node is read, only edges that begin at its nodes.
    """
    if front is None:
        at = lambda column: edges
    else:
        ids = front.select("node").distinct()
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids
        at = lambda column: edges.join(ids.withColumnRenamed("node", column), column, "left_semi")
    edge = F.concat_ws("|", "src", "rel", "dst")
    e = at("src").select("src", "dst", "rel").distinct().withColumn("edge", edge)
    if undirected:
        back = at("dst").select("src", "dst", "rel").filter("src <> dst").distinct().withColumn("edge", edge)
        e = e.unionByName(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "edge"))
    return e


def neighbours(edges: DataFrame, front: DataFrame, undirected: bool) -> DataFrame:
    """src, dst of the edges that begin at nodes of front, as above; parallel ones may come twice."""
    ids = front.select("node").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids
    e = edges.select("src", "dst").join(ids.withColumnRenamed("node", "src"), "src", "left_semi")
    if undirected:
        back = edges.select("src", "dst").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
        e = e.unionByName(back.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e


def trails(edges: DataFrame, starts: DataFrame, longest: int, shortest: int = 1, undirected: bool = False) -> DataFrame:
    """start, node, length, nodes, rels of every path from starts (id) with no edge twice; nodes may repeat."""
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("rels"), F.array().cast("array<string>").alias("used"))
    front = saved(front, "front")
    found = None
    for length in range(1, longest + 1):
        e = numbered(edges, undirected, front)
        front = front.join(e.withColumnRenamed("src", "node"), "node").filter(~F.array_contains("used", F.col("edge")))
        front = front.select("start", F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("used", F.col("edge")).alias("used"))
        if length < longest:
            front = saved(front, "front")
        if length >= shortest:
            step = front.select("start", "node", F.lit(length).alias("length"), "nodes", "rels")
            found = step if found is None else found.unionByName(step)
    return found


def distances(edges: DataFrame, starts: DataFrame, longest: int, undirected: bool = True) -> DataFrame:
    """node, distance of what can be reached from starts (id) within so many steps, each node once."""
    front = saved(starts.select(F.col("id").alias("node"), F.lit(0).alias("distance")).distinct(), "front")
    seen = front
    for d in range(1, longest + 1):
        # ends are made distinct once, and not the edges before
        front = neighbours(edges, front, undirected).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(d))
        front = saved(front, "front")
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, longest: int = 5, undirected: bool = True) -> DataFrame:
    """One shortest path, the first by its nodes' names, as nodes and length; no rows if there is none."""
    spark = edges.sparkSession
    front = saved(spark.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("nodes")), "front")
    seen = front.select("node")
    for length in range(1, longest + 1):
        e = neighbours(edges, front, undirected)
        step = e.join(front.withColumnRenamed("node", "src"), "src").join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti")
        front = step.groupBy(F.col("dst").alias("node")).agg(F.min("nodes").alias("nodes")).select("node", F.array_append("nodes", F.col("node")).alias("nodes"))
        front = saved(front, "front")
        hit = front.filter(F.col("node") == end)
        if not hit.isEmpty():
            return hit.select("nodes", F.lit(length).alias("length"))
        seen = seen.union(front.select("node"))
    return front.filter("false").select("nodes", F.lit(0).alias("length"))


def paths_between(edges: DataFrame, start: str, end: str, longest: int = 3, shortest: int = 1, most: int | None = None) -> DataFrame:
    """length, nodes, rels of all undirected paths between two nodes with no edge twice, the shortest first; with most, so many of them.

    The last step isn't expanded: trails of one step less are joined with the edges at the end, so a hub that lies next
    to the end only costs what leads there.
    """
    near = edges.filter((F.col("src") == end) | (F.col("dst") == end))
    last = numbered(near, undirected=True).filter(F.col("dst") == end).select(F.col("src").alias("node"), F.col("rel").alias("rel"), F.col("edge"))
    last = saved(last, "last")
    front = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("nodes"), F.array().cast("array<string>").alias("rels"), F.array().cast("array<string>").alias("used"))
    front = saved(front, "front")
    found = None
    for length in range(1, longest + 1):
        if length >= shortest:
            hit = front.join(last, "node").filter(~F.array_contains("used", F.col("edge")))
            hit = hit.select(F.lit(length).alias("length"), F.array_append("nodes", F.lit(end)).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"))
            found = hit if found is None else found.unionByName(hit)
        if length < longest:
            e = numbered(edges, True, front)
            front = front.join(e.withColumnRenamed("src", "node"), "node").filter(~F.array_contains("used", F.col("edge")))
            front = front.select(F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("used", F.col("edge")).alias("used"))
            front = saved(front, "front")
    out = found.orderBy("length", F.array_join("nodes", ">"), F.array_join("rels", ">"))
    return out if most is None else out.limit(most)
