"""Positions of nodes for drawing: circle, grid, levels, rings, forces. Ranks come from ranges, so no task numbers all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.state import saved


def ranked(nodes: DataFrame, order: list[str], parts: int = 256) -> DataFrame:
    """nodes with rank from 0 by an order, without one task that sees all rows.

    Rows are range-parted by the order; each part is numbered on its own from where the part before it ended.
    """
    held = nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    held = held.withColumn("_part", F.shiftrightunsigned("_n", 33)).withColumn("_at", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
    held = saved(held, "ranked")
    sizes = held.groupBy("_part").count()
    before = sizes.alias("a").join(sizes.select(F.col("_part").alias("p"), F.col("count").alias("c")).alias("b"), F.col("b.p") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("_start"))
    return held.join(F.broadcast(before), "_part").withColumn("rank", F.col("_start") + F.col("_at")).drop("_part", "_at", "_n", "_start")


def circle(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """id, x, y around a circle by id."""
    r = ranked(nodes.select("id"), ["id"])
    n = r.agg(F.count("*").alias("n"))
    angle = 2 * F.pi() * F.col("rank") / F.col("n")
    return r.join(F.broadcast(n)).select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def grid(nodes: DataFrame, columns: int = 5, spacing: float = 50.0) -> DataFrame:
    """id, x, y in rows of so many by id."""
    r = ranked(nodes.select("id"), ["id"])
    return r.select("id", (F.col("rank") % columns * spacing).alias("x"), (F.floor(F.col("rank") / columns) * spacing).cast("double").alias("y"))


def levels(degrees: DataFrame, height: float = 50.0, width: float = 30.0) -> DataFrame:
    """id, x, y: nodes (id, degree) of the highest degree on top; the n nodes of a level stand in the order of ids, evenly within n widths around 0.

    All nodes are ranked once, by level and id, so that a level of very many nodes isn't numbered in one task.
    """
    r = ranked(degrees.select("id", "degree", (-F.col("degree")).alias("_level")), ["_level", "id"])
    own = r.groupBy("degree").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    top = own.agg(F.max("degree").alias("top"))
    rows = r.join(own, "degree").join(F.broadcast(top))  # one row
    n, i = F.col("n"), F.col("rank") - F.col("first") + 1
    return rows.select("id", (n * width * (i / (n + 1) - 0.5)).alias("x"), ((F.col("top") - F.col("degree")) * height).cast("double").alias("y"))


def rings(nodes: DataFrame, centre: str, radius: float = 100.0) -> DataFrame:
    """id, x, y: a node in the middle and all others around it by id; without that node, a circle of all."""
    others = circle(nodes.filter(F.col("id") != centre), radius)
    return others.unionByName(nodes.filter(F.col("id") == centre).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


#: Nodes that a picture by forces has at most.
MOST_DRAWN = 2000


def forces(edges: DataFrame, picture: str, rounds: int = 100, repulsion: float = 100.0, attraction: float = 0.1, damping: float = 0.9, seed: int = 42) -> DataFrame:
    """picture, id, x, y: for each picture (a column of edges src, dst), its nodes where forces push and draw them.

    Nodes repel each other by repulsion over their squared distance and edges draw by attraction times distance; a round moves a node by damping
    times its force, at most ten units. They start at places that a hash of their ids gives. A picture is worked out in one task, so it may have MOST_DRAWN
    nodes; larger ones fail, before their edges are brought together.
    """
    ends = edges.select(picture, F.explode(F.array("src", "dst")).alias("id")).dropna().distinct()
    large = ends.groupBy(picture).count().filter(F.col("count") > MOST_DRAWN)
    if not large.isEmpty():
        raise ValueError(f"a picture has over {MOST_DRAWN} nodes")
    start = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(200_001)) / 1000.0 - 100.0)
    start = [start(k).alias(c) for k, c in enumerate("xy")]
    once = edges.select(picture, "src", "dst").dropna().distinct()

    def place(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id", ignore_index=True)
        at = nodes[["x", "y"]].to_numpy().copy()
        a, b = (np.searchsorted(nodes["id"], links[c]) for c in ("src", "dst"))
        for _ in range(rounds):
            # a table for each coordinate, changed in place; a column is what the others do to a node
            apart = [c[None] - c[:, None] for c in np.ascontiguousarray(at.T)]
            far = apart[0] * apart[0]
            far += apart[1] * apart[1]
            np.sqrt(far, out=far)
            far += 0.1
            push = repulsion / (far * far)
            force = np.empty_like(at)
            for k in (0, 1):
                apart[k] /= far
                apart[k] *= push
                force[:, k] = apart[k].sum(0)
            pull = attraction * (at[b] - at[a])
            np.add.at(force, a, pull)
            np.add.at(force, b, -pull)
            step = damping * force
            at += step * np.minimum(1, 10 / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-9))
        return nodes[[picture, "id"]].assign(x=at[:, 0], y=at[:, 1])

    kind = dict(edges.dtypes)
    nodes = ends.select(F.col(picture).alias(picture), F.col("id").alias("id"), *start)
    return nodes.groupBy(picture).cogroup(once.select(*[F.col(c).alias(c) for c in (picture, "src", "dst")]).groupBy(picture)).applyInPandas(place, f"{picture} {kind[picture]}, id {kind['src']}, x double, y double")
