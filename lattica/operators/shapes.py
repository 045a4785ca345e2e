"""Constraints on nodes: how many related rows a node may have, and which of its values are allowed.

Related rows are counted by node before they are joined, so a hub is one row by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(nodes: DataFrame, related: DataFrame) -> DataFrame:
    """id, n: the related rows (id) of every node (id), 0 for those without; rows without an id are no node."""
    n = related.groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id").filter("id IS NOT NULL").distinct().join(n, "id", "left").fillna(0, ["n"])


def outside(nodes: DataFrame, related: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """id, n of the nodes whose number of related rows isn't in least..most; no upper bound if most is None."""
    few, many = F.col("n") < least, F.lit(False) if most is None else F.col("n") > most
    return counted(nodes, related).filter(few | many)


def judged(nodes: DataFrame, related: DataFrame, least: int, most: int | None, constraint: str) -> DataFrame:
    """One row: the constraint, how many nodes it was checked on, and how many break it."""
    few, many = F.col("n") < least, F.lit(False) if most is None else F.col("n") > most
    return counted(nodes, related).agg(F.lit(constraint).alias("constraint_name"), F.count("*").alias("checked"), F.count_if(few | many).alias("violations"))


def tested(rows: DataFrame, broken: Column, constraint: str) -> DataFrame:
    """One row: the constraint, how many rows it was checked on, and for how many the condition broken holds."""
    return rows.agg(F.lit(constraint).alias("constraint_name"), F.count("*").alias("checked"), F.count_if(broken).alias("violations"))
