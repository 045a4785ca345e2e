"""Constraints on nodes, on rows made by hand."""

from lattica.operators import shapes
from lattica.plans.binding import KEYS, Graph
from pyspark.sql import functions as F


def test_counts_outside_of_bounds(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "id string")
    related = spark.createDataFrame([("a",), ("b",), ("b",), ("x",), (None,)], "id string")
    assert {(r.id, r.n) for r in shapes.counted(nodes, related).collect()} == {("a", 1), ("b", 2), ("c", 0)}
    assert {r.id for r in shapes.outside(nodes, related, 1).collect()} == {"c"}
    assert {r.id for r in shapes.outside(nodes, related, 1, 1).collect()} == {"b", "c"}
    assert tuple(shapes.judged(nodes, related, 0, 1, "one").first()) == ("one", 3, 1)
    assert tuple(shapes.judged(nodes.limit(0), related, 1, None, "none").first()) == ("none", 0, 0)


def test_conditions(spark):
    rows = spark.createDataFrame([("ok",), ("bad",), (None,)], "kind string")
    assert tuple(shapes.tested(rows, F.col("kind") == "bad", "kind").first()) == ("kind", 3, 1)


def test_rows_of_one_node(spark):
    g = Graph(spark, "/root/testdata/sf0.001")
    for (view, column), node in zip(KEYS, "P:3 S:4 P:3 D:11 S:2 D:7 P:30 T:1 S:3 P:9 M:3 M:3 U:12 T:20 T:20 T:20 T:20 D:11 P:1".split(), strict=True):
        rows = sorted(map(tuple, getattr(g, view).filter(F.col(column) == node).collect()), key=str)
        assert rows and rows == sorted(map(tuple, g.at(view, column, node).collect()), key=str), (view, column)
    assert g.at("treats", "compound", "P:none").isEmpty() and g.at("treats", "compound", "P:03").isEmpty()
