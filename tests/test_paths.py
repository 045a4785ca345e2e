"""Paths that grow from small and from large frontiers."""

import random

from lattica.operators import paths
from lattica.plans import catalogue
from lattica.plans.binding import Graph


def test_paths_from_small_and_large_fronts(spark, monkeypatch):
    r = random.Random(7)
    rows = [(f"n{r.randrange(14)}", f"n{r.randrange(14)}", r.choice("RS")) for _ in range(24)]
    edges = spark.createDataFrame([*rows, rows[0]], "src string, dst string, rel string")
    starts = spark.createDataFrame([("n1",), ("n2",)], "id string")

    def found():
        return [
            sorted((x.start, x.nodes, x.rels) for x in paths.trails(edges, starts, 3, undirected=True).collect()),
            sorted((x.start, x.nodes, x.rels) for x in paths.trails(edges, starts, 4, 2).collect()),
            sorted(map(tuple, paths.distances(edges, starts, 3).collect())),
            sorted((x.nodes, x.rels) for x in paths.paths_between(edges, "n1", "n5", 3, most=None).collect()),
            [paths.shortest_path(edges, "n1", f"n{i}", 4).collect() for i in range(2, 6)],
        ]

    names, real = [], paths.saved
    monkeypatch.setattr(paths, "saved", lambda df, name, *more: names.append(name) or real(df, name, *more))
    small = found()
    assert set(names) == {"front", "last"}  # the whole graph is not written
    monkeypatch.setattr(paths, "BROADCAST_NODES", 0)
    assert found() == small and all(small[:4])
    e = {(a, b, k) for a, b, k in rows}
    both = [(a, b, k, (a, b, k)) for a, b, k in e] + [(b, a, k, (a, b, k)) for a, b, k in e if a != b]
    every, front = [], [(s, [s], [], []) for s in ("n1", "n2")]
    for _ in range(3):
        front = [(s, [*n, b], [*k, rel], [*u, edge]) for s, n, k, u in front for a, b, rel, edge in both if a == n[-1] and edge not in u]
        every += [(s, n, k) for s, n, k, _ in front]
    assert small[0] == sorted(every)


def test_fronts_narrow_the_scans(spark):
    link = Graph(spark, "/root/testdata/sf0.001").link
    plan = paths.neighbours(link, spark.createDataFrame([("P:3",)], "node string"), True)._jdf.queryExecution().optimizedPlan().toString()
    first = plan[: plan.index("Relation")]
    assert "LeftSemi" in first and first.index("Aggregate") < first.index("LeftSemi")


def test_paths_between_two_nodes_are_all_given(spark):
    rows = [("a", f"m{i}", "R") for i in range(130)] + [(f"m{i}", "z", "S") for i in range(130)]
    found = paths.paths_between(spark.createDataFrame(rows, "src string, dst string, rel string"), "a", "z", 2).collect()
    assert [">".join(x.nodes) for x in found] == sorted(f"a>m{i}>z" for i in range(130))


def test_all_paths_query_has_no_limit():
    assert "LIMIT" not in catalogue.oracle_sql()["ga_8_all_paths"].upper()
