import os
import random
from collections import deque

import pytest

from lattica.operators import algorithms
from lattica.operators.state import dropped, folder, saved

EDGES = "src string, dst string"


def by_hand(edges, sources, longest):
    around = {}
    for a, b in edges:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    score = {}
    for s in set(sources) & set(around):
        depth, ways, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            if depth[v] == longest:
                continue
            for w in around[v]:
                if w not in depth:
                    depth[w], ways[w] = depth[v] + 1, 0
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    ways[w] += ways[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in around[w]:
                if v in depth and depth[v] == depth[w] - 1:
                    share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s and share[w]:
                score[w] = score.get(w, 0) + share[w]
    return score


@pytest.mark.parametrize("longest, every", [(5, True), (2, False)])
def test_betweenness(spark, longest, every):
    r = random.Random(longest)
    edges = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(40)] + [("n1", "n1"), ("n1", "n2"), ("n1", "n2"), ("hub", "n3"), ("hub", "n9"), ("p", "q")]
    sources = {x for e in edges for x in e} if every else {"n1", "hub", "nobody"}
    found = algorithms.betweenness(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(s,) for s in sources], "id string"), longest)
    assert {r["id"]: pytest.approx(r["score"]) for r in found.collect()} == by_hand(edges, sources, longest)
    assert algorithms.betweenness(spark.createDataFrame([], EDGES), spark.createDataFrame([("a",)], "id string")).count() == 0


def test_states_are_deleted(spark):
    base = folder(spark).removeprefix("file://")
    first = saved(spark.range(3), "kept")
    second = saved(first.selectExpr("id + 1 AS id"), "kept", first)
    assert not os.path.exists(first._lattica_path.removeprefix("file://")) and second.count() == 3
    dropped(second)
    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(20)], EDGES)
    before = {d for d in os.listdir(base) if d.startswith("components-")}
    found = algorithms.connected_components(edges)
    assert len({d for d in os.listdir(base) if d.startswith("components-")} - before) == 1 and {r["component"] for r in found.collect()} == {"a0"}


@pytest.mark.parametrize("kind", ["N:{}", "node {}"])
def test_levels_are_a_row_a_node(spark, monkeypatch, kind):
    for constant, n in {"SOURCES_AT_ONCE": 16, "BLOCK_LINKS": 60, "LEAST_LINKS": 20, "PIECE_LINKS": 7}.items():
        monkeypatch.setattr(algorithms, constant, n, raising=False)
    rows, kept = {}, algorithms.saved

    def counted(df, name, *instead_of):
        out = kept(df, name, *instead_of)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(algorithms, "saved", counted)
    r = random.Random(7)
    ends = [(f"{r.randrange(60)}", f"{60 + r.randrange(12)}") for _ in range(150)] + [(f"{60 + i}", "99") for i in range(12)] + [("99", "99"), ("60", "1"), ("200", "201")]
    edges = [(kind.format(a), kind.format(b)) for a, b in ends]
    nodes = {x for e in edges for x in e}
    sources = sorted(nodes)[:20]
    found = algorithms.betweenness(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(s,) for s in sources], "id string"))
    assert {r["id"]: pytest.approx(r["score"]) for r in found.collect()} == by_hand(edges, sources, 5)
    # what a level holds goes with the nodes, not with nodes times sources
    assert max(rows["level"] + rows["share"]) <= len(nodes)
    assert max(rows.get("blocks", [0])) > 1
    assert algorithms.betweenness(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("nobody",)], "id string")).count() == 0
