"""Steps that must give the same as a plain version by hand, however their rows are cut into blocks."""

import datetime as dt
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import algorithms, codes, embeddings, layout, learning, state
from lattica.plans import catalogue, corpus


def test_two_step_pairs(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "BLOCK_ROWS", 40)
    monkeypatch.setattr(algorithms, "BLOCK_ENDS", 100)
    monkeypatch.setattr(algorithms, "PAIRS_AT_ONCE", 7)
    r = random.Random(1)
    first = [(f"p{r.randrange(30)}", f"m{r.randrange(12)}") for _ in range(150)] + [("p1", None), (None, "m1"), ("p99", "m99")]
    second = [(f"m{r.randrange(12)}", f"d{r.randrange(90)}") for _ in range(200)] + [("m1", f"e{i}") for i in range(80)] + [("m2", None), (None, "d1")]
    pairs = {(a, c) for a, b in first for b2, c in second if b is not None and b == b2}
    one, two = spark.createDataFrame(first, "src string, mid string"), spark.createDataFrame(second, "mid string, dst string")
    assert algorithms.two_step_pairs(one, two).collect() == [(len(pairs),)]
    assert algorithms.two_step_pairs(one, two.limit(0)).collect() == [(0,)]


def test_numbers_sort_as_names_do(spark):
    names = ["P:1", "P:10", "P:9", "P:100", "P:0", "P:007", "S:1", "SG:1", "SH:99", "T:999999999999", "W:24", "A:1", "Z:5", "ZZ:5"]
    rows = spark.createDataFrame([(n,) for n in names], "id string").select("id", codes.number(F.col("id")).alias("n")).withColumn("back", codes.name(F.col("n"))).collect()
    assert all(r.id == r.back for r in rows)
    assert [r.id for r in sorted(rows, key=lambda r: r.n)] == sorted(names)
    odd = spark.createDataFrame([("P:",), ("p:1",), ("ABC:1",), ("P:1\n",), ("P:1/2",), ("P:1234567890123",), (None,), ("",)], "id string")
    assert odd.filter(codes.number(F.col("id")).isNotNull()).isEmpty()


@pytest.mark.parametrize("kind", ["N:{}", "node {}"])
def test_components_of_any_shape(spark, kind):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(35)] + [(200, 200), (300, 301), (301, 300), (301, 300)]
    order = list(range(400))
    r.shuffle(order)
    edges = [(kind.format(order[a]), kind.format(order[b])) for a, b in edges]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    found = algorithms.connected_components(spark.createDataFrame([*edges, (None, "x"), ("x", None)], "src string, dst string")).collect()
    assert {x.id: x.component for x in found} == top and len(found) == len(top)


@pytest.mark.parametrize("kind", ["N:{}", "node {}"])
def test_label_propagation(spark, kind):
    r = random.Random(4)
    edges = [(kind.format(r.randrange(30)), kind.format(r.randrange(30))) for _ in range(50)] + [(kind.format(0), kind.format(i)) for i in range(25)]
    around = {}
    for a, b in edges:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    label = {x: x for x in around}
    for _ in range(4):
        label = {x: min((-n, y) for y, n in Counter(label[y] for y in around[x]).items())[1] for x in around}
    assert {x.id: x.label for x in algorithms.label_propagation(spark.createDataFrame(edges, "src string, dst string"), 4).collect()} == label


def counted(monkeypatch, module):
    """The names of the tables that a module writes from now on."""
    names, real = [], module.saved
    monkeypatch.setattr(module, "saved", lambda df, name, *more: names.append(name) or real(df, name, *more))
    return names


def test_pagerank_ends_when_nothing_moves(spark, monkeypatch):
    edges = spark.createDataFrame([("T:1", "P:1"), ("T:2", "P:1"), ("P:1", "S:1"), ("P:1", "S:1"), ("S:1", "W:1")], "src string, dst string")
    names = counted(monkeypatch, algorithms)
    found = {r.id: r.score for r in algorithms.pagerank(edges, 20).collect()}
    assert found == pytest.approx({"T:1": 0.15, "T:2": 0.15, "P:1": 0.405, "S:1": 0.322125, "W:1": 0.42380625})
    assert names.count("scores") == 6  # the start, four rounds that move something and one that does not


def test_similar_in_blocks(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-1, 2, 3)]) for i in range(300)]
    v = spark.createDataFrame([*rows, (300, [0.0] * 3)], "id long, vector array<double>").repartition(3)
    wanted = v.filter("id % 7 = 0").withColumnRenamed("id", "query")
    unit = {i: np.array(x) / max(np.linalg.norm(x), 1e-300) for i, x in [*rows, (300, [0.0] * 3)]}
    expected = {(q, i, s) for q in range(0, 301, 7) for s, i in sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i != q)[:10]}
    found = embeddings.similar(v, wanted, chunk=16, at_once=5)
    assert {(x["query"], x["id"], -x["score"]) for x in found.collect()} == expected
    assert embeddings.similar(v, wanted.limit(0)).count() == 0


def test_features_are_worked_out_once(spark, monkeypatch):
    names = counted(monkeypatch, learning)
    nodes = spark.createDataFrame([(f"p{i}", "AB"[i % 2], "x" * (i % 2)) for i in range(40)], "id string, label string, name string")
    found = learning.classified(learning.node_features(nodes, spark.createDataFrame([("p1", "p2")], "src string, dst string")), trees=2, depth=2)
    assert found.count() == 40 and names == ["features"]


def test_no_row_for_each_count(spark):
    plan = catalogue.queries()["adv_4_target_landscape"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_overlapping_actions_by_hand(spark):
    r = random.Random(5)
    at = lambda: dt.datetime(2001, 1, 1) + dt.timedelta(hours=6 * r.randrange(40))
    shortages = [(r.choice("abc"), f"s{i}", at(), r.choice([None, at()])) for i in range(60)] + [("a", "s0", at(), at()), (None, "n", at(), None), ("a", "x", None, None), ("z", "lone", at(), None)]
    inspections = [(r.choice("abcd"), at()) for _ in range(90)] + [("a", None), (None, at())]
    expected = Counter(s for m, s, start, end in shortages for m2, t in inspections if m and m == m2 and t and start and t >= start and (end is None or t <= end))
    made = spark.createDataFrame(shortages, "manufacturer string, id string, start_date timestamp, end_date timestamp")
    found = corpus.overlapping(SimpleNamespace(shortage=made, inspection=spark.createDataFrame(inspections, "manufacturer string, inspected timestamp")))
    assert {x.shortage: x.inspections for x in found.collect()} == expected
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()  # and no pairs


@pytest.mark.parametrize("kind", ["N:{}", "node {}"])
def test_walks_at_hubs(spark, monkeypatch, kind):
    r = random.Random(6)
    rows = [(kind.format(0), kind.format(i)) for i in range(1, 60)] + [(kind.format(r.randrange(60, 90)), kind.format(r.choice([0, r.randrange(90)]))) for _ in range(60)]
    edges = spark.createDataFrame([*rows, rows[0], (None, "x")], "src string, dst string")
    names = counted(monkeypatch, embeddings)
    plain = {x.walk: x.nodes for x in embeddings.walks(edges, length=6, per_node=8).collect()}
    monkeypatch.setattr(embeddings, "LISTED", 4)
    assert {x.walk: x.nodes for x in embeddings.walks(edges, length=6, per_node=8).collect()} == plain
    nodes = {x for e in rows for x in e}
    assert plain.keys() == {f"{n}#{k}" for n in nodes for k in range(1, 9)}
    assert all((a, b) in set(rows) for w in plain.values() for a, b in zip(w, w[1:]))
    sinks = nodes - {a for a, _ in rows}
    assert all(len(w) == 6 or w[-1] in sinks for w in plain.values())
    assert "walks" in names  # a table of each step, so that walks that ended are in no further join


def plan_of(spark, name):
    return catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_communities_use_lists_and_numbers(spark, monkeypatch):
    names = counted(monkeypatch, algorithms)
    edges = [(f"N:{10 * c + i}", f"N:{10 * c + j}") for c in (1, 2) for i in range(5) for j in range(i)] + [("N:10", "N:20"), ("N:10", "N:10")]
    kept = algorithms.communities(spark.createDataFrame(edges, "src string, dst string"))
    assert len({(r.id[2], r.community) for r in kept.collect()}) == 2 and "around" in names
    other = algorithms.communities(spark.createDataFrame([(a + "x", b + "x") for a, b in edges], "src string, dst string"))
    assert len({(r.id[2], r.community) for r in other.collect()}) == 2


def test_study_details_are_parsed_once(spark):
    assert "from_json" not in plan_of(spark, "ent_2_study_details")


def test_keys_stand_for_arms(spark):
    plan = plan_of(spark, "cl_q4_3_baseline_per_arm")
    assert "concat(U:" not in plan and plan.count("concat(T:") == 1


def test_forces_by_hand(spark):
    r = random.Random(8)
    edges = [("a", f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(14)]
    found = {x.id: (x.x, x.y) for x in layout.forces(spark.createDataFrame(edges, "picture string, src string, dst string"), "picture", rounds=5).collect()}
    first = {x.id: (x.x, x.y) for x in layout.forces(spark.createDataFrame(edges, "picture string, src string, dst string"), "picture", rounds=0).collect()}
    at = {k: np.array(v) for k, v in first.items()}
    links = {(s, d) for _, s, d in edges}
    for _ in range(5):
        force = {k: sum(((at[k] - at[o]) / (far := np.hypot(*(at[k] - at[o])) + 0.1) * (100 / far**2) for o in at if o != k), np.zeros(2)) for k in at}
        for s, d in links:
            force[s] = force[s] + 0.1 * (at[d] - at[s])
            force[d] = force[d] - 0.1 * (at[d] - at[s])
        at = {k: at[k] + 0.9 * force[k] * min(1, 10 / max(np.hypot(*(0.9 * force[k])), 1e-9)) for k in at}
    assert all(found[k] == pytest.approx(tuple(at[k]), abs=1e-6) for k in at)


def test_features_are_counted_by_keys(spark):
    assert "concat(P:" not in plan_of(spark, "ml_2_features")


def test_records_are_dealt_by_their_number(spark):
    assert plan_of(spark, "ent_4_applications").count("RepartitionByExpression") >= 2


def test_pages_are_dealt_to_all_cores(spark):
    assert "RepartitionByExpression" in plan_of(spark, "src_25_listed_documents")


def test_saved_leaves_no_shuffle_files(spark):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = held()
    tables = [state.saved(spark.range(100).groupBy((F.col("id") % 7 + i).alias("k")).count(), "sums") for i in range(5)]
    assert held() <= before and [t.count() for t in tables] == [7] * 5
    assert spark.conf.get(state.CLEANUP) == "false"
    for t in tables:
        state.dropped(t)


@pytest.mark.parametrize("name", ["label_propagation", "communities"])
def test_rounds_deal_by_node_once(spark, monkeypatch, name):
    plans, real = {}, algorithms.saved
    monkeypatch.setattr(algorithms, "saved", lambda df, kind, *more: plans.setdefault(kind, df._jdf.queryExecution().optimizedPlan().toString()) and real(df, kind, *more))
    edges = [(f"N:{10 * c + i}", f"N:{10 * c + j}") for c in (1, 2) for i in range(5) for j in range(i)]
    getattr(algorithms, name)(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert "RepartitionByExpression [id" in plans["labels" if name == "label_propagation" else "moves"]


def test_walks_are_kept_without_names_that_they_hold(spark, monkeypatch):
    columns, real = [], embeddings.saved
    monkeypatch.setattr(embeddings, "saved", lambda df, name, *more: columns.append((name, df.columns)) or real(df, name, *more))
    edges = spark.createDataFrame([("N:1", "N:2"), ("N:2", "N:3")], "src string, dst string")
    assert sorted(x.nodes for x in embeddings.walks(edges, length=4, per_node=1).collect()) == [["N:1", "N:2", "N:3"], ["N:2", "N:3"], ["N:3"]]
    assert {tuple(c) for name, c in columns if name == "walks"} == {("k", "nodes", "to", "part", "place")}
