"""Every registered graph query against its SQL on the smallest tables, and operators on a graph made by hand."""

import math

import duckdb
import pytest

from lattica.functions import classify, cypher, normalise
from lattica.operators import algorithms, embeddings, paths, records
from lattica.plans import catalogue
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rows = duck.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in order) for r in rows.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.fixture(scope="module")
def edges(spark):
    # a cycle a-b-c, a self-loop, a parallel edge, a chain, and an isolated node in nodes below
    rows = [("a", "b", "R"), ("b", "c", "R"), ("c", "a", "R"), ("a", "a", "R"), ("a", "b", "R"), ("c", "d", "S"), ("x", "y", "R")]
    return spark.createDataFrame(rows, "src string, dst string, rel string")


def test_degree(spark, edges):
    nodes = spark.createDataFrame([(i,) for i in "abcdxyz"], "id string")
    assert {r.id: r.degree for r in algorithms.degrees(nodes, edges).collect()} == {"a": 5, "b": 3, "c": 3, "d": 1, "x": 1, "y": 1, "z": 0}


def test_trails_repeat_no_edge(spark, edges):
    start = spark.createDataFrame([("a",)], "id string")
    found = sorted("".join(r.nodes) for r in paths.trails(edges, start, 5).collect())
    assert found == sorted(["aa", "aab", "aabc", "aabca", "aabcd", "ab", "abc", "abca", "abcaa", "abcd"])
    assert paths.shortest_path(edges, "a", "d", 4).first().nodes == ["a", "c", "d"]
    assert paths.shortest_path(edges, "a", "y", 4).count() == 0
    assert {r.node: r.distance for r in paths.distances(edges, start, 3, undirected=False).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_components_and_labels(edges):
    assert {r.id: r.component for r in algorithms.connected_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert algorithms.label_propagation(edges, 3).count() == 6


def test_pagerank(edges):
    score, out = dict.fromkeys("abcdxy", 1.0), {"a": 3, "b": 1, "c": 2, "x": 1}
    links = {("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d"), ("x", "y")}
    for _ in range(7):
        score = {n: 0.15 + 0.85 * sum(score[s] / out[s] for s, d in links if d == n) for n in score}
    assert {r.id: round(r.score, 9) for r in algorithms.pagerank(edges, 7).collect()} == {n: round(s, 9) for n, s in score.items()}


def test_normalisers(spark):
    rows = spark.createDataFrame([("  a  b ", "03/02/2020", "5 nM", "kinase IC50"), ("", "2020-13-01", "2×10^3 mg", None), (None, "13/25/2020", "x", "activates")], "t string, d string, n string, a string")
    got = rows.select(normalise.text(F.col("t")), F.date_format(normalise.date(F.col("d")), "yyyy-MM-dd"), normalise.number(F.col("n")), normalise.edge_type(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("a b", "2020-02-03", 5.0, "INHIBITS"), (None, None, 2000.0, "BINDS_TO"), (None, None, None, "ACTIVATES")]
    loose = spark.createDataFrame([("FEI//12_-_3 x",)], "i string").select(normalise.loose_id(F.col("i"))).first()[0]
    assert loose == "fei-12_-_3x"


def test_classes(spark):
    rows = spark.createDataFrame([("A tumor and cancer in the brain",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(classify.best_area(F.col("t"))).collect()] == ["ONCOLOGY", "GENERAL", "GENERAL"]
    assert rows.select(classify.mentions(F.col("t"), "[a-z]+", most=2)).first()[0] == ["tumor", "and"]


def test_records(spark):
    rows = spark.createDataFrame([(1, "k", 3), (2, "k", 1), (3, None, 1), (4, None, 2)], "id int, key string, n int")
    assert sorted(r.id for r in records.first_seen(rows, "key", ["n"]).collect()) == [2, 3, 4]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None, 5, "z"), (3, "c", 6, None)], "id int, x string, y int, w string")
    assert sorted(map(tuple, records.upserted(old, new, "id").collect())) == [(1, "a", 1, None), (2, "b", 5, "z"), (3, "c", 6, None)]
    docs = spark.createDataFrame([(1, "u", "t", "d", "x"), (2, "u", "t2", "d", "y"), (3, "v", "t2", "d", "y"), (4, "u2", "t", "d", "x"), (5, None, "t", "d", "x")], "id int, url string, title string, date string, text string")
    assert sorted(r.id for r in records.distinct_documents(docs, ["id"]).collect()) == [1, 3, 4, 5]


def test_helpers(spark):
    row = spark.range(1).select(cypher.rate(F.lit(1), F.lit(0)), cypher.rate(F.lit(1), F.lit(3)), cypher.evidence_score(F.lit("Z")), cypher.all_of(None, F.lit(True), None)).first()
    assert tuple(row) == (0.0, 33.33, 0, True)
    assert cypher.total_pages(41, 20) == 3
    vec = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [None if r[0] is None else round(r[0], 9) for r in vec.select(embeddings.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None]
