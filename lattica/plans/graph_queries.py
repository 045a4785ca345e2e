"""Path and algorithm queries over the bound graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import asc, desc
from lattica.operators import algorithms, layout, paths
from lattica.plans.binding import Graph
from lattica.plans.registry import query


def seed(g: Graph, *ids: str) -> DataFrame:
    return g.spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("id"))


_TRAILS = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst, rel, src || '|' || rel || '|' || dst AS edge FROM link), t AS (
    SELECT dst AS node, 1 AS length, ['{0}', dst] AS nodes, [rel] AS rels, [edge] AS used FROM e WHERE src = '{0}'
    UNION ALL SELECT e.dst, length + 1, list_append(nodes, e.dst), list_append(rels, e.rel), list_append(used, e.edge) FROM t JOIN e ON e.src = t.node WHERE length < {1} AND NOT list_contains(used, e.edge))"""


@query("adv_13_trails", _TRAILS.format("P:3", 3) + " SELECT array_to_string(nodes, '>') AS path, length FROM t ORDER BY length, path LIMIT 50")
def adv_13(g: Graph) -> DataFrame:
    """Directed trails from a compound, the shortest first."""
    t = paths.trails(g.link, seed(g, "P:3"), 3).select(F.array_join("nodes", ">").alias("path"), "length")
    return t.orderBy("length", asc("path")).limit(50)


@query(
    "adv_8_signal_paths",
    """SELECT c.id || '>' || s.target || '>' || s.disease AS path, 2 AS length FROM (SELECT DISTINCT a.compound, a.target, d.disease FROM acts_on a JOIN associated d ON d.target = a.target) s JOIN compound c ON c.id = s.compound JOIN signal g ON g.disease = s.disease AND g.status = 'confirmed' WHERE c.id = 'P:3' GROUP BY ALL""",
)
def adv_8(g: Graph) -> DataFrame:
    """Paths from a compound over its targets to diseases with a confirmed signal."""
    marked = g.signal.filter("status = 'confirmed'").select("disease").distinct()
    a = g.at("acts_on", "compound", "P:3").select("compound", "target").distinct()
    d = g.associated.select("target", "disease").distinct().join(marked, "disease", "left_semi")
    return a.join(d, "target").select(F.concat_ws(">", "compound", "target", "disease").alias("path"), F.lit(2).alias("length")).distinct()


_DISTANCE = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM link UNION SELECT DISTINCT dst, src FROM link), d AS (SELECT '{0}' AS node, 0 AS distance UNION SELECT e.dst, distance + 1 FROM d JOIN e ON e.src = d.node WHERE distance < {1})"""


@query("adv_14_neighbourhood", _DISTANCE.format("S:3", 3) + " SELECT node, CAST(min(distance) AS INT) AS distance FROM d GROUP BY node")
def adv_14(g: Graph) -> DataFrame:
    """All that is within three steps of a target."""
    return paths.distances(g.link, seed(g, "S:3"), 3)


@query("ga_7_shortest_length", _DISTANCE.format("P:3", 4) + " SELECT CAST(min(distance) AS INT) AS length FROM d WHERE node = 'W:4' HAVING count(*) > 0")
def ga_7(g: Graph) -> DataFrame:
    """The length of the shortest path between two nodes."""
    return paths.shortest_path(g.link, "P:3", "W:4", 4).select("length")


@query("ga_9_k_shortest", _TRAILS.format("P:3", 3) + " SELECT array_to_string(nodes, '>') AS path, length FROM t WHERE node = 'W:4' ORDER BY length, path LIMIT 5")
def ga_9(g: Graph) -> DataFrame:
    """The first few paths to a pathway by length."""
    t = paths.trails(g.link, seed(g, "P:3"), 3).filter("node = 'W:4'").select(F.array_join("nodes", ">").alias("path"), "length")
    return t.orderBy("length", asc("path")).limit(5)


@query("ga_1_degree", "SELECT n.id, count(e.id) AS degree FROM (SELECT id FROM target) n LEFT JOIN (SELECT src AS id FROM link UNION ALL SELECT dst FROM link) e ON e.id = n.id GROUP BY n.id ORDER BY degree DESC, id LIMIT 100")
def ga_1(g: Graph) -> DataFrame:
    return algorithms.degrees(g.target, g.link).orderBy(desc("degree"), asc("id")).limit(100)


def _pagerank_sql(rounds: int) -> str:
    steps = ["s0 AS (SELECT id, 1.0::DOUBLE AS score FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"s{i} AS (SELECT n.id, 0.15 + 0.85 * coalesce(f.flow, 0) AS score FROM n LEFT JOIN (SELECT l.dst, sum(CAST(round(s.score / l.out * 1e11) AS BIGINT)) / 1e11 AS flow FROM l JOIN s{i - 1} s ON s.id = l.src GROUP BY l.dst) f ON f.dst = n.id)")
    return f"""WITH l AS MATERIALIZED (SELECT DISTINCT e.src, e.dst, o.out FROM link e JOIN (SELECT src, count(*) AS out FROM link GROUP BY src) o ON o.src = e.src),
        n AS MATERIALIZED (SELECT src AS id FROM link UNION SELECT dst FROM link), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
        SELECT id, round(score, 6) AS score FROM s{rounds}"""


@query("ga_2_pagerank", _pagerank_sql(20))
def ga_2(g: Graph) -> DataFrame:
    return algorithms.pagerank(g.link).select("id", F.round("score", 6).alias("score"))


def _lpa_sql(rounds: int) -> str:
    steps = ["s0 AS (SELECT DISTINCT src AS id, src AS label FROM e)"]
    for i in range(1, rounds + 1):
        steps.append(f"s{i} AS MATERIALIZED (SELECT id, label FROM (SELECT e.src AS id, s.label, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, s.label) AS r FROM e JOIN s{i - 1} s ON s.id = e.dst GROUP BY e.src, s.label) WHERE r = 1)")
    return f"WITH e AS MATERIALIZED (SELECT src, dst FROM link WHERE src <> dst UNION SELECT dst, src FROM link WHERE src <> dst), {', '.join(steps)} SELECT id, label FROM s{rounds}"


@query("ga_5_label_propagation", _lpa_sql(10))
def ga_5(g: Graph) -> DataFrame:
    return algorithms.label_propagation(g.link)


@query("ga_6_components")  # SQL would list every pair of connected nodes; the operator is tested by hand
def ga_6(g: Graph) -> DataFrame:
    return algorithms.connected_components(g.link)


@query(
    "ga_10_similarity",
    """WITH a AS (SELECT DISTINCT target FROM acts_on WHERE compound = 'P:3'), b AS (SELECT DISTINCT target FROM acts_on WHERE compound = 'P:4'), n AS (SELECT (SELECT count(*) FROM a JOIN b USING (target)) AS common, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
    SELECT common, round(common * 1.0 / (na + nb - common), 6)::DOUBLE AS jaccard, round(common / sqrt(na * nb), 6)::DOUBLE AS cosine FROM n""",
)
def ga_10(g: Graph) -> DataFrame:
    e = g.acts_on.select(F.col("compound").alias("src"), F.col("target").alias("dst"))
    return algorithms.neighbour_similarity(e, "P:3", "P:4")


@query("ga_12_graph_statistics", "SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(DISTINCT label) FROM node) AS labels, (SELECT count(DISTINCT rel) FROM edge) AS types")
def ga_12(g: Graph) -> DataFrame:
    n = g.node.groupBy("label").count().agg(F.sum("count").alias("nodes"), F.count("*").alias("labels"))
    e = g.edge.groupBy("rel").count().agg(F.sum("count").alias("edges"), F.count("*").alias("types"))
    return n.join(F.broadcast(e)).select("nodes", "edges", "labels", "types")


@query("inf_1_common_neighbours", "SELECT b.compound AS other, count(DISTINCT b.target) AS common FROM acts_on a JOIN acts_on b ON b.target = a.target AND b.compound <> a.compound WHERE a.compound = 'P:8' GROUP BY b.compound ORDER BY common DESC, other LIMIT 100")
def inf_1(g: Graph) -> DataFrame:
    own = g.at("acts_on", "compound", "P:8").select("target").distinct()
    n = g.acts_on.filter("compound <> 'P:8'").select(F.col("compound").alias("other"), "target").distinct().join(own, "target")
    return n.groupBy("other").agg(F.count("*").alias("common")).orderBy(desc("common"), asc("other")).limit(100)


@query("vis_1_subgraph", "SELECT DISTINCT src, dst, rel FROM link WHERE src IN ('P:1', 'P:2', 'P:3', 'P:4', 'P:5', 'P:6', 'P:7', 'P:8') OR dst IN ('W:1', 'W:2')")
def vis_1(g: Graph) -> DataFrame:
    """The edges around some nodes."""
    return g.link.filter(F.col("src").isin([f"P:{i}" for i in range(1, 9)]) | F.col("dst").isin("W:1", "W:2")).select("src", "dst", "rel").distinct()


@query(
    "vis_3_drug_to_approval",
    "SELECT c.id AS compound, t.id AS trial, s.id AS submission, a.id AS approval FROM compound c JOIN trial_compound x ON x.compound = c.id JOIN trial t ON t.id = x.trial JOIN submission s ON s.key = t.key JOIN approval a ON a.submission = s.id",
)
def vis_3(g: Graph) -> DataFrame:
    """The chain from a compound over its trials to submissions and approvals."""
    c = g.compound.select(F.col("id").alias("compound"))
    t = g.trial_compound.join(c, "compound").join(g.trial.select(F.col("id").alias("trial"), "key"), "trial")
    s = g.submission.select(F.col("id").alias("submission"), "key")
    a = g.approval.select(F.col("id").alias("approval"), "submission")
    return t.join(s, "key").join(a, "submission").select("compound", "trial", "submission", "approval")


@query("vis_2_grid", "SELECT id, (r % 5 * 50)::DOUBLE AS x, (r // 5 * 50)::DOUBLE AS y FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM target)")
def vis_2_grid(g: Graph) -> DataFrame:
    """Targets in a grid."""
    return layout.grid(g.target)


@query("vis_2_circle", "SELECT id, round(100 * cos(2 * pi() * r / n), 4) + 0.0 AS x, round(100 * sin(2 * pi() * r / n), 4) + 0.0 AS y FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM target)")
def vis_2_circle(g: Graph) -> DataFrame:
    """Targets around a circle."""
    return layout.circle(g.target).select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(
    "ga_3_betweenness",
    """WITH e AS (SELECT DISTINCT src, dst FROM layer), p AS (SELECT a.src AS s, a.dst AS m, b.dst AS t FROM e a JOIN e b ON b.src = a.dst WHERE a.src <> b.dst), n AS (SELECT s, t, count(*) AS ways FROM p GROUP BY ALL)
    SELECT m AS id, round(sum(1.0 / ways), 4)::DOUBLE AS score FROM p JOIN n ON n.s = p.s AND n.t = p.t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = p.s AND e.dst = p.t) GROUP BY m""",
)
def ga_3(g: Graph) -> DataFrame:
    """How many shortest paths of two steps lead over each node, those between one pair shared out."""
    return algorithms.two_step_betweenness(g.layer).select("id", F.round("score", 4).alias("score"))


@query(
    "ga_8_all_paths",
    """WITH u AS MATERIALIZED (SELECT src, dst, rel, concat(src, '|', rel, '|', dst) AS edge FROM (SELECT DISTINCT src, dst, rel FROM link)), e AS MATERIALIZED (SELECT * FROM u UNION ALL SELECT dst, src, rel, edge FROM u WHERE src <> dst),
    one AS (SELECT dst AS stop, concat(src, '>', dst) AS path, rel AS rels, edge AS e1 FROM e WHERE src = 'P:3'), two AS MATERIALIZED (SELECT e.dst AS stop, concat(o.path, '>', e.dst) AS path, concat(o.rels, '>', e.rel) AS rels, o.e1, e.edge AS e2 FROM one o JOIN e ON e.src = o.stop WHERE e.edge <> o.e1),
    three AS (SELECT concat(t.path, '>', e.dst) AS path, concat(t.rels, '>', e.rel) AS rels FROM two t JOIN e ON e.src = t.stop AND e.dst = 'W:4' WHERE e.edge <> t.e1 AND e.edge <> t.e2)
    SELECT * FROM (SELECT 1 AS length, path, rels FROM one WHERE stop = 'W:4' UNION ALL SELECT 2, path, rels FROM two WHERE stop = 'W:4' UNION ALL SELECT 3, path, rels FROM three) ORDER BY length, path, rels""",
)
def ga_8(g: Graph) -> DataFrame:
    """All undirected paths of up to three steps between two nodes, over the whole graph."""
    return paths.paths_between(g.link, "P:3", "W:4", 3).select("length", F.array_join("nodes", ">").alias("path"), F.array_join("rels", ">").alias("rels"))


@query("ga_4_communities")
def ga_4(g: Graph) -> DataFrame:
    """Sizes of the communities of the whole graph by greedy modularity."""
    return algorithms.communities(g.link).groupBy("community").agg(F.count("*").alias("n"))


@query(
    "vis_2_levels",
    "SELECT id, round(n * 30.0 * (i::DOUBLE / (n + 1) - 0.5), 4) + 0.0 AS x, ((top - degree) * 50)::DOUBLE AS y FROM (SELECT id, degree, row_number() OVER (PARTITION BY degree ORDER BY id) AS i, count(*) OVER (PARTITION BY degree) AS n, max(degree) OVER () AS top FROM (SELECT target AS id, count(*) AS degree FROM acts_on GROUP BY target))",
)
def vis_2_levels(g: Graph) -> DataFrame:
    """Targets in levels by their number of compounds."""
    degrees = g.acts_on.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("degree"))
    return layout.levels(degrees).select("id", (F.round("x", 4) + 0.0).alias("x"), "y")


@query(
    "vis_2_rings",
    "SELECT id, round(100 * cos(2 * pi() * r / n), 4) + 0.0 AS x, round(100 * sin(2 * pi() * r / n), 4) + 0.0 AS y FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM target WHERE id <> 'S:4') UNION ALL SELECT id, 0, 0 FROM target WHERE id = 'S:4'",
)
def vis_2_rings(g: Graph) -> DataFrame:
    """Targets around one of them."""
    return layout.rings(g.target, "S:4").select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query("vis_2_forces")  # positions by many small steps; the operator is tested by what it must do to a picture
def vis_2_forces(g: Graph) -> DataFrame:
    """Pictures of pathways with their targets, drawn by forces; a pathway of over some 500 targets takes several pictures."""
    edges = g.pathway_target.select(F.col("pathway").alias("whole"), F.col("target").alias("src"), F.col("pathway").alias("dst")).distinct()
    size = edges.groupBy("whole").agg(F.ceil(F.count("*") / 500).alias("parts"))
    rows = edges.join(size, "whole").withColumn("picture", F.concat_ws("/", "whole", F.pmod(F.xxhash64("src"), F.col("parts"))))
    return layout.forces(rows, "picture").select("picture", "id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("ga_3_sampled_betweenness")  # shares of paths of up to five steps; the operator is tested by hand
def ga_3_sampled(g: Graph) -> DataFrame:
    """Which nodes of the layer the shortest paths from a sample of 16 nodes lead over."""
    return algorithms.sampled_betweenness(g.layer, 16).select("id", F.round("score", 4).alias("score"))
