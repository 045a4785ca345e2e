"""More predictions and explanations: adverse reactions, efficacy, deduction, mediators, transitive closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import asc, cases, desc
from lattica.operators.state import saved
from lattica.plans.binding import Graph
from lattica.plans.registry import query


@query(
    "prd_2_adverse_reactions",
    """SELECT e.term, count(*) AS freq, round(least(0.3 + 0.1 * count(*), 0.8), 2)::DOUBLE AS confidence FROM (SELECT DISTINCT y.compound FROM acts_on x JOIN acts_on y ON y.target = x.target AND y.compound <> x.compound WHERE x.compound = 'P:3') o
    JOIN adverse_event e ON e.compound = o.compound WHERE e.serious GROUP BY e.term ORDER BY freq DESC, term LIMIT 20""",
)
def prd_2(g: Graph) -> DataFrame:
    """Serious events of compounds that share a target with a given one."""
    own = g.at("acts_on", "compound", "P:3").select("target").distinct()
    others = g.acts_on.filter("compound <> 'P:3'").join(own, "target", "left_semi").select("compound").distinct()
    e = g.adverse_event.filter("serious").join(others, "compound", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))
    return e.withColumn("confidence", F.round(F.least(0.3 + 0.1 * F.col("freq"), F.lit(0.8)), 2)).orderBy(desc("freq"), asc("term")).limit(20)


@query(
    "prd_4_efficacy",
    """WITH s AS (SELECT d.id AS disease, least(0.3 * coalesce(t.n, 0), 0.9)::DOUBLE AS by_target, least(0.25 * coalesce(k.n, 0), 0.8)::DOUBLE AS by_known FROM disease d
        LEFT JOIN (SELECT a.disease, count(DISTINCT a.target) AS n FROM acts_on c JOIN associated a ON a.target = c.target WHERE c.compound = 'P:5' GROUP BY 1) t ON t.disease = d.id
        LEFT JOIN (SELECT x.disease, count(DISTINCT x.compound) AS n FROM treats x JOIN acts_on y ON y.compound = x.compound WHERE y.target IN (SELECT target FROM acts_on WHERE compound = 'P:5' AND rel = 'INHIBITS') AND y.rel = 'INHIBITS' AND y.strength >= 45 AND x.compound <> 'P:5' GROUP BY 1) k ON k.disease = d.id),
    m AS (SELECT disease, CASE WHEN by_target > 0 AND by_known > 0 THEN (by_target + by_known) / 2 ELSE by_target + by_known END AS score FROM s)
    SELECT disease, round(score, 4) AS score, CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.4 THEN 'MODERATE' ELSE 'LOW' END AS verdict FROM m""",
)
def prd_4(g: Graph) -> DataFrame:
    """How effective a compound may be for each disease: the mean of what speaks for it at all."""
    own = g.at("acts_on", "compound", "P:5")
    t = g.associated.join(own.select("target").distinct(), "target", "left_semi").groupBy("disease").agg(F.count_distinct("target").alias("t"))
    like = g.acts_on.filter("rel = 'INHIBITS' AND strength >= 45 AND compound <> 'P:5'").join(own.filter("rel = 'INHIBITS'").select("target").distinct(), "target", "left_semi").select("compound").distinct()
    k = g.treats.join(like, "compound", "left_semi").groupBy("disease").agg(F.count("compound").alias("k"))
    rows = g.disease.select(F.col("id").alias("disease")).join(t, "disease", "left").join(k, "disease", "left").fillna(0, ["t", "k"])
    parts = F.array(F.least(0.3 * F.col("t"), F.lit(0.9)), F.least(0.25 * F.col("k"), F.lit(0.8)))
    given = F.filter(parts, lambda x: x > 0)
    score = F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.size(given)).otherwise(0.0)
    return rows.select("disease", F.round(score, 4).alias("score"), cases([(score > 0.7, "HIGH"), (score > 0.4, "MODERATE")], "LOW").alias("verdict"))


@query("rsn_1_deductive", "SELECT DISTINCT a.compound, d.disease, 0.7::DOUBLE AS confidence FROM acts_on a JOIN associated d ON d.target = a.target WHERE a.rel = 'INHIBITS' AND a.strength >= 48 AND d.evidence_level IN ('A', 'B')")
def rsn_1(g: Graph) -> DataFrame:
    """What inhibits a target of a disease may treat it."""
    a = g.acts_on.filter("rel = 'INHIBITS' AND strength >= 48").select("compound", "target")
    d = g.associated.filter("evidence_level IN ('A', 'B')").select("target", "disease")
    return a.join(d, "target").select("compound", "disease", F.lit(0.7).alias("confidence")).distinct()


@query("rsn_6_mediators", "SELECT a.target AS mediator, count(*) AS links FROM acts_on a JOIN associated d ON d.target = a.target WHERE a.compound = 'P:3' GROUP BY a.target ORDER BY links DESC, mediator LIMIT 10")
def rsn_6(g: Graph) -> DataFrame:
    """Targets that lie between a compound and diseases."""
    a = g.at("acts_on", "compound", "P:3").select("target")
    return g.associated.join(a, "target").groupBy(F.col("target").alias("mediator")).agg(F.count("*").alias("links")).orderBy(desc("links"), asc("mediator")).limit(10)


@query("rsn_8_explanations", "SELECT DISTINCT a.compound || ' ' || a.rel || ' ' || a.target || ' ' || d.rel || ' ' || d.disease AS explanation FROM acts_on a JOIN associated d ON d.target = a.target WHERE a.compound = 'P:3' ORDER BY 1 LIMIT 50")
def rsn_8(g: Graph) -> DataFrame:
    """Paths from a compound to diseases in words."""
    a = g.at("acts_on", "compound", "P:3").select("compound", F.col("rel").alias("first"), "target")
    return g.associated.join(a, "target").select(F.concat_ws(" ", "compound", "first", "target", "rel", "disease").alias("explanation")).distinct().orderBy("explanation").limit(50)


@query("inf_7_explained_interactions", "SELECT b.compound AS other, 'shares ' || count(DISTINCT b.target) || ' targets' AS reason FROM acts_on a JOIN acts_on b ON b.target = a.target AND b.compound <> a.compound WHERE a.compound = 'P:9' GROUP BY b.compound")
def inf_7(g: Graph) -> DataFrame:
    own = g.at("acts_on", "compound", "P:9").select("target").distinct()
    n = g.acts_on.filter("compound <> 'P:9'").join(own, "target", "left_semi").groupBy(F.col("compound").alias("other")).agg(F.count_distinct("target").alias("n"))
    return n.select("other", F.format_string("shares %d targets", "n").alias("reason"))


def closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """part, whole: the transitive closure of edges (part, whole); each round doubles the length of what is known."""
    now = saved(edges.select("part", "whole").distinct(), "closure")
    n = now.count()
    for _ in range(most_rounds):
        step = now.join(now.select(F.col("part").alias("whole"), F.col("whole").alias("further")), "whole").select("part", F.col("further").alias("whole"))
        now = saved(now.union(step).distinct(), "closure", now)
        more = now.count()
        if more == n:
            return now
        n = more
    raise RuntimeError("the closure did not settle")


@query(
    "owl_2_transitive",
    """WITH e AS (SELECT concat('C:', c_custkey) AS part, concat('N:', c_nationkey) AS whole FROM customer UNION SELECT concat('N:', n_nationkey), concat('R:', n_regionkey) FROM nation UNION SELECT concat('R:', r_regionkey), 'WORLD' FROM region)
    SELECT part, whole FROM e UNION SELECT a.part, b.whole FROM e a JOIN e b ON b.part = a.whole UNION SELECT a.part, c.whole FROM e a JOIN e b ON b.part = a.whole JOIN e c ON c.part = b.whole""",
)
def owl_2(g: Graph) -> DataFrame:
    """PART_OF from customers over nations and regions, closed."""
    c = g.customer.select(F.concat(F.lit("C:"), "c_custkey").alias("part"), F.concat(F.lit("N:"), "c_nationkey").alias("whole"))
    n = g.nation.select(F.concat(F.lit("N:"), "n_nationkey").alias("part"), F.concat(F.lit("R:"), "n_regionkey").alias("whole"))
    r = g.region.select(F.concat(F.lit("R:"), "r_regionkey").alias("part"), F.lit("WORLD").alias("whole"))
    return closure(c.unionByName(n).unionByName(r))
