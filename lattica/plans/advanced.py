"""Multi-hop queries: repurposing, competition, safety and supply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import asc, cases, desc, evidence_score, lookup
from lattica.plans.binding import Graph
from lattica.plans.registry import query

MECHANISMS = ["INHIBITS", "ACTIVATES", "MODULATES"]
CONFIDENCE = {"A": "strong", "B": "moderate", "C": "weak"}
_SCORE = "CASE evidence_level WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END"
_CONF = "CASE evidence_level WHEN 'A' THEN 'strong' WHEN 'B' THEN 'moderate' WHEN 'C' THEN 'weak' ELSE 'theoretical' END"
_POTENCY = "CASE WHEN ic50 < 10000 THEN 'potent' WHEN ic50 < 30000 THEN 'moderate' WHEN ic50 IS NOT NULL THEN 'weak' ELSE 'unknown' END"


def repurposing(g: Graph, compound: str, least_level: str = "C", limit: int = 50) -> DataFrame:
    """Diseases that a compound's targets are associated with but that it doesn't treat yet, best evidence first."""
    hits = g.at("acts_on", "compound", compound).filter(F.col("rel").isin(MECHANISMS))
    known = g.at("treats", "compound", compound)
    found = hits.select("compound", "target", F.col("rel").alias("mechanism"), "strength").join(g.associated.select("target", "disease", "evidence_level"), "target")
    found = found.join(known, ["compound", "disease"], "left_anti").withColumn("score", evidence_score(F.col("evidence_level")))
    found = found.filter(F.col("score") >= evidence_score(F.lit(least_level)))
    found = found.join(g.disease.select(F.col("id").alias("disease"), "name"), "disease")
    confidence = lookup(F.col("evidence_level"), CONFIDENCE, "theoretical")
    rows = found.select("disease", "name", "target", "mechanism", "evidence_level", "score", F.round("strength", 4).alias("strength"), confidence.alias("confidence")).distinct()
    return rows.orderBy(desc("score"), desc("strength"), asc("disease"), asc("target"), asc("mechanism")).limit(limit)


@query(
    "adv_1_repurposing",
    f"""SELECT DISTINCT a.disease, d.name, c.target, c.rel AS mechanism, evidence_level, {_SCORE} AS score, round(strength, 4) AS strength, {_CONF} AS confidence
    FROM acts_on c JOIN associated a ON a.target = c.target JOIN disease d ON d.id = a.disease
    WHERE c.compound = 'P:1' AND c.rel IN ('INHIBITS', 'ACTIVATES', 'MODULATES') AND {_SCORE} >= 2
      AND NOT EXISTS (SELECT 1 FROM treats t WHERE t.compound = c.compound AND t.disease = a.disease)
    ORDER BY score DESC, strength DESC, 1, 3, 4 LIMIT 50""",
)
def adv_1(g: Graph) -> DataFrame:
    return repurposing(g, "P:1")


@query(
    "adv_2_candidates",
    f"""SELECT DISTINCT c.compound, c.target, c.rel AS mechanism, {_SCORE} AS score, {_POTENCY} AS potency
    FROM associated a JOIN acts_on c ON c.target = a.target
    WHERE a.disease = 'D:7' AND c.rel = 'INHIBITS' AND NOT EXISTS (SELECT 1 FROM treats t WHERE t.compound = c.compound AND t.disease = a.disease)
    ORDER BY score DESC, potency, 1, 2 LIMIT 50""",
)
def adv_2(g: Graph) -> DataFrame:
    """Compounds that inhibit a target of a disease but don't treat it."""
    a = g.at("associated", "disease", "D:7").select("target", "disease", "evidence_level")
    c = g.acts_on.filter("rel = 'INHIBITS'").join(a, "target").join(g.treats, ["compound", "disease"], "left_anti")
    ic50 = F.col("ic50")
    potency = cases([(ic50 < 10000, "potent"), (ic50 < 30000, "moderate"), (ic50.isNotNull(), "weak")], "unknown")
    rows = c.select("compound", "target", F.col("rel").alias("mechanism"), evidence_score(F.col("evidence_level")).alias("score"), potency.alias("potency")).distinct()
    return rows.orderBy(desc("score"), asc("potency"), asc("compound"), asc("target")).limit(50)


@query(
    "adv_3_combinations",
    """SELECT b.compound AS partner, count(DISTINCT a.target) AS shared_targets, count(DISTINCT w.pathway) AS pathways,
        CASE WHEN count(DISTINCT a.target) >= 3 THEN 'high' WHEN count(DISTINCT a.target) >= 2 THEN 'moderate' ELSE 'low' END AS synergy
    FROM acts_on a JOIN acts_on b ON a.target = b.target AND a.compound <> b.compound JOIN pathway_target w ON w.target = a.target
    WHERE a.compound = 'P:3' GROUP BY b.compound ORDER BY shared_targets DESC, 1 LIMIT 30""",
)
def adv_3(g: Graph) -> DataFrame:
    """Compounds that share targets in pathways with a given one, by how many they share."""
    own = g.at("acts_on", "compound", "P:3").select("target").distinct()
    others = g.acts_on.filter("compound <> 'P:3'").select(F.col("compound").alias("partner"), "target").distinct()
    n = F.count_distinct("target")
    rows = others.join(own, "target").join(g.pathway_target, "target").groupBy("partner").agg(n.alias("shared_targets"), F.count_distinct("pathway").alias("pathways"), cases([(n >= 3, "high"), (n >= 2, "moderate")], "low").alias("synergy"))
    return rows.orderBy(desc("shared_targets"), asc("partner")).limit(30)


@query(
    "adv_4_target_landscape",
    """SELECT a.target, count(DISTINCT compound) AS compounds, count(DISTINCT CASE WHEN rel = 'INHIBITS' THEN compound END) AS inhibitors,
        count(DISTINCT CASE WHEN rel = 'ACTIVATES' THEN compound END) AS activators, count(DISTINCT CASE WHEN rel = 'BINDS_TO' THEN compound END) AS binders,
        count(DISTINCT CASE WHEN approved THEN compound END) AS approved FROM acts_on a JOIN compound c ON c.id = a.compound GROUP BY a.target""",
)
def adv_4(g: Graph) -> DataFrame:
    """For every target: how many compounds act on it, by mechanism and approval."""
    c = g.compound.select(F.col("id").alias("compound"), "approved")
    rel = F.col("rel")
    by = {"inhibitors": rel == "INHIBITS", "activators": rel == "ACTIVATES", "binders": rel == "BINDS_TO", "approved": F.col("approved")}
    # one row for each target and compound first, so that no row is multiplied by the number of counts
    once = g.acts_on.join(c, "compound").groupBy("target", "compound").agg(*[F.max(k).alias(n) for n, k in by.items()])
    return once.groupBy("target").agg(F.count("*").alias("compounds"), *[F.count_if(n).alias(n) for n in by])


@query(
    "adv_5_disease_landscape",
    """SELECT t.compound, c.name, c.stage, c.family AS developer, count(DISTINCT a.target) AS targets,
        CASE c.stage WHEN 'approved' THEN 1 WHEN 'in_review' THEN 2 WHEN 'phase_3' THEN 3 ELSE 4 END AS rank
    FROM treats t JOIN compound c ON c.id = t.compound LEFT JOIN acts_on a ON a.compound = t.compound WHERE t.disease = 'D:11' GROUP BY ALL ORDER BY rank, 1 LIMIT 100""",
)
def adv_5(g: Graph) -> DataFrame:
    """Compounds that treat a disease with developer and targets, those nearest to the market first."""
    t = g.at("treats", "disease", "D:11").select("compound")
    targets = g.acts_on.join(t, "compound", "left_semi").groupBy("compound").agg(F.count_distinct("target").alias("targets"))
    c = g.compound.select(F.col("id").alias("compound"), "name", "stage", F.col("family").alias("developer"))
    rank = lookup(F.col("stage"), {"approved": 1, "in_review": 2, "phase_3": 3}, 4)
    return t.join(c, "compound").join(targets, "compound", "left").select("compound", "name", "stage", "developer", F.coalesce("targets", F.lit(0)).alias("targets"), rank.alias("rank")).orderBy("rank", asc("compound")).limit(100)


@query(
    "adv_6_company_pipeline",
    """SELECT family AS company, count(DISTINCT id) AS compounds, count(DISTINCT CASE WHEN stage = 'approved' THEN id END) AS approved, count(DISTINCT CASE WHEN stage = 'phase_3' THEN id END) AS phase_3,
        count(DISTINCT CASE WHEN stage = 'phase_2' THEN id END) AS phase_2, count(DISTINCT CASE WHEN stage = 'phase_1' THEN id END) AS phase_1, count(DISTINCT CASE WHEN stage = 'preclinical' THEN id END) AS preclinical
    FROM compound GROUP BY family""",
)
def adv_6(g: Graph) -> DataFrame:
    """Compounds of every company by stage. A company filter, where given, is a true filter."""
    stages = ["approved", "phase_3", "phase_2", "phase_1", "preclinical"]
    # ids are unique in the compound view, so plain conditional counts are distinct counts without a second shuffle
    return g.compound.groupBy(F.col("family").alias("company")).agg(F.count("id").alias("compounds"), *[F.count(F.when(F.col("stage") == s, F.col("id"))).alias(s) for s in stages])


@query(
    "adv_7_safety_profile",
    """SELECT c.id AS compound, coalesce(t.trials, 0) AS trials, coalesce(e.events, 0) AS events, coalesce(e.serious, 0) AS serious, coalesce(s.active, 0) AS active_signals
    FROM compound c LEFT JOIN (SELECT compound, count(DISTINCT trial) AS trials FROM trial_compound GROUP BY compound) t ON t.compound = c.id
    LEFT JOIN (SELECT compound, count(*) AS events, count(CASE WHEN serious THEN 1 END) AS serious FROM adverse_event GROUP BY compound) e ON e.compound = c.id
    LEFT JOIN (SELECT compound, count(*) AS active FROM signal WHERE status IN ('under_review', 'confirmed') GROUP BY compound) s ON s.compound = c.id""",
)
def adv_7(g: Graph) -> DataFrame:
    """Every compound's trials, adverse events and active signals; each branch is summed before it is joined."""
    trials = g.trial_compound.groupBy("compound").agg(F.count("trial").alias("trials"))
    events = g.adverse_event.groupBy("compound").agg(F.count("*").alias("events"), F.count_if("serious").alias("serious"))
    signals = g.signal.filter("status IN ('under_review', 'confirmed')").groupBy("compound").agg(F.count("*").alias("active_signals"))
    out = g.compound.select(F.col("id").alias("compound"))
    for part in (trials, events, signals):
        out = out.join(part, "compound", "left")
    return out.fillna(0)


@query(
    "adv_7_common_events",
    """SELECT compound, term, n FROM (SELECT compound, term, severity, count(*) AS n, row_number() OVER (PARTITION BY compound ORDER BY count(*) DESC, term, severity) AS r FROM adverse_event GROUP BY compound, term, severity) WHERE r <= 3""",
)
def adv_7_common(g: Graph) -> DataFrame:
    """The commonest adverse events of each compound."""
    from pyspark.sql.window import Window

    n = g.adverse_event.groupBy("compound", "term", "severity").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("compound").orderBy(F.desc("n"), "term", "severity"))
    return n.withColumn("r", r).filter("r <= 3").select("compound", "term", "n")


@query(
    "adv_9_target_safety",
    """SELECT a.compound, a.rel AS mechanism, coalesce(t.trials, 0) AS trials, coalesce(e.events, 0) AS events, coalesce(e.serious, 0) AS serious, coalesce(s.signals, 0) AS signals
    FROM (SELECT DISTINCT compound, rel FROM acts_on WHERE target = 'S:5') a
    LEFT JOIN (SELECT compound, count(DISTINCT trial) AS trials FROM trial_compound GROUP BY 1) t USING (compound)
    LEFT JOIN (SELECT compound, count(DISTINCT key) AS events, count(DISTINCT CASE WHEN serious THEN key END) AS serious FROM adverse_event GROUP BY 1) e USING (compound)
    LEFT JOIN (SELECT compound, count(DISTINCT id) AS signals FROM signal GROUP BY 1) s USING (compound) ORDER BY serious DESC, compound, mechanism LIMIT 50""",
)
def adv_9(g: Graph) -> DataFrame:
    """Safety of all that acts on a target, by compound and mechanism."""
    a = g.at("acts_on", "target", "S:5").select("compound", F.col("rel").alias("mechanism")).distinct()
    own = a.select("compound").distinct()
    trials = g.trial_compound.join(own, "compound", "left_semi").groupBy("compound").agg(F.count("trial").alias("trials"))
    events = g.adverse_event.groupBy("compound").agg(F.count("key").alias("events"), F.count_if("serious").alias("serious"))
    signals = g.signal.groupBy("compound").agg(F.count("id").alias("signals"))
    for part in (trials, events, signals):
        a = a.join(part, "compound", "left")
    return a.fillna(0).orderBy(desc("serious"), asc("compound"), asc("mechanism")).limit(50)


@query(
    "adv_10_manufacturer_impact",
    """SELECT m.id AS manufacturer, count(DISTINCT p.product) AS products, count(DISTINCT s.product) AS products_short, count(DISTINCT q.manufacturer) AS also_made_by
    FROM manufacturer m JOIN product p ON p.manufacturer = m.id LEFT JOIN (SELECT DISTINCT product FROM shortage) s ON s.product = p.product
    LEFT JOIN product q ON q.product = p.product AND q.manufacturer <> m.id WHERE m.country = 'NATION_7' GROUP BY m.id""",
)
def adv_10(g: Graph) -> DataFrame:
    """What depends on each manufacturer of a country: products, those in shortage, and others that make them."""
    own = g.manufacturer.filter("country = 'NATION_7'").select(F.col("id").alias("manufacturer"))
    made = g.product.join(own, "manufacturer")
    short = g.shortage.select("product").distinct().withColumn("short", F.lit(True))
    sums = made.join(short, "product", "left").groupBy("manufacturer").agg(F.count("product").alias("products"), F.count("short").alias("products_short"))
    others = made.join(g.product.select("product", F.col("manufacturer").alias("other")), "product").filter("other <> manufacturer").groupBy("manufacturer").agg(F.count_distinct("other").alias("also_made_by"))
    return sums.join(others, "manufacturer", "left").fillna(0)


@query(
    "adv_11_shortage_cascade",
    """SELECT s.product, count(DISTINCT s.id) AS shortages, count(DISTINCT t.disease) AS diseases, round(coalesce(sum(DISTINCT d.prevalence * 1.0), 0), 2) AS exposure, (SELECT count(DISTINCT p.manufacturer) FROM product p WHERE p.product = s.product) AS makers
    FROM shortage s LEFT JOIN treats t ON t.compound = s.product LEFT JOIN disease d ON d.id = t.disease WHERE s.product = 'P:9' GROUP BY s.product""",
)
def adv_11(g: Graph) -> DataFrame:
    """What the shortages of one product touch: diseases treated, their summed prevalence, and makers."""
    short = g.shortage.filter("product = 'P:9'").groupBy("product").agg(F.count("id").alias("shortages"))
    d = g.at("treats", "compound", "P:9").join(g.disease, F.col("disease") == F.col("id")).groupBy(F.col("compound").alias("product")).agg(F.count("disease").alias("diseases"), F.sum_distinct("prevalence").alias("exposure"))
    m = g.at("product", "product", "P:9").groupBy("product").agg(F.count("manufacturer").alias("makers"))
    out = short.join(d, "product", "left").join(m, "product", "left")
    return out.select("product", "shortages", F.coalesce("diseases", F.lit(0)).alias("diseases"), F.round(F.coalesce("exposure", F.lit(0.0)), 2).alias("exposure"), F.coalesce("makers", F.lit(0)).alias("makers"))


@query(
    "adv_12_supply_vulnerability",
    """SELECT product, count(DISTINCT manufacturer) AS suppliers, CASE WHEN count(DISTINCT manufacturer) = 1 THEN 'critical' WHEN count(DISTINCT manufacturer) = 2 THEN 'high' WHEN count(DISTINCT manufacturer) <= 3 THEN 'moderate' ELSE 'low' END AS risk
    FROM product GROUP BY product ORDER BY risk, suppliers, product LIMIT 50""",
)
def adv_12(g: Graph) -> DataFrame:
    """Products by how few manufacturers they depend on."""
    n = F.col("suppliers")
    risk = cases([(n == 1, "critical"), (n == 2, "high"), (n <= 3, "moderate")], "low")
    return g.product.groupBy("product").agg(F.count("manufacturer").alias("suppliers")).withColumn("risk", risk).orderBy(asc("risk"), "suppliers", asc("product")).limit(50)


@query("adv_15_first_by_type", "SELECT label, min(id) AS id FROM node GROUP BY label")
def adv_15(g: Graph) -> DataFrame:
    """The first entity of every type."""
    return g.node.groupBy("label").agg(F.min("id").alias("id"))
