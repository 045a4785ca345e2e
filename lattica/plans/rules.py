"""Rules: inferred edges, constraint violations, predictions and reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import cases, day
from lattica.plans.binding import Graph
from lattica.plans.registry import query


def without(found: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Inferred edges that aren't there already."""
    return found.join(existing.select(*keys), list(keys), "left_anti")


@query(
    "rul_1_potential_treatment",
    """SELECT a.compound, d.disease, max(round(a.pchembl / 10 * d.confidence, 3)) AS confidence FROM acts_on a JOIN associated d ON d.target = a.target
    WHERE a.pchembl >= 8.5 AND d.confidence >= 0.9 AND NOT EXISTS (SELECT 1 FROM treats t WHERE t.compound = a.compound AND t.disease = d.disease) GROUP BY ALL""",
)
def rul_1(g: Graph) -> DataFrame:
    """Strong activity on a surely associated target: the compound potentially treats the disease."""
    a = g.acts_on.filter("pchembl >= 8.5").select("compound", "target", "pchembl")
    d = g.associated.filter("confidence >= 0.9").select("target", "disease", "confidence")
    found = a.join(d, "target").groupBy("compound", "disease").agg(F.max(F.round(F.col("pchembl") / 10 * F.col("confidence"), 3)).alias("confidence"))
    return without(found, g.treats, "compound", "disease")


@query(
    "rul_2_confirmed_risk",
    """SELECT s.compound, s.disease, least(0.95, round(0.5 + 0.1 * count(DISTINCT e.key), 2))::DOUBLE AS confidence FROM (SELECT DISTINCT compound, disease FROM signal) s JOIN adverse_event e ON e.compound = s.compound AND e.disease = s.disease WHERE e.serious GROUP BY ALL HAVING count(DISTINCT e.key) >= 1""",
)
def rul_2(g: Graph) -> DataFrame:
    """Serious events with the condition of a signal confirm a risk. The bound is 1 here, as the bound tables are thin."""
    e = g.adverse_event.filter("serious").groupBy("compound", "disease").agg(F.count("key").alias("n")).filter("n >= 1")
    return g.signal.select("compound", "disease").distinct().join(e, ["compound", "disease"]).select("compound", "disease", F.least(F.lit(0.95), F.round(0.5 + 0.1 * F.col("n"), 2)).alias("confidence"))


@query("rul_3_quality_issue", "SELECT manufacturer, count(*) AS failed, least(0.9, round(0.4 + 0.15 * count(*), 2))::DOUBLE AS confidence FROM inspection WHERE result = 'FAILED' GROUP BY manufacturer HAVING count(*) >= 2")
def rul_3(g: Graph) -> DataFrame:
    """Two failed inspections or more: a potential quality issue."""
    n = g.inspection.filter("result = 'FAILED'").groupBy("manufacturer").agg(F.count("*").alias("failed")).filter("failed >= 2")
    return n.withColumn("confidence", F.least(F.lit(0.9), F.round(0.4 + 0.15 * F.col("failed"), 2)))


@query("rul_4_competes", "SELECT DISTINCT a.compound AS src, b.compound AS dst FROM acts_on a JOIN acts_on b ON b.target = a.target AND a.compound < b.compound WHERE a.rel = 'INHIBITS' AND b.rel = 'INHIBITS' AND a.strength >= 49 AND b.strength >= 49")
def rul_4(g: Graph) -> DataFrame:
    """Compounds that both strongly inhibit one target compete; each pair once."""
    a = g.acts_on.filter("rel = 'INHIBITS' AND strength >= 49").select("target", F.col("compound").alias("src"))
    return a.join(a.select("target", F.col("src").alias("dst")), "target").filter("src < dst").select("src", "dst").distinct()


@query(
    "rul_5_pathway_treatment",
    """SELECT DISTINCT c.compound, a.disease FROM acts_on c JOIN pathway_target p ON p.target = c.target JOIN pathway_target q ON q.pathway = p.pathway AND q.target <> p.target JOIN associated a ON a.target = q.target
    WHERE c.compound = 'P:40' AND c.strength >= 45 AND a.confidence >= 0.9 AND NOT EXISTS (SELECT 1 FROM treats t WHERE t.compound = c.compound AND t.disease = a.disease)""",
)
def rul_5(g: Graph) -> DataFrame:
    """Diseases that a compound may treat through the pathways of its targets."""
    own = g.at("acts_on", "compound", "P:40").filter("strength >= 45").select("compound", "target")
    p = g.pathway_target.select("target", "pathway")
    near = own.join(p, "target").join(p.select(F.col("target").alias("other"), "pathway"), "pathway").filter("other <> target").select("compound", F.col("other").alias("target")).distinct()
    found = near.join(g.associated.filter("confidence >= 0.9").select("target", "disease"), "target").select("compound", "disease").distinct()
    return without(found, g.treats, "compound", "disease")


@query("rul_6_trial_success", "SELECT DISTINCT t.id AS trial, c.compound, round((0.7 + 0.2) * 0.9, 3) AS confidence FROM trial t JOIN trial_compound c ON c.trial = t.id JOIN acts_on a ON a.compound = c.compound WHERE t.phase IN ('Phase 2', 'Phase 3') AND a.pchembl >= 8.9")
def rul_6(g: Graph) -> DataFrame:
    """Later trials of compounds with a well validated target are likely to succeed."""
    strong = g.acts_on.filter("pchembl >= 8.9").select("compound").distinct()
    t = g.trial.filter("phase IN ('Phase 2', 'Phase 3')").select(F.col("id").alias("trial"))
    return g.trial_compound.join(strong, "compound", "left_semi").join(t, "trial").select("trial", "compound", F.lit(round((0.7 + 0.2) * 0.9, 3)).alias("confidence"))


@query("sh_1_cardinality", "SELECT label, id, count(*) AS n FROM (SELECT 'trial' AS label, l_orderkey || ':' || l_linenumber AS id FROM lineitem UNION ALL SELECT 'compound', id FROM compound) GROUP BY ALL HAVING count(*) > 1")
def sh_1(g: Graph) -> DataFrame:
    """Identifiers that more than one row has."""
    lines = g.lineitem.select(F.lit("trial").alias("label"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"))
    return lines.unionByName(g.compound.select(F.lit("compound").alias("label"), "id")).groupBy("label", "id").agg(F.count("*").alias("n")).filter("n > 1")


@query("sh_13b_edge_ranges", "SELECT compound, target, rel, ic50 FROM acts_on WHERE NOT (ic50 > 0 AND ic50 <= 90000)")
def sh_13b(g: Graph) -> DataFrame:
    """Edges whose values are outside of the range allowed."""
    return g.acts_on.filter("NOT (ic50 > 0 AND ic50 <= 90000)").select("compound", "target", "rel", "ic50")


@query("sh_4_trial_shape", "SELECT t.id FROM trial t WHERE phase = 'N/A' OR NOT EXISTS (SELECT 1 FROM trial_compound c WHERE c.trial = t.id)")
def sh_4(g: Graph) -> DataFrame:
    """Trials without a phase, or that test nothing."""
    idle = g.trial.select("id").join(g.trial_compound.select(F.col("trial").alias("id")), "id", "left_anti")
    return g.trial.filter("phase = 'N/A'").select("id").union(idle).distinct()


@query("sh_10_value_lists", "SELECT id, kind FROM submission WHERE kind NOT IN ('NDA', 'ANDA', 'BLA', 'sNDA')")
def sh_10(g: Graph) -> DataFrame:
    return g.submission.filter(~F.col("kind").isin("NDA", "ANDA", "BLA", "sNDA")).select("id", "kind")


@query("sh_14_contradiction", "SELECT DISTINCT a.compound, a.target FROM acts_on a JOIN acts_on b ON a.compound = b.compound AND a.target = b.target WHERE a.rel = 'INHIBITS' AND b.rel = 'ACTIVATES'")
def sh_14(g: Graph) -> DataFrame:
    """Compounds said to inhibit and to activate one target: one pass instead of a self-join."""
    both = g.acts_on.groupBy("compound", "target").agg(F.bool_or(F.col("rel") == "INHIBITS").alias("i"), F.bool_or(F.col("rel") == "ACTIVATES").alias("a"))
    return both.filter("i AND a").select("compound", "target")


@query("sh_15_inspection_conflict", "SELECT manufacturer, strftime(inspected, '%Y-%m-%d') AS day FROM inspection GROUP BY ALL HAVING count(DISTINCT result) > 1")
def sh_15(g: Graph) -> DataFrame:
    """Manufacturers that passed and failed on one day."""
    return g.inspection.groupBy("manufacturer", day("inspected")).agg(F.count_distinct("result").alias("n")).filter("n > 1").select("manufacturer", "day")


@query("sh_18_region_closure", "SELECT DISTINCT concat('C:', c_custkey) AS part, concat('R:', n_regionkey) AS whole FROM customer JOIN nation ON n_nationkey = c_nationkey")
def sh_18(g: Graph) -> DataFrame:
    """PART_OF over two steps: what lies in a nation lies in its region."""
    nation = g.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return g.customer.join(F.broadcast(nation), "c_nationkey").select(F.concat(F.lit("C:"), "c_custkey").alias("part"), F.concat(F.lit("R:"), "n_regionkey").alias("whole")).distinct()


def _inferred_by(g: Graph, rel: str) -> DataFrame:
    hits = g.acts_on.filter("rel = 'INHIBITS' AND strength >= 47").select("compound", "target")
    found = hits.join(g.associated.filter(F.col("rel") == rel).select("target", "disease"), "target").select("compound", "disease").distinct()
    return without(found, g.treats, "compound", "disease")


def _inferred_sql(rel: str) -> str:
    return f"""SELECT DISTINCT c.compound, a.disease FROM acts_on c JOIN associated a ON a.target = c.target WHERE c.rel = 'INHIBITS' AND c.strength >= 47 AND a.rel = '{rel}'
        AND NOT EXISTS (SELECT 1 FROM treats t WHERE t.compound = c.compound AND t.disease = a.disease)"""


@query("sh_19_infer_causes", _inferred_sql("CAUSES_DISEASE"))
def sh_19(g: Graph) -> DataFrame:
    """A compound that inhibits what causes a disease potentially treats it."""
    return _inferred_by(g, "CAUSES_DISEASE")


@query("sh_20_infer_biomarker", _inferred_sql("BIOMARKER_FOR"))
def sh_20(g: Graph) -> DataFrame:
    return _inferred_by(g, "BIOMARKER_FOR")


@query("sh_21_new_signals", "SELECT DISTINCT e.compound, sha1(concat(e.compound, '-', e.key, '-', e.trial)) AS signal FROM adverse_event e WHERE e.serious AND NOT EXISTS (SELECT 1 FROM signal s WHERE s.compound = e.compound)")
def sh_21(g: Graph) -> DataFrame:
    """A new signal for every serious event of a compound without any; its id is a hash of what it is about."""
    e = g.adverse_event.filter("serious").join(g.signal.select("compound"), "compound", "left_anti")
    return e.select("compound", F.sha1(F.concat_ws("-", "compound", "key", "trial")).alias("signal")).distinct()


@query("sh_22_escalate", "SELECT s.id FROM signal s JOIN (SELECT compound FROM adverse_event WHERE serious GROUP BY compound HAVING count(DISTINCT trial) >= 3) e ON e.compound = s.compound WHERE s.status = 'under_review'")
def sh_22(g: Graph) -> DataFrame:
    """Signals under review whose compound has serious events in three trials or more are confirmed."""
    e = g.adverse_event.filter("serious").groupBy("compound").agg(F.count_distinct("trial").alias("n")).filter("n >= 3")
    return g.signal.filter("status = 'under_review'").join(e, "compound", "left_semi").select("id")


@query("sh_24_infer_shortage", "SELECT DISTINCT p.product FROM product p JOIN (SELECT manufacturer FROM inspection WHERE result = 'FAILED' GROUP BY manufacturer HAVING count(*) >= 3) f ON f.manufacturer = p.manufacturer WHERE NOT EXISTS (SELECT 1 FROM shortage s WHERE s.product = p.product)")
def sh_24(g: Graph) -> DataFrame:
    """Products of high-risk manufacturers, unless a shortage is known."""
    risky = g.inspection.filter("result = 'FAILED'").groupBy("manufacturer").count().filter("count >= 3")
    return g.product.join(risky, "manufacturer", "left_semi").join(g.shortage.select("product"), "product", "left_anti").select("product").distinct()


def _pathway_effect(g: Graph, mechanism: str, effect: str) -> DataFrame:
    a = g.acts_on.filter((F.col("rel") == mechanism) & (F.col("strength") >= 40)).select("compound", "target")
    return a.join(g.pathway_target.filter(F.col("rel") == effect).select("target", "pathway"), "target").select("compound", "pathway").distinct()


def _effect_sql(mechanism: str, effect: str) -> str:
    return f"SELECT DISTINCT a.compound, p.pathway FROM acts_on a JOIN pathway_target p ON p.target = a.target WHERE a.rel = '{mechanism}' AND a.strength >= 40 AND p.rel = '{effect}'"


@query("sh_25_inhibits_pathway", _effect_sql("INHIBITS", "UPREGULATES"))
def sh_25(g: Graph) -> DataFrame:
    return _pathway_effect(g, "INHIBITS", "UPREGULATES")


@query("sh_26_activates_down", _effect_sql("ACTIVATES", "DOWNREGULATES"))
def sh_26(g: Graph) -> DataFrame:
    return _pathway_effect(g, "ACTIVATES", "DOWNREGULATES")


@query("sh_28_dangling", "SELECT 'event' AS kind, CAST(key AS VARCHAR) AS id FROM adverse_event e WHERE NOT EXISTS (SELECT 1 FROM trial t WHERE t.id = e.trial) UNION ALL SELECT 'shortage', id FROM shortage s WHERE NOT EXISTS (SELECT 1 FROM product p WHERE p.product = s.product AND p.manufacturer = s.manufacturer)")
def sh_28(g: Graph) -> DataFrame:
    """References to what isn't there."""
    e = g.adverse_event.join(g.trial.select(F.col("id").alias("trial")), "trial", "left_anti").select(F.lit("event").alias("kind"), F.col("key").cast("string").alias("id"))
    s = g.shortage.join(g.product, ["product", "manufacturer"], "left_anti").select(F.lit("shortage").alias("kind"), "id")
    return e.unionByName(s)


@query("sh_31_date_order", "SELECT a.id FROM approval a JOIN submission s ON s.id = a.submission WHERE a.approved_on < s.submitted + INTERVAL 300 DAY UNION ALL SELECT id FROM shortage WHERE end_date < start_date")
def sh_31(g: Graph) -> DataFrame:
    """Dates in the wrong order."""
    a = g.approval.join(g.submission.select(F.col("id").alias("submission"), "submitted"), "submission").filter("approved_on < submitted + INTERVAL 300 DAY").select("id")
    return a.union(g.shortage.filter("end_date < start_date").select("id"))


@query("sh_36_formats", "SELECT id, inchikey FROM compound WHERE NOT regexp_matches(inchikey, '^[A-F]{2}[0-9A-F]{12}$')")
def sh_36(g: Graph) -> DataFrame:
    """Keys that don't have the form asked for."""
    return g.compound.filter(~F.col("inchikey").rlike("^[A-F]{2}[0-9A-F]{12}$")).select("id", "inchikey")


@query("sh_38_no_authorisation", "SELECT c.id FROM compound c WHERE c.approved AND NOT EXISTS (SELECT 1 FROM approval a WHERE a.product = c.id)")
def sh_38(g: Graph) -> DataFrame:
    """Compounds called approved that no approval is for."""
    return g.compound.filter("approved").select("id").join(g.approval.select(F.col("product").alias("id")), "id", "left_anti")


@query("sh_39_trial_without_treatment", "SELECT t.id AS trial, c.compound, t.disease FROM trial t JOIN trial_compound c ON c.trial = t.id WHERE NOT EXISTS (SELECT 1 FROM treats x WHERE x.compound = c.compound AND x.disease = t.disease)")
def sh_39(g: Graph) -> DataFrame:
    """Trials whose disease isn't one that the tested compound treats."""
    t = g.trial.select(F.col("id").alias("trial"), "disease")
    return g.trial_compound.join(t, "trial").join(g.treats, ["compound", "disease"], "left_anti").select("trial", "compound", "disease")


INVERSE = {"INHIBITS": "INHIBITED_BY", "ACTIVATES": "ACTIVATED_BY", "BINDS_TO": "BOUND_BY"}


@query("owl_1_inverse_edges", "SELECT target AS src, compound AS dst, CASE rel WHEN 'INHIBITS' THEN 'INHIBITED_BY' WHEN 'ACTIVATES' THEN 'ACTIVATED_BY' ELSE 'BOUND_BY' END AS rel FROM acts_on")
def owl_1(g: Graph) -> DataFrame:
    """Every edge of a type that has an inverse, turned round."""
    from lattica.functions.cypher import lookup

    return g.acts_on.select(F.col("target").alias("src"), F.col("compound").alias("dst"), lookup(F.col("rel"), INVERSE, None).alias("rel"))


def _shared_targets(g: Graph, seed: str) -> DataFrame:
    own = g.at("acts_on", "compound", seed).select("target").distinct()
    return g.acts_on.filter(F.col("compound") != seed).select("compound", "target").distinct().join(own, "target").groupBy("compound").agg(F.count("*").alias("shared"))


@query(
    "inf_3_interactions",
    """SELECT b.id AS other, coalesce(s.shared, 0) AS shared, round(greatest(least(0.2 * coalesce(s.shared, 0), 1.0), CASE WHEN substring(a.inchikey, 1, 14) = substring(b.inchikey, 1, 14) THEN 0.8 WHEN substring(a.inchikey, 1, 7) = substring(b.inchikey, 1, 7) THEN 0.64 ELSE 0.0 END), 3)::DOUBLE AS score
    FROM compound a JOIN compound b ON b.id <> a.id LEFT JOIN (SELECT y.compound, count(DISTINCT y.target) AS shared FROM acts_on x JOIN acts_on y ON y.target = x.target AND y.compound <> x.compound WHERE x.compound = 'P:3' GROUP BY y.compound) s ON s.compound = b.id WHERE a.id = 'P:3'""",
)
def inf_3(g: Graph) -> DataFrame:
    """How likely a compound interacts with each other one: shared targets or similar structure, whichever says more."""
    key = g.compound.filter("id = 'P:3'").select(F.col("inchikey").alias("own"))
    rows = g.compound.filter("id <> 'P:3'").select(F.col("id").alias("compound"), "inchikey").join(F.broadcast(key)).join(_shared_targets(g, "P:3"), "compound", "left").fillna(0, ["shared"])
    same = lambda n: F.substring("own", 1, n) == F.substring("inchikey", 1, n)
    structure = cases([(same(14), 0.8), (same(7), 0.64)], 0.0)
    return rows.select(F.col("compound").alias("other"), "shared", F.round(F.greatest(F.least(0.2 * F.col("shared"), F.lit(1.0)), structure), 3).alias("score"))


@query(
    "inf_5_indications",
    """SELECT d.id AS disease, round(greatest(CASE WHEN t.disease IS NOT NULL THEN 1.0 ELSE 0.0 END, least(0.15 * coalesce(p.n, 0), 0.9)), 3)::DOUBLE AS score,
        CASE WHEN greatest(CASE WHEN t.disease IS NOT NULL THEN 1.0 ELSE 0.0 END, least(0.15 * coalesce(p.n, 0), 0.9)) > 0.3 THEN 'POTENTIAL' ELSE 'UNLIKELY' END AS verdict
    FROM disease d LEFT JOIN (SELECT disease FROM treats WHERE compound = 'P:3') t ON t.disease = d.id LEFT JOIN (SELECT a.disease, count(DISTINCT a.target) AS n FROM acts_on c JOIN associated a ON a.target = c.target WHERE c.compound = 'P:3' GROUP BY a.disease) p ON p.disease = d.id""",
)
def inf_5(g: Graph) -> DataFrame:
    """How likely a compound is indicated for each disease: known, or through its targets."""
    known = g.at("treats", "compound", "P:3").select("disease", F.lit(1.0).alias("known"))
    own = g.at("acts_on", "compound", "P:3").select("target").distinct()
    paths = g.associated.join(own, "target").groupBy("disease").agg(F.count_distinct("target").alias("n"))
    rows = g.disease.select(F.col("id").alias("disease")).join(known, "disease", "left").join(paths, "disease", "left")
    score = F.greatest(F.coalesce("known", F.lit(0.0)), F.least(0.15 * F.coalesce("n", F.lit(0)), F.lit(0.9)))
    return rows.select("disease", F.round(score, 3).alias("score"), F.when(score > 0.3, "POTENTIAL").otherwise("UNLIKELY").alias("verdict"))


@query(
    "inf_6_target_disease",
    """SELECT a.target, t.disease, round(least(0.25 * count(DISTINCT a.compound), 0.8), 2)::DOUBLE AS score FROM acts_on a JOIN treats t ON t.compound = a.compound WHERE a.target = 'S:6' AND NOT EXISTS (SELECT 1 FROM associated k WHERE k.target = a.target AND k.disease = t.disease) GROUP BY ALL""",
)
def inf_6(g: Graph) -> DataFrame:
    """Diseases that a target's compounds treat."""
    a = g.at("acts_on", "target", "S:6").select("target", "compound").distinct()
    found = a.join(g.treats, "compound").groupBy("target", "disease").agg(F.count("*").alias("n"))
    return without(found, g.associated, "target", "disease").select("target", "disease", F.round(F.least(0.25 * F.col("n"), F.lit(0.8)), 2).alias("score"))


BASE = {"Phase 1": 0.7, "Phase 2": 0.5, "Phase 3": 0.6, "Phase 4": 0.85}


def trial_outcome(phase: Column, enrolled: Column) -> Column:
    """The probability that a trial succeeds, from its phase and size."""
    from lattica.functions.cypher import lookup

    size = cases([((enrolled > 0) & (enrolled < 50), F.lit(0.9)), (enrolled > 500, F.lit(1.05))], F.lit(1.0))
    return F.least(F.greatest(lookup(phase, BASE, 0.5) * size, F.lit(0.2)), F.lit(0.95))


_P = "least(greatest(CASE phase WHEN 'Phase 1' THEN 0.7 WHEN 'Phase 2' THEN 0.5 WHEN 'Phase 3' THEN 0.6 WHEN 'Phase 4' THEN 0.85 ELSE 0.5 END::DOUBLE * (CASE WHEN enrollment > 0 AND enrollment < 50 THEN 0.9 WHEN enrollment > 500 THEN 1.05 ELSE 1.0 END)::DOUBLE, 0.2), 0.95)"


@query("prd_3_trial_outcome", f"SELECT id, round({_P}, 4) AS probability, CASE WHEN {_P} > 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS outcome, round(0.5 + abs({_P} - 0.5), 4) AS confidence FROM trial")
def prd_3(g: Graph) -> DataFrame:
    p = trial_outcome(F.col("phase"), F.col("enrollment"))
    return g.trial.select("id", F.round(p, 4).alias("probability"), F.when(p > 0.5, "POSITIVE").otherwise("NEGATIVE").alias("outcome"), F.round(0.5 + F.abs(p - 0.5), 4).alias("confidence"))


@query(
    "prd_1_repurposing_ensemble",
    """SELECT compound, max(confidence)::DOUBLE AS confidence, string_agg(method, ',' ORDER BY method) AS methods FROM (
        SELECT DISTINCT c.compound, 0.7 AS confidence, 'target' AS method FROM acts_on c JOIN associated a ON a.target = c.target WHERE a.disease = 'D:10' AND c.strength >= 30
        UNION ALL SELECT compound, least(0.5 + 0.1 * n, 0.95), 'similar' FROM (SELECT y.compound, count(DISTINCT y.target) AS n FROM treats t JOIN acts_on x ON x.compound = t.compound JOIN acts_on y ON y.target = x.target AND y.compound <> x.compound WHERE t.disease = 'D:10' AND x.strength >= 45 AND y.strength >= 45 GROUP BY y.compound)) GROUP BY compound""",
)
def prd_1(g: Graph) -> DataFrame:
    """Candidates for a disease by two methods: their best confidence and which methods found them."""
    a = g.at("associated", "disease", "D:10").select("target").distinct()
    direct = g.acts_on.filter("strength >= 30").join(a, "target", "left_semi").select("compound").distinct().select("compound", F.lit(0.7).alias("confidence"), F.lit("target").alias("method"))
    strong = g.acts_on.filter("strength >= 45").select("compound", "target").distinct()
    known = g.at("treats", "disease", "D:10").select("compound")
    x = strong.join(known, "compound", "left_semi").select("target", F.col("compound").alias("from"))
    similar = strong.join(x, "target").filter("compound <> `from`").groupBy("compound").agg(F.count_distinct("target").alias("n")).select("compound", F.least(0.5 + 0.1 * F.col("n"), F.lit(0.95)).alias("confidence"), F.lit("similar").alias("method"))
    return direct.unionByName(similar).groupBy("compound").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_list("method")), ",").alias("methods"))


@query(
    "rsn_2_inductive",
    """SELECT target, observations, round(successes * 1.0 / observations, 4) AS success_rate, round(least(successes * 1.0 / observations + 0.1, 1.0), 4) AS confidence FROM (SELECT a.target, count(*) AS observations, count(CASE WHEN c.approved THEN 1 END) AS successes FROM acts_on a JOIN compound c ON c.id = a.compound GROUP BY a.target) WHERE observations >= 3 AND successes * 1.0 / observations > 0.1""",
)
def rsn_2(g: Graph) -> DataFrame:
    """Targets whose compounds mostly succeeded, learned from at least three observations."""
    rows = g.acts_on.join(g.compound.select(F.col("id").alias("compound"), "approved"), "compound").groupBy("target").agg(F.count("*").alias("observations"), F.count_if("approved").alias("successes"))
    share = F.col("successes") / F.col("observations")
    return rows.filter("observations >= 3").filter(share > 0.1).select("target", "observations", F.round(share, 4).alias("success_rate"), F.round(F.least(share + 0.1, F.lit(1.0)), 4).alias("confidence"))


@query("rsn_3_abductive", "SELECT DISTINCT e.compound, a.target, 0.7 AS confidence FROM adverse_event e JOIN acts_on a ON a.compound = e.compound JOIN associated d ON d.target = a.target AND d.disease = e.disease")
def rsn_3(g: Graph) -> DataFrame:
    """Targets that would explain an adverse event."""
    e = g.adverse_event.select("compound", "disease").distinct()
    a = g.acts_on.select("compound", "target").distinct()
    return e.join(a, "compound").join(g.associated.select("target", "disease"), ["target", "disease"], "left_semi").select("compound", "target", F.lit(0.7).alias("confidence")).distinct()


@query("rsn_4_analogy", "SELECT DISTINCT b.id AS other FROM compound a JOIN compound b ON substring(b.inchikey, 1, 7) = substring(a.inchikey, 1, 7) AND b.id <> a.id WHERE a.id = 'P:3' AND EXISTS (SELECT 1 FROM acts_on x JOIN acts_on y ON y.target = x.target WHERE x.compound = a.id AND y.compound = b.id)")
def rsn_4(g: Graph) -> DataFrame:
    """Compounds of like structure that share a target."""
    key = g.compound.select(F.substring("inchikey", 1, 7).alias("prefix"), "id")
    own = F.broadcast(key.filter("id = 'P:3'").select("prefix"))
    like = key.filter("id <> 'P:3'").join(own, "prefix").select(F.col("id").alias("other"))
    return like.join(_shared_targets(g, "P:3").select(F.col("compound").alias("other")), "other", "left_semi").distinct()
