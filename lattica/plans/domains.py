"""Lookups, pages and joins of the four domains: research, clinical, supply and regulatory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import all_of, asc, day, desc, page, rate
from lattica.plans.binding import Graph
from lattica.plans.registry import query

COUNTED = ["compound", "target", "trial", "adverse_event", "manufacturer", "shortage", "submission", "approval", "inspection", "signal"]


@query("domain_counts", " UNION ALL ".join(f"SELECT '{v}' AS label, count(*) AS n FROM {v}" for v in COUNTED))
def domain_counts(g: Graph) -> DataFrame:
    """How many there are of each kind (RD-1..2, CL-1..3, SC-1..2, RG-1..3, API-1)."""
    parts = [getattr(g, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("label"), "n") for v in COUNTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("rd_3_compound", "SELECT id, name, class, stage, weight, approved, inchikey FROM compound WHERE id = 'P:17'")
def rd_3(g: Graph) -> DataFrame:
    return g.compound.filter("id = 'P:17'").select("id", "name", "class", "stage", "weight", "approved", "inchikey")


def search_compounds(g: Graph, name: str | None = None, least: float | None = None, most: float | None = None, stage: str | None = None, approved: bool | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """A page of compounds; a filter not given doesn't restrict."""
    c = F.col
    where = all_of(
        None if name is None else F.lower("name").contains(name.lower()),
        None if least is None else c("weight") >= least,
        None if most is None else c("weight") <= most,
        None if stage is None else c("stage") == stage,
        None if approved is None else c("approved") == approved,
    )
    return page(g.compound.filter(where).select("id", "name", "stage", "weight"), [asc("name"), asc("id")], number, size)


@query("rd_4_compound_page", "SELECT id, name, stage, weight FROM compound WHERE contains(lower(name), 'ring') AND weight >= 910 AND weight <= 990 AND stage = 'phase_2' ORDER BY name, id LIMIT 20 OFFSET 5")
def rd_4(g: Graph) -> DataFrame:
    rows = search_compounds(g, name="Ring", least=910, most=990, stage="phase_2", size=25)
    return rows.orderBy(asc("name"), asc("id")).offset(5).limit(20)


@query("rd_5_compound_targets", "SELECT a.target, t.name, t.target_type, a.rel, round(a.ic50, 2) AS ic50 FROM acts_on a JOIN target t ON t.id = a.target WHERE a.compound = 'P:17'")
def rd_5(g: Graph) -> DataFrame:
    a = g.at("acts_on", "compound", "P:17")
    return a.join(g.target.select(F.col("id").alias("target"), "name", "target_type"), "target").select("target", "name", "target_type", "rel", F.round("ic50", 2).alias("ic50"))


@query("rd_6_target_compounds", "SELECT a.compound, c.name, a.rel, a.ic50 FROM acts_on a JOIN compound c ON c.id = a.compound WHERE a.target = 'S:4' ORDER BY ic50, compound, rel LIMIT 100")
def rd_6(g: Graph) -> DataFrame:
    a = g.at("acts_on", "target", "S:4").join(g.compound.select(F.col("id").alias("compound"), "name"), "compound")
    return a.select("compound", "name", "rel", "ic50").orderBy(asc("ic50"), asc("compound"), asc("rel")).limit(100)


@query("rd_7_assays", "SELECT l_orderkey AS assay, l_linenumber AS line, l_suppkey AS target_key, s_name AS target_name, l_quantity AS reading FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = 21")
def rd_7(g: Graph) -> DataFrame:
    """Measurements of a compound, each with its target if it has one."""
    rows = g.lineitem.filter("l_partkey = 21").join(g.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.selectExpr("l_orderkey AS assay", "l_linenumber AS line", "l_suppkey AS target_key", "s_name AS target_name", "l_quantity AS reading")


@query("rd_8_pathway_targets", "SELECT pathway, id, name, rel FROM pathway_target JOIN target ON id = target WHERE pathway = 'W:3'")
def rd_8(g: Graph) -> DataFrame:
    return g.pathway_target.filter("pathway = 'W:3'").join(g.target, F.col("target") == F.col("id")).select("pathway", "id", "name", "rel")


@query("rd_9_disease_targets", "SELECT disease, target, rel, evidence_level FROM associated WHERE disease IN ('D:1', 'D:2', 'D:3', 'D:4', 'D:5')")
def rd_9(g: Graph) -> DataFrame:
    return g.associated.filter(F.col("disease").isin([f"D:{i}" for i in range(1, 6)])).select("disease", "target", "rel", "evidence_level")


@query("rd_10_disease_pathways", "SELECT DISTINCT a.disease, p.pathway FROM associated a JOIN pathway_target p ON p.target = a.target WHERE a.disease IN ('D:1', 'D:2', 'D:3', 'D:4', 'D:5')")
def rd_10(g: Graph) -> DataFrame:
    return rd_9(g).join(g.pathway_target.select("target", "pathway"), "target").select("disease", "pathway").distinct()


@query("rd_11_sar", "SELECT compound, target, round(strength, 4) AS activity FROM acts_on WHERE rel = 'INHIBITS' AND target = 'S:8' ORDER BY activity DESC, compound LIMIT 200")
def rd_11(g: Graph) -> DataFrame:
    rows = g.at("acts_on", "target", "S:8").filter("rel = 'INHIBITS'").select("compound", "target", F.round("strength", 4).alias("activity"))
    return rows.orderBy(desc("activity"), asc("compound")).limit(200)


@query("cl_4_trial", "SELECT t.id, phase, status, enrollment, country, string_agg(DISTINCT d.area, ',' ORDER BY d.area) AS conditions FROM trial t LEFT JOIN site ON site.trial = t.id LEFT JOIN disease d ON d.id = t.disease GROUP BY ALL")
def cl_4(g: Graph) -> DataFrame:
    """Trials with phase, status, site and conditions."""
    t = g.trial
    conditions = t.join(g.disease.select(F.col("id").alias("disease"), "area"), "disease", "left").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("area")), ",").alias("conditions"))
    country = g.site.select(F.col("trial").alias("id"), "country")
    return t.select("id", "phase", "status", "enrollment").join(country, "id", "left").join(conditions, "id", "left")


@query(
    "cl_5_trial_page",
    """SELECT id, phase, status, enrollment FROM trial t WHERE phase = 'Phase 3' AND status = 'Completed' AND enrollment >= 500 AND EXISTS (SELECT 1 FROM disease d WHERE d.id = t.disease AND d.area = 'BUILDING') ORDER BY enrollment DESC, id LIMIT 20""",
)
def cl_5(g: Graph) -> DataFrame:
    """A page of trials whose condition is of an area."""
    area = g.disease.filter("area = 'BUILDING'").select(F.col("id").alias("disease"))
    rows = g.trial.filter("phase = 'Phase 3' AND status = 'Completed' AND enrollment >= 500").join(area, "disease", "left_semi")
    return page(rows.select("id", "phase", "status", "enrollment"), [desc("enrollment"), asc("id")], 1, 20)


@query("cl_6_trial_subjects", "SELECT trial, subject, count(*) AS events, max(severity) AS worst FROM adverse_event GROUP BY ALL")
def cl_6(g: Graph) -> DataFrame:
    """Subjects of trials with their events."""
    return g.adverse_event.groupBy("trial", "subject").agg(F.count("*").alias("events"), F.max("severity").alias("worst"))


@query("cl_7_trial_arms", "SELECT trial, count(DISTINCT compound) AS arms FROM trial_compound GROUP BY trial")
def cl_7(g: Graph) -> DataFrame:
    return g.trial_compound.groupBy("trial").agg(F.count("compound").alias("arms"))


@query("cl_8_interventions", "SELECT trial, compound, c.name, c.stage_order FROM trial_compound JOIN compound c ON c.id = compound WHERE c.stage_order >= 3 ORDER BY stage_order DESC, trial, compound LIMIT 200")
def cl_8(g: Graph) -> DataFrame:
    c = g.compound.filter("stage_order >= 3").select(F.col("id").alias("compound"), "name", "stage_order")
    return g.trial_compound.join(c, "compound").select("trial", "compound", "name", "stage_order").orderBy(desc("stage_order"), asc("trial"), asc("compound")).limit(200)


@query("cl_11_severe_events", "SELECT key, trial, subject, term, severity, strftime(onset, '%Y-%m-%d') AS day FROM adverse_event WHERE severity = 4 ORDER BY onset DESC, key LIMIT 100")
def cl_11(g: Graph) -> DataFrame:
    return g.adverse_event.filter("severity = 4").orderBy(desc("onset"), "key").limit(100).select("key", "trial", "subject", "term", "severity", day("onset"))


@query("cl_12_sites", "SELECT country, region, count(*) AS trials, count(CASE WHEN t.status = 'Recruiting' THEN 1 END) AS recruiting FROM site LEFT JOIN trial t ON t.id = trial GROUP BY ALL")
def cl_12(g: Graph) -> DataFrame:
    t = g.trial.select(F.col("id").alias("trial"), "status")
    return g.site.join(t, "trial", "left").groupBy("country", "region").agg(F.count("*").alias("trials"), F.count_if(F.col("status") == "Recruiting").alias("recruiting"))


@query("cl_13_trials_by_condition", "SELECT t.id, strftime(t.start_date, '%Y-%m-%d') AS day, d.area FROM trial t JOIN disease d ON d.id = t.disease WHERE d.area = 'MACHINERY' ORDER BY start_date DESC, id LIMIT 50")
def cl_13(g: Graph) -> DataFrame:
    d = g.disease.filter("area = 'MACHINERY'").select(F.col("id").alias("disease"), "area")
    return g.trial.join(d, "disease").orderBy(desc("start_date"), asc("id")).limit(50).select("id", day("start_date"), "area")


@query("cl_14_subject_events", "SELECT key, term, severity, strftime(onset, '%Y-%m-%d') AS day FROM adverse_event WHERE subject = 'U:12'")
def cl_14(g: Graph) -> DataFrame:
    return g.adverse_event.filter("subject = 'U:12'").select("key", "term", "severity", day("onset"))


@query("sc_3_manufacturer", "SELECT id, name, country, region, rating FROM manufacturer WHERE id = 'M:3'")
def sc_3(g: Graph) -> DataFrame:
    return g.manufacturer.filter("id = 'M:3'").select("id", "name", "country", "region", "rating")


@query("sc_4_manufacturers", "SELECT id, name, country FROM manufacturer WHERE region = 'EUROPE' AND rating >= 2000 ORDER BY name, id LIMIT 20")
def sc_4(g: Graph) -> DataFrame:
    return page(g.manufacturer.filter("region = 'EUROPE' AND rating >= 2000").select("id", "name", "country"), [asc("name"), asc("id")], 1, 20)


@query("sc_5_manufacturer_drugs", "SELECT manufacturer, product, name FROM product JOIN compound ON id = product WHERE manufacturer = 'M:3'")
def sc_5(g: Graph) -> DataFrame:
    return g.at("product", "manufacturer", "M:3").join(g.compound, F.col("product") == F.col("id")).select("manufacturer", "product", "name")


@query("sc_6_shortages", "SELECT id, product, impact, status, strftime(start_date, '%Y-%m-%d') AS day FROM shortage ORDER BY start_date DESC, id LIMIT 100")
def sc_6(g: Graph) -> DataFrame:
    """All shortages, the latest first."""
    return g.shortage.orderBy(desc("start_date"), asc("id")).limit(100).select("id", "product", "impact", "status", day("start_date"))


@query("sc_7_shortages_by_maker", "SELECT m.id AS manufacturer, m.country, count(s.id) AS shortages FROM manufacturer m LEFT JOIN shortage s ON s.manufacturer = m.id GROUP BY ALL")
def sc_7(g: Graph) -> DataFrame:
    n = g.shortage.groupBy("manufacturer").agg(F.count("*").alias("shortages"))
    return g.manufacturer.select(F.col("id").alias("manufacturer"), "country").join(n, "manufacturer", "left").fillna(0)


@query("sc_8_inspections", "SELECT manufacturer, agency, result, count(*) AS n FROM inspection GROUP BY ALL")
def sc_8(g: Graph) -> DataFrame:
    return g.inspection.groupBy("manufacturer", "agency", "result").agg(F.count("*").alias("n"))


@query("rg_4_submission", "SELECT s.id, s.kind, s.agency, a.id AS approval, a.status, c.name AS product FROM submission s LEFT JOIN approval a ON a.submission = s.id LEFT JOIN compound c ON c.id = s.product")
def rg_4(g: Graph) -> DataFrame:
    a = g.approval.select(F.col("id").alias("approval"), F.col("submission").alias("id"), "status")
    c = g.compound.select(F.col("id").alias("product"), F.col("name").alias("product_name"))
    rows = g.submission.join(a, "id", "left").join(c, "product", "left")
    return rows.select("id", "kind", "agency", "approval", "status", F.col("product_name").alias("product"))


@query("rg_5_submission_page", "SELECT id, kind, agency, strftime(submitted, '%Y-%m-%d') AS day FROM submission WHERE kind = 'NDA' AND agency = 'A:2' ORDER BY submitted DESC, id LIMIT 20 OFFSET 20")
def rg_5(g: Graph) -> DataFrame:
    return page(g.submission.filter("kind = 'NDA' AND agency = 'A:2'"), [desc("submitted"), asc("id")], 2, 20).select("id", "kind", "agency", day("submitted"))


@query("rg_7_active_approvals", "SELECT product, count(*) AS approvals, strftime(max(approved_on), '%Y-%m-%d') AS day FROM approval WHERE status = 'approved' GROUP BY product")
def rg_7(g: Graph) -> DataFrame:
    return g.approval.filter("status = 'approved'").groupBy("product").agg(F.count("*").alias("approvals"), F.max("approved_on").alias("latest")).select("product", "approvals", day("latest"))


@query("rg_9_inspections_by_result", "SELECT id, manufacturer, strftime(inspected, '%Y-%m-%d') AS day FROM inspection WHERE result = 'FAILED' ORDER BY inspected DESC, id LIMIT 100")
def rg_9(g: Graph) -> DataFrame:
    return g.inspection.filter("result = 'FAILED'").orderBy(desc("inspected"), asc("id")).limit(100).select("id", "manufacturer", day("inspected"))


@query(
    "rg_11_agency_statistics",
    """SELECT s.agency, s.submissions, coalesce(a.approvals, 0) AS approvals, round(coalesce(a.approvals, 0) * 100.0 / s.submissions, 2) AS approval_rate FROM (SELECT agency, count(*) AS submissions FROM submission GROUP BY agency) s
    LEFT JOIN (SELECT sb.agency, count(*) AS approvals FROM approval ap JOIN submission sb ON sb.id = ap.submission GROUP BY sb.agency) a ON a.agency = s.agency""",
)
def rg_11(g: Graph) -> DataFrame:
    """Submissions and approvals of every agency, each summed before they are joined."""
    s = g.submission.groupBy("agency").agg(F.count("*").alias("submissions"))
    a = g.approval.select(F.col("submission").alias("id")).join(g.submission.select("id", "agency"), "id").groupBy("agency").agg(F.count("*").alias("approvals"))
    return s.join(a, "agency", "left").fillna(0).withColumn("approval_rate", rate(F.col("approvals"), F.col("submissions")))


@query("rg_13_signals", "SELECT id, compound, status, strftime(detected, '%Y-%m-%d') AS day FROM signal WHERE status = 'under_review' ORDER BY detected DESC, id LIMIT 100")
def rg_13(g: Graph) -> DataFrame:
    return g.signal.filter("status = 'under_review'").orderBy(desc("detected"), asc("id")).limit(100).select("id", "compound", "status", day("detected"))


@query("api_6_research_statistics", "SELECT count(*) AS compounds, count(CASE WHEN approved THEN 1 END) AS approved, count(CASE WHEN stage_order BETWEEN 1 AND 3 THEN 1 END) AS clinical, round(avg(weight), 2) AS mean_weight, min(weight) AS lightest, max(weight) AS heaviest FROM compound")
def api_6(g: Graph) -> DataFrame:
    w = F.col("weight")
    return g.compound.agg(F.count("*").alias("compounds"), F.count_if("approved").alias("approved"), F.count_if(F.col("stage_order").between(1, 3)).alias("clinical"), F.round(F.avg(w), 2).alias("mean_weight"), F.min(w).alias("lightest"), F.max(w).alias("heaviest"))


@query("api_7_drug_trials", "SELECT t.id, t.phase, t.status, strftime(t.start_date, '%Y-%m-%d') AS day FROM trial_compound c JOIN trial t ON t.id = c.trial WHERE c.compound = 'P:30' ORDER BY start_date DESC, id LIMIT 50")
def api_7(g: Graph) -> DataFrame:
    own = g.at("trial_compound", "compound", "P:30").select(F.col("trial").alias("id"))
    return g.trial.join(own, "id").orderBy(desc("start_date"), asc("id")).limit(50).select("id", "phase", "status", day("start_date"))


@query("api_9_clinical_statistics", "SELECT phase, status, count(*) AS trials, CAST(sum(enrollment) AS BIGINT) AS enrolled FROM trial GROUP BY ALL")
def api_9(g: Graph) -> DataFrame:
    return g.trial.groupBy("phase", "status").agg(F.count("*").alias("trials"), F.sum("enrollment").alias("enrolled"))


@query("api_15_network", "SELECT p.manufacturer AS src, q.manufacturer AS dst, count(*) AS products FROM product p JOIN product q ON q.product = p.product AND p.manufacturer < q.manufacturer JOIN (SELECT DISTINCT product FROM shortage WHERE impact = 'critical') s ON s.product = p.product GROUP BY ALL")
def api_15(g: Graph) -> DataFrame:
    """Manufacturers linked by products in critical shortage that both make."""
    short = g.shortage.filter("impact = 'critical'").select("product").distinct()
    p = g.product.join(short, "product", "left_semi")
    q = p.select("product", F.col("manufacturer").alias("dst"))
    return p.select("product", F.col("manufacturer").alias("src")).join(q, "product").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("products"))


@query(
    "api_21_documents",
    """SELECT kind, key, agency, lang FROM (SELECT 'document' AS kind, doc_id AS key, source AS agency, lang FROM documents UNION ALL SELECT 'page', page_id, regexp_extract(url, '://([^/?#]*)', 1), NULL FROM pages)
    ORDER BY agency DESC NULLS FIRST, kind, key LIMIT 50 OFFSET 10""",
)
def api_21(g: Graph) -> DataFrame:
    """A page over documents of two kinds with their columns unified."""
    docs = g.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), F.col("source").alias("agency"), "lang")
    pages = g.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("agency"))
    return docs.unionByName(pages, allowMissingColumns=True).orderBy(desc("agency"), "kind", "key").offset(10).limit(50)


@query("api_23_document_statistics", "SELECT agency, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM document GROUP BY ALL")
def api_23(g: Graph) -> DataFrame:
    return g.document.groupBy("agency", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
