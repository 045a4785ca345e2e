"""Shapes that the entities must have, and lookups over trials' subjects, actions against makers, and commitments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import asc, day, desc, rate
from lattica.operators import shapes
from lattica.plans.binding import AS_OF, Graph
from lattica.plans.registry import query

#: shape: its counts as (constraint, nodes' view, their id, related view, its id, which related rows, least, most), ...
COUNTS = {
    "sh_2_target": [
        ("one_id", "target", "id", "target", "id", "TRUE", 1, 1),
        ("in_pathway", "target", "id", "pathway_target", "target", "rel = 'PARTICIPATES_IN'", 1, None),
        ("regulates_pathway", "target", "id", "pathway_target", "target", "rel <> 'PARTICIPATES_IN'", 1, None),
    ],
    "sh_3_disease": [("one_id", "disease", "id", "disease", "id", "TRUE", 1, 1), ("has_name", "disease", "id", "disease", "id", "name IS NOT NULL", 1, None)],
    "sh_5_subject": [
        ("enrolled", "participation", "subject", "participation", "subject", "trial IS NOT NULL", 1, None),
        ("one_arm_at_most", "participation", "subject", "participation", "subject", "arm IS NOT NULL", 0, 1),
    ],
    "sh_6_intervention": [
        ("for_compound", "trial_compound", "compound", "compound", "id", "TRUE", 1, 1),
        ("has_name", "trial_compound", "compound", "compound", "id", "name IS NOT NULL", 1, None),
    ],
    "sh_7_manufacturer": [("one_id", "manufacturer", "id", "manufacturer", "id", "TRUE", 1, 1), ("has_location", "manufacturer", "id", "manufacturer", "id", "country IS NOT NULL", 1, None)],
    "sh_8_product": [("one_id", "compound", "id", "compound", "id", "TRUE", 1, 1), ("manufactured_by", "compound", "id", "product", "product", "TRUE", 1, None)],
    "sh_9_shortage": [
        ("one_id", "shortage", "id", "shortage", "id", "TRUE", 1, 1),
        ("one_product", "shortage", "id", "shortage", "id", "product IS NOT NULL", 1, 1),
        ("one_start", "shortage", "id", "shortage", "id", "start_date IS NOT NULL", 1, 1),
    ],
    "sh_10_submission": [
        ("one_id", "submission", "id", "submission", "id", "TRUE", 1, 1),
        ("one_product", "submission", "id", "submission", "id", "product IS NOT NULL", 1, 1),
        ("one_agency", "submission", "id", "submission", "id", "agency IS NOT NULL", 1, 1),
        ("kind", "submission", "id", "submission", "id", "kind NOT IN ('NDA', 'ANDA', 'BLA', 'sNDA')", 0, 0),
    ],
    "sh_11_approval": [
        ("one_product", "approval", "id", "approval", "id", "product IS NOT NULL", 1, 1),
        ("one_date", "approval", "id", "approval", "id", "approved_on IS NOT NULL", 1, 1),
        ("status", "approval", "id", "approval", "id", "status NOT IN ('approved', 'rejected', 'pending', 'withdrawn')", 0, 0),
    ],
    "sh_12_action": [
        ("one_id", "action", "id", "action", "id", "TRUE", 1, 1),
        ("recalls_product", "action", "id", "action", "id", "kind = 'recall' AND product IS NOT NULL", 1, None),
        ("kind", "action", "id", "action", "id", "kind NOT IN ('recall', 'warning', 'penalty', 'suspension')", 0, 0),
    ],
    "sh_13_signal": [
        ("one_compound", "signal", "id", "signal", "id", "compound IS NOT NULL", 1, 1),
        ("status", "signal", "id", "signal", "id", "status NOT IN ('under_review', 'confirmed', 'rejected', 'monitoring')", 0, 0),
    ],
}


def _count_sql(constraint: str, nodes: str, key: str, related: str, other: str, where: str, least: int, most: int | None) -> str:
    broken = f"coalesce(n, 0) < {least}" + ("" if most is None else f" OR n > {most}")
    return f"""SELECT '{constraint}' AS constraint_name, count(*) AS checked, count(CASE WHEN {broken} THEN 1 END) AS violations
        FROM (SELECT DISTINCT {key} AS node_id FROM {nodes} WHERE {key} IS NOT NULL) LEFT JOIN (SELECT {other} AS node_id, count(*) AS n FROM {related} WHERE {where} GROUP BY 1) USING (node_id)"""


def _shape(name: str, counts: list[tuple]) -> None:
    @query(name, " UNION ALL ".join(_count_sql(*c) for c in counts))
    def run(g: Graph) -> DataFrame:
        """How many nodes each constraint of a shape was checked on, and how many break it."""
        parts = [shapes.judged(getattr(g, nodes).select(F.col(key).alias("id")), getattr(g, related).filter(where).select(F.col(other).alias("id")), least, most, constraint) for constraint, nodes, key, related, other, where, least, most in counts]
        return reduce(DataFrame.unionByName, parts)


for _name, _counts in COUNTS.items():
    _shape(_name, _counts)


@query("sh_16_completed_and_withdrew", "SELECT subject, trial FROM participation GROUP BY subject, trial HAVING bool_or(rel = 'COMPLETED_TRIAL') AND bool_or(rel = 'WITHDREW_FROM')")
def sh_16(g: Graph) -> DataFrame:
    """Subjects said to have completed a trial and to have left it: one pass instead of a self-join."""
    both = g.participation.groupBy("subject", "trial").agg(F.bool_or(F.col("rel") == "COMPLETED_TRIAL").alias("done"), F.bool_or(F.col("rel") == "WITHDREW_FROM").alias("left"))
    return both.filter("done AND left").select("subject", "trial")


@query("sh_34_ids_and_names", "SELECT label, count(*) AS nodes, count(CASE WHEN id IS NULL THEN 1 END) AS without_id, count(CASE WHEN name IS NULL OR name = '' THEN 1 END) AS without_name FROM node GROUP BY label")
def sh_34(g: Graph) -> DataFrame:
    """Nodes without an id or a name, by label."""
    blank = F.col("name").isNull() | (F.col("name") == "")
    return g.node.groupBy("label").agg(F.count("*").alias("nodes"), F.count_if(F.col("id").isNull()).alias("without_id"), F.count_if(blank).alias("without_name"))


@query("cl_10_trial_events", "SELECT trial, severity, count(*) AS events, count(DISTINCT subject) AS subjects, count(CASE WHEN serious THEN 1 END) AS serious FROM adverse_event GROUP BY trial, severity")
def cl_10(g: Graph) -> DataFrame:
    """The adverse events of every trial by severity."""
    return g.adverse_event.groupBy("trial", "severity").agg(F.count("*").alias("events"), F.count_distinct("subject").alias("subjects"), F.count_if("serious").alias("serious"))


@query("cl_q3_4_subject_history", "SELECT p.trial, p.arm, p.rel, t.phase, strftime(t.start_date, '%Y-%m-%d') AS day FROM participation p JOIN trial t ON t.id = p.trial WHERE p.subject = 'U:12'")
def subject_history(g: Graph) -> DataFrame:
    """The trials that a subject was in."""
    own = g.at("participation", "subject", "U:12").select(F.col("trial").alias("id"), "arm", "rel")
    return g.trial.join(own, "id").select(F.col("id").alias("trial"), "arm", "rel", "phase", day("start_date"))


@query("cl_q4_2_enrolled_per_arm", "SELECT trial, arm, count(DISTINCT subject) AS subjects FROM participation GROUP BY trial, arm")
def enrolled_per_arm(g: Graph) -> DataFrame:
    return g.participation.groupBy("trial", "arm").agg(F.count_distinct("subject").alias("subjects"))


@query("cl_q14_3_withdrawals", "SELECT t.phase, count(*) AS participations, count(CASE WHEN p.rel = 'WITHDREW_FROM' THEN 1 END) AS withdrawals, round(count(CASE WHEN p.rel = 'WITHDREW_FROM' THEN 1 END) * 100.0 / count(*), 2)::DOUBLE AS share FROM participation p JOIN trial t ON t.id = p.trial GROUP BY t.phase")
def withdrawals(g: Graph) -> DataFrame:
    """How many subjects left trials early, by phase; summed by trial before the join."""
    p = g.participation.groupBy(F.col("trial").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("rel") == "WITHDREW_FROM").alias("gone"))
    n = g.trial.select("id", "phase").join(p, "id").groupBy("phase").agg(F.sum("n").alias("participations"), F.sum("gone").alias("withdrawals"))
    return n.withColumn("share", rate(F.col("withdrawals"), F.col("participations")))


@query("cl_q15_3_status_by_year", "SELECT start_year, status, count(*) AS n FROM trial GROUP BY start_year, status")
def status_by_year(g: Graph) -> DataFrame:
    return g.trial.groupBy("start_year", "status").agg(F.count("*").alias("n"))


@query("sc_9_manufacturer_actions", "SELECT id, product, kind, active, strftime(issued, '%Y-%m-%d') AS day FROM action WHERE manufacturer = 'M:3' ORDER BY issued DESC, id LIMIT 100")
def sc_9(g: Graph) -> DataFrame:
    """Actions against one maker, the latest first."""
    return g.at("action", "manufacturer", "M:3").orderBy(desc("issued"), asc("id")).limit(100).select("id", "product", "kind", "active", day("issued"))


@query("rg_10_actions", "SELECT a.id, a.kind, m.name, m.country, strftime(a.issued, '%Y-%m-%d') AS day FROM action a LEFT JOIN manufacturer m ON m.id = a.manufacturer WHERE a.active ORDER BY a.issued DESC, a.id LIMIT 100")
def rg_10(g: Graph) -> DataFrame:
    """Active actions, the latest first: makers are looked up for the page alone."""
    top = g.action.filter("active").orderBy(desc("issued"), asc("id")).limit(100)
    m = g.manufacturer.select(F.col("id").alias("manufacturer"), "name", "country")
    return top.join(m, "manufacturer", "left").select("id", "kind", "name", "country", day("issued"))


@query("rg_12_commitments", "SELECT id, approval, product, kind, strftime(due, '%Y-%m-%d') AS day FROM commitment WHERE status = 'pending' ORDER BY due, id LIMIT 50")
def rg_12(g: Graph) -> DataFrame:
    return g.commitment.filter("status = 'pending'").orderBy(asc("due"), asc("id")).limit(50).select("id", "approval", "product", "kind", day("due"))


@query(
    "rg_6_approval",
    """SELECT a.id, a.status, s.kind, s.agency, c.name AS product, coalesce(p.n, 0) AS commitments, coalesce(m.n, 0) AS makers FROM approval a LEFT JOIN submission s ON s.id = a.submission LEFT JOIN compound c ON c.id = a.product
    LEFT JOIN (SELECT approval, count(*) AS n FROM commitment GROUP BY approval) p ON p.approval = a.id LEFT JOIN (SELECT product, count(*) AS n FROM product GROUP BY product) m ON m.product = a.product""",
)
def rg_6(g: Graph) -> DataFrame:
    """Every approval with what is optional around it, each branch summed before it is joined."""
    s = g.submission.select(F.col("id").alias("submission"), F.col("kind").alias("sub_kind"), "agency")
    c = g.compound.select(F.col("id").alias("product"), "name")
    p = g.commitment.groupBy(F.col("approval").alias("id")).agg(F.count("*").alias("commitments"))
    m = g.product.groupBy("product").agg(F.count("*").alias("makers"))
    rows = g.approval.select("id", "status", "submission", "product").join(s, "submission", "left").join(c, "product", "left").join(p, "id", "left").join(m, "product", "left")
    return rows.fillna(0, ["commitments", "makers"]).select("id", "status", F.col("sub_kind").alias("kind"), "agency", F.col("name").alias("product"), "commitments", "makers")


def _branches(views: list[str]) -> str:
    return " ".join(f"LEFT JOIN (SELECT manufacturer, count(*) AS n FROM {v} GROUP BY manufacturer) t{i} ON t{i}.manufacturer = m.id" for i, v in enumerate(views))


_DETAIL = ["product", "shortage", "inspection", "action"]


@query("api_13_manufacturer_detail", f"SELECT m.id, m.name, m.country, {', '.join(f'coalesce(t{i}.n, 0) AS {v}s' for i, v in enumerate(_DETAIL))} FROM manufacturer m {_branches(_DETAIL)}")
def api_13(g: Graph) -> DataFrame:
    """Every maker with the counts of its products, shortages, inspections and actions."""
    out = g.manufacturer.select("id", "name", "country")
    for v in _DETAIL:
        out = out.join(getattr(g, v).groupBy(F.col("manufacturer").alias("id")).agg(F.count("*").alias(f"{v}s")), "id", "left")
    return out.fillna(0, [f"{v}s" for v in _DETAIL])


@query("api_16_supply_statistics", "SELECT impact, status, count(*) AS shortages, count(DISTINCT product) AS products, count(DISTINCT manufacturer) AS makers FROM shortage GROUP BY impact, status")
def api_16(g: Graph) -> DataFrame:
    return g.shortage.groupBy("impact", "status").agg(F.count("*").alias("shortages"), F.count_distinct("product").alias("products"), F.count_distinct("manufacturer").alias("makers"))


@query("api_17_regulatory_statistics", "SELECT agency, kind, state, GROUPING(agency) + 2 * GROUPING(kind) + 4 * GROUPING(state) AS level, count(*) AS n FROM submission GROUP BY GROUPING SETS ((agency), (kind), (state), ())")
def api_17(g: Graph) -> DataFrame:
    """Submissions by agency, by kind, by state and in all, in one pass; level tells which columns are summed over."""
    sets = [[F.col("agency")], [F.col("kind")], [F.col("state")], []]
    level = (F.grouping("agency") + 2 * F.grouping("kind") + 4 * F.grouping("state")).cast("long").alias("level")
    return g.submission.groupingSets(sets, "agency", "kind", "state").agg(level, F.count("*").alias("n"))


@query("api_22_document", "SELECT 'document' AS kind, doc_id AS key, lang AS about, text AS body FROM documents WHERE doc_id = 12 UNION ALL SELECT 'page', page_id, url, html FROM pages WHERE page_id = 12")
def api_22(g: Graph) -> DataFrame:
    """A document of either kind by its id; the id reaches both scans."""
    d = g.documents.filter("doc_id = 12").select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), F.col("lang").alias("about"), F.col("text").alias("body"))
    return d.unionByName(g.pages.filter("page_id = 12").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), F.col("url").alias("about"), F.col("html").alias("body")))


#: name: (view, what the rows are counted by).
GROUPS = {
    "sc_q8_2_actions_by_kind": ("action", ["kind", "active"]),
    "sc_q8_4_actions_by_maker": ("action", ["manufacturer"]),
    "sc_q9_2_commitments_by_kind": ("commitment", ["kind"]),
    "sc_q9_3_commitments_by_status": ("commitment", ["status"]),
    "sc_q9_5_commitments_of_product": ("commitment", ["product", "status"]),
}

#: name: (view, condition, what is returned): all rows that fit.
ROWS = {
    "sc_q8_5_serious_actions": ("action", "kind IN ('recall', 'suspension') AND active", ["id", "manufacturer", "product", "amount"]),
    "sc_q9_4_overdue": ("commitment", f"status <> 'fulfilled' AND due < TIMESTAMP '{AS_OF}'", ["id", "approval", "status"]),
    "sc_q13_5_without_description": ("commitment", "description IS NULL", ["id", "kind"]),
    "rd_q3_3_assay_details": ("acts_on", "target = 'S:3'", ["compound", "target", "rel", "ic50", "pchembl", "n"]),
    "rd_q12_1_stage_edges": ("compound", "stage IS NOT NULL", ["id", "stage"]),
    "rd_q12_2_target_type_edges": ("target", "target_type IS NOT NULL", ["id", "target_type"]),
}


def _group(name: str, view: str, keys: list[str]) -> None:
    @query(name, f"SELECT {', '.join(keys)}, count(*) AS n FROM {view} GROUP BY {', '.join(keys)}")
    def run(g: Graph) -> DataFrame:
        return getattr(g, view).groupBy(*keys).agg(F.count("*").alias("n"))


def _rows(name: str, view: str, where: str, columns: list[str]) -> None:
    @query(name, f"SELECT {', '.join(columns)} FROM {view} WHERE {where}")
    def run(g: Graph) -> DataFrame:
        return getattr(g, view).filter(where).select(*columns)


for _name, (_view, _keys) in GROUPS.items():
    _group(_name, _view, _keys)
for _name, (_view, _where, _columns) in ROWS.items():
    _rows(_name, _view, _where, _columns)


@query("sc_q15_3_actions_by_year", "SELECT CAST(year(issued) AS INT) AS year, kind, count(*) AS n FROM action GROUP BY 1, 2")
def actions_by_year(g: Graph) -> DataFrame:
    return g.action.groupBy(F.year("issued").alias("year"), "kind").agg(F.count("*").alias("n"))


@query("rd_q6_1_same_series", "SELECT family, count(*) AS compounds, round(avg(weight), 2) AS mean_weight, min(id) AS first_id FROM compound GROUP BY family HAVING count(*) > 1")
def same_series(g: Graph) -> DataFrame:
    """Series of compounds with what they have in common, instead of all pairs within them."""
    return g.compound.groupBy("family").agg(F.count("*").alias("compounds"), F.round(F.avg("weight"), 2).alias("mean_weight"), F.min("id").alias("first_id")).filter("compounds > 1")
