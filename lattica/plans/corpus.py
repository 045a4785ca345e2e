"""The query corpus by pattern: distributions, filtered lists, missing values, groups over a threshold, and joins.

Patterns that differ only in what they read are rows of tables; each row is one registered query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.cypher import asc, cases, day, desc, rate
from lattica.plans.binding import Graph
from lattica.plans.registry import query

#: name: (view, key) - how many rows have each value.
DISTRIBUTIONS = {
    "rd_q10_1_target_types": ("target", "target_type"),
    "rd_q10_2_stages": ("compound", "stage"),
    "rd_q10_3_assay_types": ("acts_on", "rel"),
    "rd_q10_4_pathway_types": ("pathway_target", "rel"),
    "cl_q1_2_phases": ("trial", "phase"),
    "cl_q1_3_statuses": ("trial", "status"),
    "cl_q7_2_severities": ("adverse_event", "severity"),
    "cl_q8_2_site_countries": ("site", "country"),
    "cl_q10_2_trials_by_sponsor": ("trial", "sponsor_key"),
    "cl_trials_by_start_year": ("trial", "start_year"),
    "sc_q1_3_manufacturer_countries": ("manufacturer", "country"),
    "sc_q2_2_shortage_reasons": ("shortage", "reason"),
    "sc_shortage_impacts": ("shortage", "impact"),
    "cl_q1_4_study_types": ("trial", "study_type"),
    "sc_q4_5_review_priorities": ("submission", "review_priority"),
    "sc_q5_2_approval_kinds": ("approval", "kind"),
    "sc_q7_2_inspection_kinds": ("inspection", "kind"),
    "sc_q12_agencies": ("submission", "agency"),
    "sc_q2_4_shortages_by_maker": ("shortage", "manufacturer"),
    "sc_q4_2_submission_kinds": ("submission", "kind"),
    "sc_q4_3_submission_states": ("submission", "state"),
    "sc_q5_3_approval_statuses": ("approval", "status"),
    "sc_q7_3_inspection_results": ("inspection", "result"),
    "sc_inspections_by_agency": ("inspection", "agency"),
    "sc_q10_3_signal_statuses": ("signal", "status"),
    "sc_q10_5_signals_by_drug": ("signal", "compound"),
    "documents_by_language": ("document", "lang"),
    "sc_q1_2_maker_kinds": ("maker", "kind"),
    "sc_q3_3_supplier_kinds": ("maker", "supplies"),
    "cl_q10_3_sponsor_kinds": ("sponsor", "kind"),
    "sc_q10_2_signal_kinds": ("alert", "kind"),
    "rd_q8_1_targets_by_compounds": ("acts_on", "target"),
}

#: name: view - how many rows there are.
COUNTS = {
    "rd_q1_2_count_targets": "target",
    "sc_q7_1_count_inspections": "inspection",
    "sc_q8_1_count_actions": "action",
    "sc_q9_1_count_commitments": "commitment",
    "sc_q10_1_count_signals": "signal",
}

#: name: (view, condition, columns, order, limit or None) - rows that fit, in a total order.
LISTS = {
    "rd_q1_3_compounds_at_stage": ("compound", "stage = 'phase_3'", ["id", "name"], ["name", "id"], 1000),
    "rd_q1_4_targets_of_type": ("target", "target_type = 'enzyme'", ["id", "name"], ["name", "id"], 1000),
    "rd_q3_1_activity_range": ("acts_on", "ic50 >= 2000 AND ic50 <= 3000", ["compound", "target", "rel", "ic50"], ["ic50", "compound", "target", "rel"], 100),
    "rd_q3_2_potent": ("acts_on", "rel = 'INHIBITS' AND ic50 < 1500", ["compound", "target", "ic50"], ["ic50", "compound", "target"], 1000),
    "rd_repeated_assays": ("acts_on", "n >= 3", ["compound", "target", "rel", "n"], ["compound", "target", "rel"], 1000),
    "rd_q5_2_diseases_of_target": ("associated", "target = 'S:2'", ["disease", "evidence_level"], ["disease"], 1000),
    "cl_q2_3_recruiting": ("trial", "status = 'Recruiting'", ["id", "phase", "enrollment"], ["enrollment", "id"], 100),
    "cl_q7_3_serious": ("adverse_event", "serious", ["key", "trial", "term"], ["key"], 500),
    "cl_q8_3_sites_in_country": ("site", "country = 'NATION_3'", ["trial", "region"], ["trial"], 1000),
    "sc_q2_1_active_shortages": ("shortage", "status = 'active'", ["id", "product", "impact"], ["id"], 1000),
    "sc_q2_3_critical_shortages": ("shortage", "impact = 'critical'", ["id", "product"], ["id"], 1000),
    "sc_q4_4_under_review": ("submission", "state = 'P'", ["id", "kind", "agency"], ["id"], 200),
    "sc_q4_6_priority": ("submission", "kind IN ('NDA', 'BLA') AND agency = 'A:1'", ["id", "kind"], ["id"], 200),
    "sc_q5_4_active_approvals": ("approval", "status = 'approved'", ["id", "product"], ["id"], 200),
    "sc_q7_4_failed_inspections": ("inspection", "result = 'FAILED'", ["id", "manufacturer"], ["id"], 500),
    "sc_confirmed_signals": ("signal", "status = 'confirmed'", ["id", "compound"], ["id"], 500),
    "sc_q10_4_signals_under_review": ("signal", "status = 'under_review'", ["id", "compound", "disease"], ["id"], 500),
    "cl_q2_2_trials_of_phase": ("trial", "phase = 'Phase 2'", ["id", "status", "enrollment"], ["id"], 500),
    "cl_q2_4_recent_trials": ("trial", "start_date >= TIMESTAMP '2001-07-02'", ["id", "phase", "status"], ["id"], 500),
    "cl_q13_2_trials_missing_dates": ("trial", "completed_on IS NULL", ["id", "status"], ["id"], 500),
    "cl_q7_4_events_by_term": ("adverse_event", "term = 'error'", ["key", "trial", "severity"], ["key"], 500),
    "sc_q5_5_approvals_expiring": ("approval", "expires_on >= TIMESTAMP '2001-08-01' AND expires_on <= TIMESTAMP '2002-01-28'", ["id", "product"], ["id"], 500),
    "sc_q5_6_accelerated": ("approval", "kind = 'accelerated'", ["id", "product"], ["id"], 500),
    "sc_q7_5_for_cause": ("inspection", "kind = 'for_cause'", ["id", "manufacturer", "result"], ["id"], 500),
    "sc_q13_4_active_without_expiry": ("approval", "status = 'approved' AND expires_on IS NULL", ["id", "product"], ["id"], 500),
    "rd_missing_evidence_level": ("associated", "evidence_level IS NULL", ["target", "disease"], ["target", "disease"], 200),
    "sc_open_shortages": ("shortage", "end_date IS NULL", ["id", "product"], ["id"], 200),
    "rd_q13_2_batch_lookup": ("compound", "id IN ('P:1', 'P:5', 'P:9', 'P:77', 'P:none')", ["id", "name", "stage"], ["id"], 100),
    "rd_q3_4_good_assays": ("assay", "z_factor > 0.5", ["compound", "target", "rel"], ["compound", "target"], None),
    "rd_q7_1_protein_network": ("interaction", "score >= 4", ["protein_a", "protein_b", "score"], ["score", "protein_a", "protein_b"], None),
    "rd_q9_1_missing_smiles": ("structure", "smiles IS NULL", ["id", "name"], ["id"], 100),
    "rd_q9_3_missing_uniprot": ("protein", "uniprot IS NULL", ["id", "name"], ["id"], 100),
    "rd_q9_4_edges_without_activity": ("assay", "activity IS NULL", ["compound", "target", "rel"], ["compound", "target"], 100),
    "cl_q6_2_outcomes_of_kind": ("outcome", "kind = 'secondary'", ["id", "trial", "measure"], ["id", "trial", "measure"], 100),
    "cl_q12_3_same_endpoint": ("outcome", "kind = 'primary' AND measure LIKE '%survival%'", ["trial", "id", "measure"], ["trial", "id"], None),
    "cl_q13_1_missing_enrollment": ("protocol", "planned IS NULL", ["id", "allocation"], ["id"], 100),
    "sc_q1_4_integrated_makers": ("maker", "kind = 'integrated'", ["id", "name"], ["name", "id"], None),
    "sc_q1_5_contract_makers": ("maker", "kind = 'contract'", ["id", "name"], ["name", "id"], None),
    "sc_q3_1_ingredient_suppliers": ("maker", "supplies = 'ingredient'", ["id", "name"], ["name", "id"], None),
    "sc_q3_2_excipient_suppliers": ("maker", "supplies = 'excipient'", ["id", "name"], ["name", "id"], None),
    "sc_q8_3_active_actions": ("action", "active", ["id", "manufacturer", "kind", "issued"], ["issued", "id"], None),
    "sc_q13_1_makers_without_fei": ("maker", "fei IS NULL", ["id", "name"], ["id"], 100),
    "sc_q13_2_inspections_without_result": ("visit", "result IS NULL", ["id", "manufacturer"], ["id"], 100),
    "sc_q13_3_approvals_without_date": ("authorisation", "granted AND granted_on IS NULL", ["id", "agency"], ["id"], 100),
}

#: name: (view, key, counted, least) - keys with at least so many different values.
GROUPS = {
    "rd_q2_3_multi_target": ("acts_on", "compound", "target", 25),
    "rd_q2_4_few_targets": ("pathway_target", "target", "pathway", 2),
    "rd_q7_2_hubs": ("acts_on", "target", "compound", 100),
    "cl_q5_3_drug_usage": ("trial_compound", "compound", "trial", 20),
    "cl_subjects_terms": ("adverse_event", "subject", "term", 2),
    "rd_compounds_by_diseases": ("treats", "compound", "disease", 15),
    "sc_q11_4_products_per_maker": ("product", "manufacturer", "product", 50),
    "cl_q6_3_outcome_usage": ("outcome", "id", "trial", 3),
    "cl_q9_3_investigators_by_institution": ("investigator", "institution", "id", 1),
}

#: name: (view, key, value, digits) - count, mean, least and greatest of a value by key.
SUMMARIES = {
    "cl_enrollment_by_phase": ("trial", "phase", "enrollment", 2),
    "cl_enrollment_by_status": ("trial", "status", "enrollment", 2),
    "sc_ratings_by_region": ("manufacturer", "region", "rating", 2),
    "rd_strength_by_type": ("acts_on", "rel", "strength", 4),
    "rd_weight_by_class": ("compound", "class", "weight", 2),
}


def _distribution(name: str, view: str, key: str) -> None:
    @query(name, f"SELECT CAST({key} AS VARCHAR) AS value, count(*) AS n FROM {view} GROUP BY {key}")
    def run(g: Graph) -> DataFrame:
        return getattr(g, view).groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n"))


def _list(name: str, view: str, where: str, columns: list[str], order: list[str], limit: int | None) -> None:
    @query(name, f"SELECT {', '.join(columns)} FROM {view} WHERE {where} ORDER BY {', '.join(order)}" + (f" LIMIT {limit}" if limit else ""))
    def run(g: Graph) -> DataFrame:
        rows = getattr(g, view).filter(where).select(*columns).orderBy(*[asc(o) for o in order])
        return rows.limit(limit) if limit else rows


def _count(name: str, view: str) -> None:
    @query(name, f"SELECT count(*) AS n FROM {view}")
    def run(g: Graph) -> DataFrame:
        return getattr(g, view).agg(F.count("*").alias("n"))


def _group(name: str, view: str, key: str, counted: str, least: int) -> None:
    @query(name, f"SELECT {key}, count(DISTINCT {counted}) AS n FROM {view} GROUP BY {key} HAVING count(DISTINCT {counted}) >= {least} ORDER BY n DESC, {key} LIMIT 200")
    def run(g: Graph) -> DataFrame:
        return getattr(g, view).groupBy(key).agg(F.count_distinct(counted).alias("n")).filter(F.col("n") >= least).orderBy(desc("n"), asc(key)).limit(200)


def _summary(name: str, view: str, key: str, value: str, digits: int) -> None:
    @query(name, f"SELECT {key}, count(*) AS n, round(avg({value}), {digits}) AS mean, min({value}) AS least, max({value}) AS greatest FROM {view} GROUP BY {key}")
    def run(g: Graph) -> DataFrame:
        return getattr(g, view).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))


for _name, _spec in DISTRIBUTIONS.items():
    _distribution(_name, *_spec)
for _name, _view in COUNTS.items():
    _count(_name, _view)
for _name, _spec in LISTS.items():
    _list(_name, *_spec)
for _name, _spec in GROUPS.items():
    _group(_name, *_spec)
for _name, _spec in SUMMARIES.items():
    _summary(_name, *_spec)


@query("rd_q4_4_crosstalk", "SELECT a.pathway AS left_pathway, b.pathway AS right_pathway, count(DISTINCT a.target) AS shared FROM pathway_target a JOIN pathway_target b ON b.target = a.target AND a.pathway < b.pathway GROUP BY ALL")
def crosstalk(g: Graph) -> DataFrame:
    """Pairs of pathways by the targets they share."""
    a = g.pathway_target.select("target", F.col("pathway").alias("left_pathway")).distinct()
    b = a.select("target", F.col("left_pathway").alias("right_pathway"))
    return a.join(b, "target").filter("left_pathway < right_pathway").groupBy("left_pathway", "right_pathway").agg(F.count("*").alias("shared"))


@query("rd_q5_3_approved_for_disease", "SELECT t.disease, c.id, c.name FROM treats t JOIN compound c ON c.id = t.compound WHERE c.approved AND t.disease = 'D:11'")
def approved_for(g: Graph) -> DataFrame:
    own = g.at("treats", "disease", "D:11").select("disease", F.col("compound").alias("id"))
    return g.compound.filter("approved").join(own, "id").select("disease", "id", "name")


@query("rd_q6_2_same_scaffold", "SELECT inchikey, count(*) AS compounds, min(id) AS first_id, max(id) AS last_id FROM compound GROUP BY inchikey HAVING count(*) > 1")
def scaffolds(g: Graph) -> DataFrame:
    """Compounds of equal structure."""
    return g.compound.groupBy("inchikey").agg(F.count("*").alias("compounds"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("compounds > 1")


@query(
    "rd_q11_1_four_steps",
    "SELECT DISTINCT a.compound, p.pathway, d.disease FROM acts_on a JOIN pathway_target p ON p.target = a.target JOIN associated d ON d.target = a.target WHERE a.compound = 'P:12' AND d.evidence_level = 'A' AND p.rel = 'UPREGULATES'",
)
def four_steps(g: Graph) -> DataFrame:
    a = g.at("acts_on", "compound", "P:12").select("compound", "target").distinct()
    p = g.pathway_target.filter("rel = 'UPREGULATES'").join(a, "target").select("compound", "target", "pathway")
    return p.join(g.associated.filter("evidence_level = 'A'"), "target").select("compound", "pathway", "disease").distinct()


@query("rd_q11_2_coverage", "SELECT t.target_type, count(DISTINCT t.id) AS targets, count(DISTINCT a.target) AS covered FROM target t LEFT JOIN (SELECT DISTINCT target FROM acts_on WHERE strength >= 48) a ON a.target = t.id GROUP BY t.target_type")
def coverage(g: Graph) -> DataFrame:
    """Targets of each type, and how many have a strong compound."""
    hit = g.acts_on.filter("strength >= 48").select(F.col("target").alias("id"), F.lit(1).alias("one")).distinct()
    return g.target.join(hit, "id", "left").groupBy("target_type").agg(F.count("*").alias("targets"), F.count("one").alias("covered"))


@query("cl_q13_3_trials_without_items", "SELECT t.id FROM trial t WHERE NOT EXISTS (SELECT 1 FROM trial_compound c WHERE c.trial = t.id)")
def idle_trials(g: Graph) -> DataFrame:
    return g.trial.select("id").join(g.trial_compound.select(F.col("trial").alias("id")), "id", "left_anti")


@query("cl_q14_1_event_rate", "SELECT t.phase, count(DISTINCT t.id) AS trials, count(DISTINCT e.trial) AS with_events, round(count(DISTINCT e.trial) * 100.0 / count(DISTINCT t.id), 2) AS event_rate FROM trial t LEFT JOIN adverse_event e ON e.trial = t.id GROUP BY t.phase")
def event_rate(g: Graph) -> DataFrame:
    """The share of trials with adverse events by phase."""
    e = g.adverse_event.select(F.col("trial").alias("id"), F.lit(1).alias("one")).distinct()
    n = g.trial.join(e, "id", "left").groupBy("phase").agg(F.count("*").alias("trials"), F.count("one").alias("with_events"))
    return n.withColumn("event_rate", rate(F.col("with_events"), F.col("trials")))


@query("cl_q15_1_starts_by_month", "SELECT start_year AS year, CAST(month(start_date) AS INT) AS month, count(*) AS n FROM trial GROUP BY ALL")
def starts_by_month(g: Graph) -> DataFrame:
    return g.trial.groupBy(F.col("start_year").alias("year"), F.month("start_date").alias("month")).agg(F.count("*").alias("n"))


@query("cl_q16_1_panorama", "SELECT t.disease, count(DISTINCT t.id) AS trials, count(DISTINCT c.compound) AS compounds FROM trial t JOIN trial_compound c ON c.trial = t.id GROUP BY t.disease ORDER BY compounds DESC, disease LIMIT 100")
def panorama(g: Graph) -> DataFrame:
    t = g.trial.select(F.col("id").alias("trial"), "disease")
    return g.trial_compound.join(t, "trial").groupBy("disease").agg(F.count_distinct("trial").alias("trials"), F.count_distinct("compound").alias("compounds")).orderBy(desc("compounds"), asc("disease")).limit(100)


@query("sc_q2_5_resolved_duration", "SELECT impact, count(*) AS n, round(avg(date_diff('day', start_date, end_date)), 2)::DOUBLE AS days FROM shortage WHERE end_date IS NOT NULL GROUP BY impact")
def durations(g: Graph) -> DataFrame:
    return g.shortage.filter("end_date IS NOT NULL").groupBy("impact").agg(F.count("*").alias("n"), F.round(F.avg(F.datediff("end_date", "start_date")), 2).alias("days"))


def _reviews(g: Graph) -> DataFrame:
    """Submissions with their approval's day count."""
    a = g.approval.select(F.col("submission").alias("id"), "approved_on")
    return g.submission.join(a, "id").withColumn("days", F.datediff("approved_on", "submitted"))


_REVIEWS = "(SELECT s.*, date_diff('day', s.submitted, a.approved_on) AS days FROM submission s JOIN approval a ON a.submission = s.id)"


@query("sc_q6_3_review_buckets", f"SELECT kind, CASE WHEN days < 180 THEN 'fast' WHEN days < 365 THEN 'standard' ELSE 'slow' END AS bucket, count(*) AS n FROM {_REVIEWS} GROUP BY ALL")
def review_buckets(g: Graph) -> DataFrame:
    """Reviews of each submission type by the days they took."""
    days = F.col("days")
    return _reviews(g).groupBy("kind", cases([(days < 180, "fast"), (days < 365, "standard")], "slow").alias("bucket")).agg(F.count("*").alias("n"))


@query("sc_q6_1_review_time", f"SELECT count(*) AS n, round(avg(days), 2)::DOUBLE AS days, min(days) AS least, max(days) AS greatest FROM {_REVIEWS}")
def review_time(g: Graph) -> DataFrame:
    return _reviews(g).agg(F.count("*").alias("n"), F.round(F.avg("days"), 2).alias("days"), F.min("days").cast("long").alias("least"), F.max("days").cast("long").alias("greatest"))


@query("sc_q12_1_review_efficiency", f"SELECT kind, review_priority, count(*) AS n, round(avg(days), 2)::DOUBLE AS days FROM {_REVIEWS} GROUP BY ALL")
def review_efficiency(g: Graph) -> DataFrame:
    """Mean review time by submission type and priority."""
    return _reviews(g).groupBy("kind", "review_priority").agg(F.count("*").alias("n"), F.round(F.avg("days"), 2).alias("days"))


def _by_year(name: str, view: str, day_column: str) -> None:
    @query(name, f"SELECT CAST(year({day_column}) AS INT) AS year, count(*) AS n FROM {view} WHERE {day_column} IS NOT NULL GROUP BY ALL")
    def run(g: Graph) -> DataFrame:
        return getattr(g, view).filter(f"{day_column} IS NOT NULL").groupBy(F.year(day_column).alias("year")).agg(F.count("*").alias("n"))


for _name, _spec in {"cl_q15_2_completions_by_year": ("trial", "completed_on"), "sc_q6_2_approvals_by_year": ("approval", "approved_on"), "sc_q15_2_shortages_by_year": ("shortage", "start_date")}.items():
    _by_year(_name, *_spec)


@query("sc_q15_1_submissions_by_month", "SELECT submitted_year AS year, CAST(month(submitted) AS INT) AS month, count(*) AS n FROM submission GROUP BY ALL")
def submissions_by_month(g: Graph) -> DataFrame:
    return g.submission.groupBy(F.col("submitted_year").alias("year"), F.month("submitted").alias("month")).agg(F.count("*").alias("n"))


@query("cl_q11_2_duration_by_phase", "SELECT phase, count(*) AS n, round(avg(date_diff('day', start_date, completed_on)), 2)::DOUBLE AS days FROM trial WHERE completed_on IS NOT NULL GROUP BY phase")
def duration_by_phase(g: Graph) -> DataFrame:
    return g.trial.filter("completed_on IS NOT NULL").groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg(F.datediff("completed_on", "start_date")), 2).alias("days"))


@query("cl_q11_1_completion_status", "SELECT phase, status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY phase), 2)::DOUBLE AS share FROM trial GROUP BY phase, status")
def completion_status(g: Graph) -> DataFrame:
    """How the trials of each phase stand; the window runs over a few counts, not over trials."""
    n = g.trial.groupBy("phase", "status").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("phase")), 2))


@query("cl_q14_2_serious_rate", "SELECT t.phase, count(e.key) AS events, count(CASE WHEN e.serious THEN 1 END) AS serious, round(count(CASE WHEN e.serious THEN 1 END) * 100.0 / count(e.key), 2)::DOUBLE AS serious_rate FROM trial t JOIN adverse_event e ON e.trial = t.id GROUP BY t.phase")
def serious_rate(g: Graph) -> DataFrame:
    """The share of serious events by phase."""
    e = g.adverse_event.groupBy(F.col("trial").alias("id")).agg(F.count("*").alias("events"), F.count_if("serious").alias("serious"))
    n = g.trial.select("id", "phase").join(e, "id").groupBy("phase").agg(F.sum("events").alias("events"), F.sum("serious").alias("serious"))
    return n.withColumn("serious_rate", rate(F.col("serious"), F.col("events")))


@query("cl_q12_2_same_intervention", "SELECT DISTINCT b.trial FROM trial_compound a JOIN trial_compound b ON b.compound = a.compound AND b.trial <> a.trial WHERE a.trial = 'T:1'")
def same_intervention(g: Graph) -> DataFrame:
    """Trials that test a compound of a given trial."""
    own = g.at("trial_compound", "trial", "T:1").select("compound")
    return g.trial_compound.filter("trial <> 'T:1'").join(own, "compound", "left_semi").select("trial").distinct()


@query("rd_q4_2_pathways_of_target", "SELECT pathway, rel FROM pathway_target WHERE target = 'S:3'")
def pathways_of_target(g: Graph) -> DataFrame:
    return g.at("pathway_target", "target", "S:3").select("pathway", "rel")


@query("rd_q4_3_pathway_diseases", "SELECT p.pathway, count(DISTINCT a.disease) AS diseases FROM pathway_target p JOIN associated a ON a.target = p.target GROUP BY p.pathway")
def pathway_diseases(g: Graph) -> DataFrame:
    p = g.pathway_target.select("pathway", "target").distinct()
    return g.associated.select("target", "disease").join(p, "target").groupBy("pathway").agg(F.count_distinct("disease").alias("diseases"))


@query(
    "sc_q11_3_overlapping_actions",
    "SELECT s.id AS shortage, count(*) AS inspections FROM shortage s JOIN inspection i ON i.manufacturer = s.manufacturer AND i.inspected >= s.start_date AND (s.end_date IS NULL OR i.inspected <= s.end_date) GROUP BY s.id",
)
def overlapping(g: Graph) -> DataFrame:
    """Inspections of a maker while a shortage of its own lasts, open ends included: those up to its end less those before its start.

    No pairs are listed: times of one maker and day are numbered together, and days are summed before that, so that a maker of very
    many doesn't land in one task.
    """
    s = g.shortage.select("manufacturer", F.col("id").alias("shortage"), "start_date", "end_date").filter("manufacturer is not null and start_date is not null and (end_date is null or end_date >= start_date)")
    i = g.inspection.select("manufacturer", F.col("inspected").alias("at")).filter("manufacturer is not null and at is not null")
    # at the same time a start comes before inspections and an end after them; what has no end comes last
    none = F.lit(None).cast("string")
    start = s.select("manufacturer", F.col("start_date").alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("sign"), "shortage")
    end = s.select("manufacturer", F.col("end_date").alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("sign"), "shortage")
    rows = i.select("manufacturer", "at", F.lit(1).alias("turn"), F.lit(0).alias("sign"), none.alias("shortage")).unionByName(start).unionByName(end).withColumn("day", F.to_date("at"))
    found = F.count_if(F.col("turn") == 1)
    days = rows.groupBy("manufacturer", "day").agg(found.alias("n"))
    earlier = days.select("manufacturer", "day", (F.sum("n").over(Window.partitionBy("manufacturer").orderBy(F.asc_nulls_last("day"))) - F.col("n")).alias("earlier"))
    upto = found.over(Window.partitionBy("manufacturer", "day").orderBy("at", "turn"))
    marks = rows.withColumn("n", upto).filter("shortage is not null").alias("a").join(earlier.alias("b"), F.expr("a.manufacturer = b.manufacturer and a.day <=> b.day"))
    return marks.groupBy("shortage").agg(F.sum((F.col("n") + F.col("earlier")) * F.col("sign")).alias("inspections")).filter("inspections > 0")


@query(
    "sc_q12_2_compliance_score",
    "SELECT m.id, coalesce(i.total, 0) AS inspections, coalesce(i.failed, 0) AS failed, CASE WHEN i.total IS NULL THEN 'unknown' WHEN i.failed * 1.0 / i.total < 0.2 THEN 'good' WHEN i.failed * 1.0 / i.total < 0.4 THEN 'fair' ELSE 'poor' END AS standing FROM manufacturer m LEFT JOIN (SELECT manufacturer, count(*) AS total, count(CASE WHEN result = 'FAILED' THEN 1 END) AS failed FROM inspection GROUP BY manufacturer) i ON i.manufacturer = m.id",
)
def compliance(g: Graph) -> DataFrame:
    n = g.inspection.groupBy(F.col("manufacturer").alias("id")).agg(F.count("*").alias("inspections"), F.count_if(F.col("result") == "FAILED").alias("failed"))
    share = F.col("failed") / F.col("inspections")
    standing = cases([(F.col("inspections").isNull(), "unknown"), (share < 0.2, "good"), (share < 0.4, "fair")], "poor")
    return g.manufacturer.select("id").join(n, "id", "left").withColumn("standing", standing).fillna(0)


@query(
    "sc_q12_3_chain_risk",
    "SELECT m.id, count(DISTINCT p.product) AS products, count(DISTINCT s.id) AS shortages, CASE WHEN count(DISTINCT s.id) > 40 THEN 'high' WHEN count(DISTINCT s.id) > 20 THEN 'medium' ELSE 'low' END AS risk FROM manufacturer m LEFT JOIN product p ON p.manufacturer = m.id LEFT JOIN shortage s ON s.manufacturer = m.id GROUP BY m.id",
)
def chain_risk(g: Graph) -> DataFrame:
    p = g.product.groupBy(F.col("manufacturer").alias("id")).agg(F.count("product").alias("products"))
    s = g.shortage.groupBy(F.col("manufacturer").alias("id")).agg(F.count("*").alias("shortages"))
    out = g.manufacturer.select("id").join(p, "id", "left").join(s, "id", "left").fillna(0)
    return out.withColumn("risk", cases([(F.col("shortages") > 40, "high"), (F.col("shortages") > 20, "medium")], "low"))


@query("sc_q12_4_timeline", "SELECT s.id, strftime(a.approved_on, '%Y-%m-%d') AS day, date_diff('day', s.submitted, a.approved_on) AS days FROM submission s JOIN approval a ON a.submission = s.id ORDER BY a.approved_on DESC, s.id LIMIT 100")
def timeline(g: Graph) -> DataFrame:
    a = g.approval.select(F.col("submission").alias("id"), "approved_on")
    rows = g.submission.join(a, "id").orderBy(desc("approved_on"), asc("id")).limit(100)
    return rows.select("id", day("approved_on"), F.datediff("approved_on", "submitted").cast("long").alias("days"))


@query(
    "sc_q14_1_report",
    "SELECT 'manufacturers' AS metric, count(*) AS total, count(DISTINCT country) AS secondary FROM manufacturer UNION ALL SELECT 'shortages', count(*), count(CASE WHEN status = 'active' THEN 1 END) FROM shortage UNION ALL SELECT 'inspections', count(*), count(CASE WHEN result = 'FAILED' THEN 1 END) FROM inspection",
)
def report(g: Graph) -> DataFrame:
    """One row a metric, from branches brought to the same columns."""
    m = g.manufacturer.agg(F.lit("manufacturers").alias("metric"), F.count("*").alias("total"), F.count_distinct("country").alias("secondary"))
    s = g.shortage.agg(F.lit("shortages").alias("metric"), F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("secondary"))
    i = g.inspection.agg(F.lit("inspections").alias("metric"), F.count("*").alias("total"), F.count_if(F.col("result") == "FAILED").alias("secondary"))
    return m.unionByName(s).unionByName(i)
