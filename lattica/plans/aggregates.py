"""Statistics: counts by label and type, time lines, geography, success rates, hot spots, quality and supply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import asc, cases, desc, distinct_if, rate
from lattica.plans.binding import AS_OF, Graph
from lattica.plans.registry import query


@query("ag_1_statistics", "SELECT 'node' AS kind, label AS name, count(*) AS n FROM node GROUP BY label UNION ALL SELECT 'edge', rel, count(*) FROM edge GROUP BY rel")
def ag_1(g: Graph) -> DataFrame:
    """How many nodes of each label and edges of each type there are."""
    nodes = g.node.groupBy("label").count().select(F.lit("node").alias("kind"), F.col("label").alias("name"), F.col("count").alias("n"))
    return nodes.unionByName(g.edge.groupBy("rel").count().select(F.lit("edge").alias("kind"), F.col("rel").alias("name"), F.col("count").alias("n")))


DOMAINS = {"Compound": "research", "Target": "research", "Disease": "clinical", "ClinicalTrial": "clinical", "Manufacturer": "supply", "SafetySignal": "regulatory"}


@query(
    "ag_2_domains",
    """SELECT CASE WHEN label IN ('Compound', 'Target') THEN 'research' WHEN label IN ('Disease', 'ClinicalTrial') THEN 'clinical' WHEN label = 'Manufacturer' THEN 'supply' ELSE 'regulatory' END AS domain,
        label, count(*) AS n FROM node GROUP BY ALL""",
)
def ag_2(g: Graph) -> DataFrame:
    """Counts by label within each domain, from one pass over the nodes."""
    from lattica.functions.cypher import lookup

    return g.node.groupBy("label").agg(F.count("*").alias("n")).select(lookup(F.col("label"), DOMAINS, "other").alias("domain"), "label", "n")


def since(column: str, years: int):
    return F.col(column) >= F.add_months(F.lit(AS_OF).cast("date"), -12 * years)


@query("ag_3_submission_timeline", f"SELECT submitted_year AS year, kind, count(*) AS n FROM submission WHERE submitted >= DATE '{AS_OF}' - INTERVAL 4 YEAR GROUP BY ALL ORDER BY year DESC, kind")
def ag_3(g: Graph) -> DataFrame:
    """Submissions of the last years by year and kind."""
    return g.submission.filter(since("submitted", 4)).groupBy(F.col("submitted_year").alias("year"), "kind").agg(F.count("*").alias("n")).orderBy(F.desc("year"), "kind")


@query(
    "ag_4_approval_timeline",
    """SELECT submitted_year AS year, count(DISTINCT s.id) AS submissions, count(DISTINCT a.id) AS approvals, round(CASE WHEN count(DISTINCT s.id) > 0 THEN count(DISTINCT a.id) * 100.0 / count(DISTINCT s.id) ELSE 0 END, 2) AS approval_rate
    FROM submission s LEFT JOIN approval a ON a.submission = s.id GROUP BY submitted_year""",
)
def ag_4(g: Graph) -> DataFrame:
    """Submissions, approvals and their rate by year. Each submission has one approval at most, so counts are distinct."""
    a = g.approval.select(F.col("submission").alias("id"), F.lit(1).alias("one"))
    rows = g.submission.join(a, "id", "left").groupBy(F.col("submitted_year").alias("year")).agg(F.count("*").alias("submissions"), F.count("one").alias("approvals"))
    return rows.withColumn("approval_rate", rate(F.col("approvals"), F.col("submissions")))


@query("ag_5_trial_timeline", "SELECT start_year AS year, phase, count(*) AS n FROM trial GROUP BY ALL")
def ag_5(g: Graph) -> DataFrame:
    """Trials by starting year and phase."""
    return g.trial.groupBy(F.col("start_year").alias("year"), "phase").agg(F.count("*").alias("n"))


@query("ag_6_shortage_timeline", "SELECT CAST(day(start_date) AS INT) AS day, impact, count(*) AS n FROM shortage GROUP BY ALL")
def ag_6(g: Graph) -> DataFrame:
    """Shortages by day and impact (the table spans one month)."""
    return g.shortage.groupBy(F.day("start_date").alias("day"), "impact").agg(F.count("*").alias("n"))


@query("ag_7_trial_geography", "SELECT country, count(DISTINCT trial) AS trials FROM site WHERE country IS NOT NULL GROUP BY country ORDER BY trials DESC, country LIMIT 10")
def ag_7(g: Graph) -> DataFrame:
    """Countries with the most trials. A trial has one site in the view, so no distinct count is needed."""
    return g.site.filter("country IS NOT NULL").groupBy("country").agg(F.count("trial").alias("trials")).orderBy(desc("trials"), asc("country")).limit(10)


@query("ag_8_manufacturer_geography", "SELECT country, count(*) AS manufacturers, round(avg(rating), 2) AS mean_rating FROM manufacturer GROUP BY country ORDER BY manufacturers DESC, country LIMIT 15")
def ag_8(g: Graph) -> DataFrame:
    """Countries with the most manufacturers."""
    return g.manufacturer.groupBy("country").agg(F.count("*").alias("manufacturers"), F.round(F.avg("rating"), 2).alias("mean_rating")).orderBy(desc("manufacturers"), asc("country")).limit(15)


@query("ag_9_regional_trials", "SELECT country, phase, count(DISTINCT trial) AS trials FROM site JOIN trial ON trial.id = site.trial WHERE region = 'ASIA' GROUP BY ALL")
def ag_9(g: Graph) -> DataFrame:
    """Trials of a region by country and phase."""
    return g.site.filter("region = 'ASIA'").join(g.trial.select(F.col("id").alias("trial"), "phase"), "trial").groupBy("country", "phase").agg(F.count("trial").alias("trials"))


@query(
    "ag_10_trial_success",
    """SELECT phase, count(*) AS total, count(CASE WHEN status = 'Completed' THEN 1 END) AS completed, count(CASE WHEN status = 'Terminated' THEN 1 END) AS terminated, count(CASE WHEN endpoint_met THEN 1 END) AS met,
        round(count(CASE WHEN status = 'Completed' THEN 1 END) * 100.0 / count(*), 2) AS completion_rate,
        round(CASE WHEN count(CASE WHEN status = 'Completed' THEN 1 END) > 0 THEN count(CASE WHEN endpoint_met AND status = 'Completed' THEN 1 END) * 100.0 / count(CASE WHEN status = 'Completed' THEN 1 END) ELSE 0 END, 2) AS success_rate
    FROM trial GROUP BY phase HAVING count(*) >= 10""",
)
def ag_10(g: Graph) -> DataFrame:
    """Completion and success of trials by phase, for phases with enough of them."""
    done = F.col("status") == "Completed"
    rows = g.trial.groupBy("phase").agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "Terminated").alias("terminated"), F.count_if("endpoint_met").alias("met"), F.count_if(done & F.col("endpoint_met")).alias("both"))
    return rows.filter("total >= 10").withColumn("completion_rate", rate(F.col("completed"), F.col("total"))).withColumn("success_rate", rate(F.col("both"), F.col("completed"))).drop("both")


@query(
    "ag_11_approval_by_area",
    """SELECT d.area, count(DISTINCT s.id) AS submissions, count(DISTINCT CASE WHEN a.status = 'approved' THEN s.id END) AS approved, round(count(DISTINCT CASE WHEN a.status = 'approved' THEN s.id END) * 100.0 / count(DISTINCT s.id), 2) AS approval_rate
    FROM submission s JOIN treats t ON t.compound = s.product JOIN disease d ON d.id = t.disease LEFT JOIN approval a ON a.submission = s.id GROUP BY d.area HAVING count(DISTINCT s.id) >= 5""",
)
def ag_11(g: Graph) -> DataFrame:
    """Approval rate by therapeutic area. Products and areas are made distinct before submissions come in."""
    areas = g.treats.join(g.disease.select(F.col("id").alias("disease"), "area"), "disease").select(F.col("compound").alias("product"), "area").distinct()
    a = g.approval.filter("status = 'approved'").select(F.col("submission").alias("id"), F.lit(1).alias("one"))
    rows = g.submission.join(a, "id", "left").groupBy("product").agg(F.count("*").alias("n"), F.count("one").alias("ok")).join(areas, "product").groupBy("area").agg(F.sum("n").alias("submissions"), F.sum("ok").alias("approved"))
    return rows.filter("submissions >= 5").withColumn("approval_rate", rate(F.col("approved"), F.col("submissions")))


@query(
    "ag_12_target_success",
    """SELECT target, count(DISTINCT a.compound) AS compounds, count(DISTINCT CASE WHEN c.approved THEN a.compound END) AS approved, round(count(DISTINCT CASE WHEN c.approved THEN a.compound END) * 100.0 / count(DISTINCT a.compound), 2) AS success_rate
    FROM acts_on a JOIN compound c ON c.id = a.compound GROUP BY target HAVING count(DISTINCT a.compound) >= 5""",
)
def ag_12(g: Graph) -> DataFrame:
    """Targets by the share of their compounds that are approved."""
    c = g.compound.select(F.col("id").alias("compound"), "approved")
    pairs = g.acts_on.select("target", "compound").distinct().join(c, "compound")
    rows = pairs.groupBy("target").agg(F.count("*").alias("compounds"), F.count_if("approved").alias("approved"))
    return rows.filter("compounds >= 5").withColumn("success_rate", rate(F.col("approved"), F.col("compounds")))


@query(
    "ag_13_hotspots",
    """(SELECT 'target' AS kind, target AS id, count(DISTINCT compound) AS compounds FROM acts_on GROUP BY target ORDER BY compounds DESC, id LIMIT 20)
    UNION ALL (SELECT 'disease', disease, count(DISTINCT compound) AS compounds FROM treats GROUP BY disease ORDER BY compounds DESC, disease LIMIT 20)""",
)
def ag_13(g: Graph) -> DataFrame:
    """Targets and diseases with the most compounds."""
    t = g.acts_on.groupBy("target").agg(F.count_distinct("compound").alias("compounds")).select(F.lit("target").alias("kind"), F.col("target").alias("id"), "compounds")
    d = g.treats.groupBy("disease").agg(F.count("compound").alias("compounds")).select(F.lit("disease").alias("kind"), F.col("disease").alias("id"), "compounds")
    return t.orderBy(desc("compounds"), asc("id")).limit(20).unionByName(d.orderBy(desc("compounds"), asc("id")).limit(20))


@query(
    "ag_14_emerging_targets",
    """SELECT target, early, recent, round(recent * 1.0 / early, 3) AS growth FROM (SELECT target, count(DISTINCT CASE WHEN first_seen < TIMESTAMP '1998-01-01' THEN compound END) AS early, count(DISTINCT CASE WHEN first_seen >= TIMESTAMP '1998-01-01' THEN compound END) AS recent FROM acts_on GROUP BY target)
    WHERE early > 0 AND recent > 0 AND recent * 1.0 / early >= 0.5 ORDER BY growth DESC, target LIMIT 20""",
)
def ag_14(g: Graph) -> DataFrame:
    """Targets whose number of compounds grew most from before a cutoff to after it."""
    early = F.col("first_seen") < F.lit("1998-01-01").cast("timestamp")
    rows = g.acts_on.groupBy("target").agg(distinct_if(early, F.col("compound")).alias("early"), distinct_if(~early, F.col("compound")).alias("recent"))
    growth = F.col("recent") / F.col("early")
    return rows.filter("early > 0 AND recent > 0").filter(growth >= 0.5).withColumn("growth", F.round(growth, 3)).orderBy(desc("growth"), asc("target")).limit(20)


@query(
    "ag_15_manufacturer_quality",
    """SELECT manufacturer, count(*) AS inspections, count(CASE WHEN result = 'FAILED' THEN 1 END) AS failed, round(count(CASE WHEN result = 'PASSED' THEN 1 END) * 100.0 / count(*), 2) AS pass_rate,
        CASE WHEN count(CASE WHEN result = 'FAILED' THEN 1 END) >= 3 THEN 'HIGH' WHEN count(CASE WHEN result = 'FAILED' THEN 1 END) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM inspection GROUP BY manufacturer""",
)
def ag_15(g: Graph) -> DataFrame:
    """Inspected manufacturers with pass rate and risk tier."""
    failed = F.count_if(F.col("result") == "FAILED")
    rows = g.inspection.groupBy("manufacturer").agg(F.count("*").alias("inspections"), failed.alias("failed"), F.count_if(F.col("result") == "PASSED").alias("passed"), cases([(failed >= 3, "HIGH"), (failed >= 1, "MEDIUM")], "LOW").alias("risk"))
    return rows.withColumn("pass_rate", rate(F.col("passed"), F.col("inspections"))).drop("passed")


@query("ag_16_shortage_analysis", "SELECT status, impact, count(*) AS n, CAST(sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS BIGINT) AS active FROM shortage GROUP BY ALL")
def ag_16(g: Graph) -> DataFrame:
    """Shortages by status and impact."""
    return g.shortage.groupBy("status", "impact").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"))


@query(
    "ag_17_highly_connected",
    "SELECT id, label, degree FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY id) JOIN node USING (id) WHERE degree >= 10 ORDER BY degree DESC, id, label LIMIT 50",
)
def ag_17(g: Graph) -> DataFrame:
    """The entities with the most edges, of at least ten."""
    ends = g.edge.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).filter("degree >= 10")
    return ends.join(g.node.select("id", "label"), "id").orderBy(desc("degree"), asc("id"), asc("label")).limit(50)


@query("ag_18_pathway_coverage", "SELECT pathway, count(DISTINCT target) AS targets FROM pathway_target GROUP BY pathway ORDER BY targets DESC, pathway LIMIT 30")
def ag_18(g: Graph) -> DataFrame:
    """Pathways by their number of targets."""
    return g.pathway_target.groupBy("pathway").agg(F.count_distinct("target").alias("targets")).orderBy(desc("targets"), asc("pathway")).limit(30)


@query("agg_11_histogram", "SELECT CAST(least(floor(confidence * 5), 4) AS INT) AS bin, count(*) AS n FROM associated GROUP BY ALL")
def histogram(g: Graph) -> DataFrame:
    """Associations by confidence in five equal bins."""
    return g.associated.groupBy(F.least(F.floor(F.col("confidence") * 5), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("agg_12_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentiles(g: Graph) -> DataFrame:
    """Exact interpolated percentiles by group."""
    p = F.percentile("value", [0.5, 0.95, 0.99])
    return g.events.groupBy("event_type").agg(p.alias("p")).select("event_type", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


@query("agg_13_fill_rates", "SELECT 'evidence_level' AS field, round(avg(CASE WHEN evidence_level IS NULL THEN 0.0 ELSE 1.0 END), 6) AS filled FROM associated UNION ALL SELECT 'confidence', round(avg(CASE WHEN confidence IS NULL THEN 0.0 ELSE 1.0 END), 6) FROM associated")
def fill_rates(g: Graph) -> DataFrame:
    """The share of rows with a value, for each field, in one pass."""
    fields = ["evidence_level", "confidence"]
    row = g.associated.agg(*[F.round(F.avg(F.col(f).isNotNull().cast("double")), 6).alias(f) for f in fields])
    return row.unpivot([], fields, "field", "filled")


@query("agg_15_rule_summary", "SELECT rel, count(*) AS n, round(avg(confidence), 3) AS mean, min(confidence) AS lowest, max(confidence) AS highest FROM associated GROUP BY rel")
def rule_summary(g: Graph) -> DataFrame:
    """Count and range of confidence by edge type."""
    c = F.col("confidence")
    return g.associated.groupBy("rel").agg(F.count("*").alias("n"), F.round(F.avg(c), 3).alias("mean"), F.min(c).alias("lowest"), F.max(c).alias("highest"))
