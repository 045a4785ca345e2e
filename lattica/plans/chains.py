"""Chains across domains, further inferences, quality by metric, pages with totals and overviews.

A chain whose branches don't depend on one another isn't listed path by path: each branch is summed, and the number of paths is
the product, so no key's rows are multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import asc, day, desc, page
from lattica.operators import algorithms, paths
from lattica.operators.records import findings
from lattica.plans.binding import AS_OF, Graph
from lattica.plans.registry import query


def _n(df: DataFrame, key: str, name: str, condition: str | None = None) -> DataFrame:
    """How many rows of df each key has."""
    return (df if condition is None else df.filter(condition)).groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))


def _beside(nodes: DataFrame, *counts: DataFrame) -> DataFrame:
    for c in counts:
        nodes = nodes.join(c, "id", "left")
    return nodes.fillna(0)


@query(
    "vis_3_supply_risk",
    """SELECT m.id, coalesce(i.n, 0) AS inspections, coalesce(i.failed, 0) AS failed, coalesce(a.n, 0) AS actions, coalesce(s.n, 0) AS shortages, coalesce(i.n, 0) * coalesce(a.n, 0) * coalesce(s.n, 0) AS paths
    FROM manufacturer m LEFT JOIN (SELECT manufacturer, count(*) AS n, count(*) FILTER (result = 'FAILED') AS failed FROM inspection GROUP BY 1) i ON i.manufacturer = m.id
    LEFT JOIN (SELECT manufacturer, count(*) AS n FROM action GROUP BY 1) a ON a.manufacturer = m.id LEFT JOIN (SELECT manufacturer, count(*) AS n FROM shortage GROUP BY 1) s ON s.manufacturer = m.id""",
)
def vis_3_supply_risk(g: Graph) -> DataFrame:
    """Manufacturer, inspections, actions, shortages: how many of each, and the paths through them (null beyond 64 bits)."""
    rows = _beside(g.manufacturer.select("id"), _n(g.inspection, "manufacturer", "inspections"), _n(g.inspection, "manufacturer", "failed", "result = 'FAILED'"), _n(g.action, "manufacturer", "actions"), _n(g.shortage, "manufacturer", "shortages"))
    return rows.withColumn("paths", F.try_multiply(F.try_multiply("inspections", "actions"), F.col("shortages")))


@query(
    "vis_3_target_discovery",
    """WITH o AS (SELECT trial, count(*) AS n FROM outcome GROUP BY trial), c AS (SELECT x.compound, count(*) AS trials, CAST(sum(o.n) AS BIGINT) AS outcomes FROM trial_compound x JOIN o ON o.trial = x.trial GROUP BY x.compound)
    SELECT a.target, a.compound, c.trials, c.outcomes FROM (SELECT DISTINCT target, compound FROM acts_on) a JOIN c ON c.compound = a.compound""",
)
def vis_3_target_discovery(g: Graph) -> DataFrame:
    """Target, compound, and the trials and outcomes that follow; trials without outcomes are no path."""
    o = g.outcome.groupBy("trial").agg(F.count("*").alias("n"))
    c = g.trial_compound.join(o, "trial").groupBy("compound").agg(F.count("*").alias("trials"), F.sum("n").alias("outcomes"))
    return g.acts_on.select("target", "compound").distinct().join(c, "compound").select("target", "compound", "trials", "outcomes")


@query(
    "vis_3_competitors",
    """WITH c AS (SELECT x.compound, count(*) AS trials, count(a.id) AS approvals FROM trial_compound x JOIN trial t ON t.id = x.trial JOIN submission s ON s.key = t.key LEFT JOIN approval a ON a.submission = s.id GROUP BY x.compound)
    SELECT p.manufacturer, p.product AS compound, c.trials, c.approvals FROM product p JOIN c ON c.compound = p.product""",
)
def vis_3_competitors(g: Graph) -> DataFrame:
    """Company, compound, and its trials with a submission and the approvals of these."""
    t = g.trial_compound.join(g.trial.select(F.col("id").alias("trial"), "key"), "trial").join(g.submission.select("key", F.col("id").alias("submission")), "key")
    t = t.join(g.approval.select("submission", F.col("id").alias("approval")), "submission", "left")
    c = t.groupBy("compound").agg(F.count("*").alias("trials"), F.count("approval").alias("approvals"))
    return g.product.withColumnRenamed("product", "compound").join(c, "compound").select("manufacturer", "compound", "trials", "approvals")


@query(
    "vis_3_safety",
    """SELECT c.id, coalesce(e.n, 0) AS events, coalesce(s.n, 0) AS signals, coalesce(a.n, 0) AS actions, coalesce(e.n, 0) * coalesce(s.n, 0) * coalesce(a.n, 0) AS paths FROM compound c
    LEFT JOIN (SELECT compound, count(*) AS n FROM adverse_event GROUP BY 1) e ON e.compound = c.id LEFT JOIN (SELECT compound, count(*) AS n FROM signal GROUP BY 1) s ON s.compound = c.id LEFT JOIN (SELECT product, count(*) AS n FROM action GROUP BY 1) a ON a.product = c.id""",
)
def vis_3_safety(g: Graph) -> DataFrame:
    """Compound, adverse events, signals, actions: how many of each, and the paths through them."""
    rows = _beside(g.compound.select("id"), _n(g.adverse_event, "compound", "events"), _n(g.signal, "compound", "signals"), _n(g.action, "product", "actions"))
    return rows.withColumn("paths", F.try_multiply(F.try_multiply("events", "signals"), F.col("actions")))


@query("sh_23_quality_issue", "SELECT manufacturer, count(DISTINCT id) AS failed, 'HIGH' AS risk FROM inspection WHERE result = 'FAILED' GROUP BY manufacturer HAVING count(DISTINCT id) >= 2")
def sh_23(g: Graph) -> DataFrame:
    """Two different failed inspections or more make a potential quality issue of high risk."""
    failed = g.inspection.filter("result = 'FAILED'").select("manufacturer", "id").distinct().groupBy("manufacturer").agg(F.count("*").alias("failed"))
    return failed.filter("failed >= 2").withColumn("risk", F.lit("HIGH"))


@query("sh_27_competition", "SELECT target, compound, count(*) OVER (PARTITION BY target) - 1 AS competitors FROM (SELECT DISTINCT target, compound FROM acts_on WHERE rel = 'INHIBITS') QUALIFY count(*) OVER (PARTITION BY target) > 1")
def sh_27(g: Graph) -> DataFrame:
    """Compounds that compete on a target that each inhibits: the target stands for its pairs, which aren't listed."""
    own = g.acts_on.filter("rel = 'INHIBITS'").select("target", "compound").distinct()
    n = own.groupBy("target").agg((F.count("*") - 1).alias("competitors")).filter("competitors > 0")
    return own.join(n, "target").select("target", "compound", "competitors")


@query(
    "inf_2_paths",
    """WITH u AS MATERIALIZED (SELECT src, dst, rel, concat(src, '|', rel, '|', dst) AS edge FROM (SELECT DISTINCT src, dst, rel FROM link)), e AS MATERIALIZED (SELECT * FROM u UNION ALL SELECT dst, src, rel, edge FROM u WHERE src <> dst),
    one AS (SELECT dst AS stop, concat(src, '>', dst) AS path, rel AS rels, edge AS e1 FROM e WHERE src = 'P:7'), two AS MATERIALIZED (SELECT e.dst AS stop, concat(o.path, '>', e.dst) AS path, concat(o.rels, '>', e.rel) AS rels, o.e1, e.edge AS e2 FROM one o JOIN e ON e.src = o.stop WHERE e.edge <> o.e1),
    three AS (SELECT concat(t.path, '>', e.dst) AS path, concat(t.rels, '>', e.rel) AS rels FROM two t JOIN e ON e.src = t.stop AND e.dst = 'W:2' WHERE e.edge <> t.e1 AND e.edge <> t.e2)
    SELECT * FROM (SELECT 2 AS length, path, rels FROM two WHERE stop = 'W:2' UNION ALL SELECT 3, path, rels FROM three) ORDER BY length, path, rels LIMIT 20""",
)
def inf_2(g: Graph) -> DataFrame:
    """Twenty undirected paths of two or three steps between two nodes."""
    return paths.paths_between(g.link, "P:7", "W:2", 3, 2, 20).select("length", F.array_join("nodes", ">").alias("path"), F.array_join("rels", ">").alias("rels"))


def structural_similarity(formula_a: Column, key_a: Column, formula_b: Column, key_b: Column) -> Column:
    """1 for equal structure keys (14 letters), 0.8 for equal beginnings (7), 0.5 for equal formulas; null otherwise."""
    same = lambda n: F.substring(key_a, 1, n) == F.substring(key_b, 1, n)
    return F.when(same(14), 1.0).when(same(7), 0.8).when(formula_a == formula_b, 0.5)


@query(
    "inf_4_structures",
    """WITH a AS (SELECT inchikey, smiles FROM structure WHERE id = 'P:3') SELECT b.id, CASE WHEN substring(a.inchikey, 1, 14) = substring(b.inchikey, 1, 14) THEN 1.0 WHEN substring(a.inchikey, 1, 7) = substring(b.inchikey, 1, 7) THEN 0.8 ELSE 0.5 END::DOUBLE AS similarity
    FROM structure b, a WHERE b.id <> 'P:3' AND (substring(a.inchikey, 1, 7) = substring(b.inchikey, 1, 7) OR a.smiles = b.smiles)""",
)
def inf_4(g: Graph) -> DataFrame:
    """Compounds of like structure to one."""
    own = g.at("structure", "id", "P:3").select(F.col("smiles").alias("s"), F.col("inchikey").alias("k"))
    rows = g.structure.filter("id <> 'P:3'").join(F.broadcast(own))  # one row, by the key of its table
    return rows.select("id", structural_similarity(F.col("s"), F.col("k"), F.col("smiles"), F.col("inchikey")).alias("similarity")).filter("similarity is not null")


@query(
    "dq_1_completeness",
    """SELECT field, rate, complete, n, rate >= 0.9 AS passed FROM (SELECT unnest(['name', 'smiles', 'inchikey']) AS field, unnest([f1, f2, f3]) AS rate, complete, n FROM (SELECT round(count(name) / count(*)::DOUBLE, 6) AS f1, round(count(smiles) / count(*)::DOUBLE, 6) AS f2,
    round(count(inchikey) / count(*)::DOUBLE, 6) AS f3, count(*) FILTER (name IS NOT NULL AND smiles IS NOT NULL AND inchikey IS NOT NULL) AS complete, count(*) AS n FROM structure))""",
)
def dq_1(g: Graph) -> DataFrame:
    """How full each required field is, how many records are complete, and whether a field passes nine tenths."""
    fields = ["name", "smiles", "inchikey"]
    whole = F.count_if(F.col("name").isNotNull() & F.col("smiles").isNotNull() & F.col("inchikey").isNotNull())
    one = g.structure.agg(*[F.round(F.count(f) / F.count("*"), 6).alias(f) for f in fields], whole.alias("complete"), F.count("*").alias("n"))
    return one.unpivot(["complete", "n"], fields, "field", "rate").select("field", "rate", "complete", "n", (F.col("rate") >= 0.9).alias("passed"))


#: Rules that a trial is consistent by, as SQL that both engines read.
TRIAL_RULES = {
    "dates in order": "completed_on IS NULL OR completed_on >= start_date",
    "completed needs a phase": "status <> 'Completed' OR phase <> 'N/A'",
    "somebody enrolled": "enrollment > 0",
}


@query(
    "dq_4_consistency",
    "SELECT rule, n, passed, round(passed / n::DOUBLE, 6) AS rate FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n, count(*) FILTER ({v}) AS passed FROM trial" for k, v in TRIAL_RULES.items()) + ")",
)
def dq_4(g: Graph) -> DataFrame:
    """The share of trials that each rule holds for, in one pass."""
    one = g.trial.agg(F.count("*").alias("n"), *[F.count_if(F.expr(v)).alias(k) for k, v in TRIAL_RULES.items()])
    return one.unpivot(["n"], [F.col(f"`{k}`") for k in TRIAL_RULES], "rule", "passed").select("rule", "n", "passed", F.round(F.col("passed") / F.col("n"), 6).alias("rate"))


@query("dq_8_violations", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS rule FROM trial WHERE NOT ({v})" for k, v in TRIAL_RULES.items()) + ")")
def dq_8(g: Graph) -> DataFrame:
    """Each trial with each rule that it breaks; the table is read once."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(v), k) for k, v in TRIAL_RULES.items()]))
    return g.trial.select("id", F.explode(broken).alias("rule"))


@query("dq_5_timeliness", f"SELECT count(*) AS n, count(*) FILTER (start_date >= DATE '{AS_OF}' - INTERVAL 365 DAY) AS recent, round(count(*) FILTER (start_date >= DATE '{AS_OF}' - INTERVAL 365 DAY) / count(*)::DOUBLE, 6) AS timeliness FROM trial")
def dq_5(g: Graph) -> DataFrame:
    recent = F.count_if(F.col("start_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 365))
    return g.trial.agg(F.count("*").alias("n"), recent.alias("recent"), F.round(recent / F.count("*"), 6).alias("timeliness"))


@query(
    "dq_9_validators",
    """SELECT id, findings, valid, valid AND findings = '' AS strictly FROM (SELECT id, concat_ws(',', CASE WHEN smiles IS NULL THEN 'smiles:ERROR:REQUIRED' END, CASE WHEN NOT regexp_matches(inchikey, '^[A-F0-9]{14}$') THEN 'inchikey:ERROR:FORMAT' END,
    CASE WHEN mass < 50 OR mass > 800 THEN 'mass:WARN:RANGE' END, CASE WHEN logp > 5 AND donors > 5 THEN 'logp:ERROR:RULES' END) AS findings, NOT (smiles IS NULL OR coalesce(NOT regexp_matches(inchikey, '^[A-F0-9]{14}$'), false) OR coalesce(logp > 5 AND donors > 5, false)) AS valid FROM structure)""",
)
def dq_9(g: Graph) -> DataFrame:
    """Required, format, range and business rules in this order; a strict reading takes warnings as errors."""
    c = F.col
    rules = [
        ("smiles", "ERROR", "REQUIRED", lambda: c("smiles").isNull()),
        ("inchikey", "ERROR", "FORMAT", lambda: ~c("inchikey").rlike("^[A-F0-9]{14}$")),
        ("mass", "WARN", "RANGE", lambda: ~c("mass").between(50, 800)),
        ("logp", "ERROR", "RULES", lambda: (c("logp") > 5) & (c("donors") > 5)),
    ]
    rows = findings(g.structure, rules)
    told = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["field"], x["severity"], x["code"])), ",")
    return rows.select("id", told.alias("findings"), "valid", (c("valid") & (F.size("findings") == 0)).alias("strictly"))


def with_totals(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page with the number of all rows and pages beside each row; the count is one pass that nothing else waits for."""
    total = df.agg(F.count("*").alias("total"))
    pages = F.floor((F.col("total") + (size - 1)) / size).cast("long").alias("pages")
    return page(df, order, number, size).join(F.broadcast(total.select("total", pages)))  # one row


@query(
    "api_10_trials_page",
    "SELECT id, phase, status, count(*) OVER () AS total, (count(*) OVER () + 19) // 20 AS pages FROM trial WHERE status = 'Completed' AND enrollment >= 500 ORDER BY key LIMIT 20 OFFSET 40",
)
def api_10(g: Graph) -> DataFrame:
    rows = g.trial.filter("status = 'Completed' AND enrollment >= 500").select("id", "phase", "status", "key")
    return with_totals(rows, [asc("key")], 3, 20).drop("key")


@query(
    "api_19_approvals_page",
    "SELECT id, kind, strftime(approved_on, '%Y-%m-%d') AS day, count(*) OVER () AS total, (count(*) OVER () + 24) // 25 AS pages FROM approval WHERE status = 'approved' AND kind = 'accelerated' ORDER BY approved_on DESC, id LIMIT 25",
)
def api_19(g: Graph) -> DataFrame:
    rows = g.approval.filter("status = 'approved' AND kind = 'accelerated'").select("id", "kind", "approved_on")
    return with_totals(rows, [desc("approved_on"), asc("id")], 1, 25).select("id", "kind", day("approved_on"), "total", "pages")


@query(
    "api_11_makers_page",
    """SELECT id, name, quality FROM (SELECT id, name, CAST(coalesce(100 - 10 * failed, 70) AS BIGINT) AS quality FROM manufacturer LEFT JOIN (SELECT manufacturer, count(*) FILTER (result = 'FAILED') AS failed FROM inspection GROUP BY 1) ON manufacturer = id)
    ORDER BY name, id LIMIT 20 OFFSET 20""",
)
def api_11(g: Graph) -> DataFrame:
    """A page of makers with a score, 70 for those never inspected; sponsors stand in where there are no makers at all."""
    failed = g.inspection.groupBy(F.col("manufacturer").alias("id")).agg(F.count_if(F.col("result") == "FAILED").alias("failed"))
    makers = g.manufacturer.select("id", "name")
    if makers.isEmpty():
        makers = g.sponsor.select(F.concat(F.lit("SP:"), "key").alias("id"), "name")
    rows = makers.join(failed, "id", "left").select("id", "name", F.coalesce(100 - 10 * F.col("failed"), F.lit(70)).cast("long").alias("quality"))
    return page(rows, [asc("name"), asc("id")], 2, 20)


@query(
    "api_20_agencies",
    """SELECT s.agency, s.n AS submissions, coalesce(c.n, 0) AS authorisations, coalesce(c.granted, 0) AS granted FROM (SELECT agency, count(*) AS n FROM submission GROUP BY 1) s LEFT JOIN (SELECT agency, count(*) AS n, count(*) FILTER (granted) AS granted FROM authorisation GROUP BY 1) c ON c.agency = s.agency""",
)
def api_20(g: Graph) -> DataFrame:
    s = g.submission.groupBy("agency").agg(F.count("*").alias("submissions"))
    c = g.authorisation.groupBy("agency").agg(F.count("*").alias("authorisations"), F.count_if("granted").alias("granted"))
    return s.join(c, "agency", "left").fillna(0)


OVERVIEW = {"research": ["compound", "target"], "clinical": ["trial", "adverse_event"], "supply": ["manufacturer", "shortage"], "regulatory": ["submission", "approval", "inspection", "signal"]}


@query("api_1_overview", "SELECT domain, label, n, CAST(sum(n) OVER (PARTITION BY domain) AS BIGINT) AS in_domain FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS domain, '{v}' AS label, count(*) AS n FROM {v}" for d, own in OVERVIEW.items() for v in own) + ")")
def api_1(g: Graph) -> DataFrame:
    """Ten counts and the sums of their domains."""
    rows = None
    for d, own in OVERVIEW.items():
        for v in own:
            one = getattr(g, v).agg(F.lit(d).alias("domain"), F.lit(v).alias("label"), F.count("*").alias("n"))
            rows = one if rows is None else rows.unionByName(one)
    sums = rows.groupBy("domain").agg(F.sum("n").alias("in_domain"))
    return rows.join(F.broadcast(sums), "domain").select("domain", "label", "n", "in_domain")  # four rows


@query("srch_1_index", "SELECT token, label, count(*) AS nodes, CAST(sum(tf) AS BIGINT) AS hits FROM (SELECT token, label, id, count(*) AS tf FROM (SELECT id, label, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS token FROM node) WHERE token <> '' GROUP BY ALL) GROUP BY ALL")
def srch_1(g: Graph) -> DataFrame:
    """The words of an index over names: in how many nodes of each label a word occurs, and how often."""
    words = g.node.select("id", "label", F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("token")).filter("token <> ''")
    return words.groupBy("token", "label", "id").agg(F.count("*").alias("tf")).groupBy("token", "label").agg(F.count("*").alias("nodes"), F.sum("tf").alias("hits"))


#: Rules by condition: those that speak of targets and diseases are about associations, the others have no data to hold on.
CONDITIONS = {
    "target association": "compound target associated with disease",
    "strong inhibition": "compound inhibits target that causes disease",
    "shared class": "compounds of one class",
    "biomarker": "compound target is biomarker for disease",
    "approved stage": "compound is approved",
    "trial success": "trial completed",
}


@query(
    "rsn_5_rules",
    """SELECT rule, count(*) AS pairs FROM (SELECT DISTINCT a.compound, d.disease FROM acts_on a JOIN associated d ON d.target = a.target), (SELECT unnest(['target association', 'strong inhibition', 'biomarker']) AS rule) GROUP BY rule""",
)
def rsn_5(g: Graph) -> DataFrame:
    """How many compounds and diseases each rule that can be judged holds for."""
    judged = [k for k, v in CONDITIONS.items() if "target" in v and "disease" in v]
    pairs = algorithms.two_step_pairs(g.acts_on.select(F.col("compound").alias("src"), F.col("target").alias("mid")), g.associated.select(F.col("target").alias("mid"), F.col("disease").alias("dst")))
    return pairs.filter("pairs > 0").select(F.explode(F.array(*map(F.lit, judged))).alias("rule"), "pairs")


def apply_rules(g: Graph, rules: dict[str, str], views: list[str], parameters: dict[str, object]) -> DataFrame:
    """rule, src, dst of all rules: SQL over named views that gives src and dst, with :named parameters bound, never spliced in."""
    found = None
    for name, sql in rules.items():
        rows = g.spark.sql(sql, args={k: v for k, v in parameters.items() if f":{k}" in sql}, **{v: getattr(g, v) for v in views if "{" + v + "}" in sql})
        rows = rows.select(F.lit(name).alias("rule"), "src", "dst").distinct()
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "rsn_7_user_rules",
    """SELECT DISTINCT 'strong binder' AS rule, compound AS src, target AS dst FROM acts_on WHERE strength >= 40 AND rel = 'INHIBITS' UNION ALL SELECT DISTINCT 'risky maker', manufacturer, id FROM inspection WHERE result = 'FAILED' AND kind = 'for_cause'""",
)
def rsn_7(g: Graph) -> DataFrame:
    """Two rules as a user would write them."""
    rules = {
        "strong binder": "SELECT compound AS src, target AS dst FROM {acts_on} WHERE strength >= :least AND rel = :rel",
        "risky maker": "SELECT manufacturer AS src, id AS dst FROM {inspection} WHERE result = :result AND kind = 'for_cause'",
    }
    return apply_rules(g, rules, ["acts_on", "inspection"], {"least": 40, "rel": "INHIBITS", "result": "FAILED"})
