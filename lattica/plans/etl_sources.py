"""ETL of agencies' and databases' records, as the tables give them: normalisers, classes, entity builders, rules by type, reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import classify, normalise
from lattica.functions.cypher import cases
from lattica.operators import records
from lattica.plans import rules  # noqa: F401  (registers what the inference driver runs)
from lattica.plans.binding import Graph
from lattica.plans.registry import QUERIES, SQL, query
from lattica.sources import agencies

_TARGETS = "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN concat('P', 10000 + s_suppkey % 90000, 'AB') WHEN s_suppkey % 3 = 1 THEN 'bad' END AS accession, CASE WHEN s_suppkey % 2 = 0 THEN concat('CHEMBL', s_suppkey) END AS chembl, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'Enzyme class' WHEN 1 THEN 'ion channel' WHEN 2 THEN 'growth factor receptor' END AS class, CASE s_suppkey % 3 WHEN 0 THEN 'Homo  sapiens' WHEN 1 THEN 'mus musculus' ELSE 'felis catus' END AS species FROM {supplier}"


@query(
    "nrm_6_targets",
    f"""SELECT key, CASE WHEN key % 3 = 0 THEN concat('uniprot:', accession) WHEN key % 2 = 0 THEN concat('chembl.target:', chembl) ELSE concat('target:', replace(lower(name), ' ', '-')) END AS id,
    CASE key % 4 WHEN 0 THEN 'Enzyme' WHEN 1 THEN 'IonChannel' WHEN 2 THEN 'Receptor' ELSE 'Protein' END AS protein_type, CASE key % 3 WHEN 0 THEN 'Human' WHEN 1 THEN 'Mouse' ELSE 'Felis Catus' END AS species FROM ({_TARGETS.replace('{supplier}', 'supplier')})""",
)
def nrm_6(g: Graph) -> DataFrame:
    """Targets by the best identifier they have, with their kind of protein and species."""
    rows = g.spark.sql(_TARGETS, supplier=g.supplier)
    return rows.select("key", normalise.target_id(F.col("accession"), F.col("chembl"), F.col("name")).alias("id"), normalise.protein_type(F.col("class")).alias("protein_type"), normalise.species(F.col("species")).alias("species"))


@query("nrm_7_diseases", "SELECT key, CASE WHEN key % 4 = 0 THEN concat('mondo:', key) WHEN key % 3 = 0 THEN concat('doid:', key) WHEN key % 5 = 0 THEN concat('icd10:', key) END AS id FROM disease")
def nrm_7(g: Graph) -> DataFrame:
    k = F.col("key")
    given = [F.when(k % n == 0, k.cast("string")) for n in (4, 3, 5)]
    return g.disease.select("key", normalise.disease_id(*given).alias("id"))


@query(
    "nrm_8_trials",
    "SELECT key, CASE phase WHEN 'Phase 1' THEN 'phase_1' WHEN 'Phase 2' THEN 'phase_2' WHEN 'Phase 3' THEN 'phase_3' WHEN 'Phase 4' THEN 'approved' END AS phase, lower(status) AS status, CASE WHEN key % 6 > 0 THEN enrollment END AS enrollment, key % 7 > 0 AS proper_id FROM trial",
)
def nrm_8(g: Graph) -> DataFrame:
    """Phase, status and enrollment of trial records as text, and whether their identifier is a proper one."""
    k = F.col("key")
    raw = g.trial.select("key", F.regexp_extract("phase", r"(\d)", 1).alias("phase"), F.upper("status").alias("status"), F.when(k % 6 > 0, F.col("enrollment").cast("string")).otherwise("about 10").alias("enrollment"), F.concat(F.when(k % 7 > 0, "NCT").otherwise("EU"), F.lpad(k.cast("string"), 8, "0")).alias("trial_id"))
    return raw.select("key", normalise.phase(F.col("phase")).alias("phase"), F.lower("status").alias("status"), F.col("enrollment").try_cast("int").alias("enrollment"), F.col("trial_id").rlike(r"^NCT\d{8}").alias("proper_id"))


@query(
    "nrm_9_products",
    "SELECT l_orderkey, l_linenumber, 'Oral Tablet' AS form, concat(CAST(CAST(l_quantity AS INT) AS VARCHAR), 'MG') AS strength, CASE l_returnflag WHEN 'R' THEN 'RX' WHEN 'A' THEN 'OTC' ELSE 'TENTATIVE' END AS status, strftime(l_shipdate, '%Y-%m-%d') AS approved FROM lineitem",
)
def nrm_9(g: Graph) -> DataFrame:
    """Products as an agency writes them: forms, strengths, states of marketing, dates in its three formats."""
    d = F.col("l_shipdate")
    written = F.when(F.col("l_linenumber") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("l_linenumber") % 3 == 1, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd-MMM-yyyy"))
    state = F.when(F.col("l_returnflag") == "R", "Prescription").when(F.col("l_returnflag") == "A", "Over-the-counter").otherwise("Tentative")
    raw = g.lineitem.select("l_orderkey", "l_linenumber", F.lit(" oral TABLET ").alias("form"), F.concat(F.col("l_quantity").cast("int"), F.lit("mg ")).alias("strength"), state.alias("status"), written.alias("approved"))
    return raw.select("l_orderkey", "l_linenumber", normalise.form(F.col("form")).alias("form"), normalise.strength(F.col("strength")).alias("strength"), normalise.marketing_status(F.col("status")).alias("status"), F.date_format(normalise.agency_date(F.col("approved")), "yyyy-MM-dd").alias("approved"))


@query("nrm_13_edge_types", "SELECT compound, target, CASE WHEN rel = 'INHIBITS' THEN 'INHIBITS' WHEN rel = 'ACTIVATES' THEN 'ACTIVATES' ELSE 'BINDS_TO' END AS rel FROM acts_on")
def nrm_13(g: Graph) -> DataFrame:
    """The edge that the kind of a measured activity stands for."""
    kind = F.when(F.col("rel") == "INHIBITS", "IC50").when(F.col("rel") == "ACTIVATES", "EC50").otherwise("Kd")
    return g.acts_on.select("compound", "target", normalise.edge_type(kind).alias("rel"))


@query("nrm_14_pathway_categories", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Metabolism' WHEN p_partkey % 4 = 1 THEN 'Cellular Processes' WHEN p_partkey % 4 = 2 THEN 'Organismal Systems' ELSE 'Other' END AS category FROM part")
def nrm_14(g: Graph) -> DataFrame:
    """A name with an earlier category's word in its description goes to that one."""
    k = F.col("p_partkey") % 4
    described = cases([(k == 0, "Tumor and Lipid turnover"), (k == 1, "Apoptosis of Cancer cells"), (k == 2, "immune response")], "unnamed")
    return g.part.select("p_partkey", classify.pathway_category(F.col("p_name"), described).alias("category"))


@query("nrm_16_shortage_states", "SELECT id, CASE status WHEN 'active' THEN 'current' ELSE 'resolved' END AS status FROM shortage")
def nrm_16(g: Graph) -> DataFrame:
    return g.shortage.select("id", normalise.shortage_status(F.when(F.col("status") == "active", "Currently in shortage").otherwise("RESOLVED: available")).alias("status"))


@query(
    "txt_1_agencies",
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ICH' WHEN 1 THEN 'FDA' WHEN 2 THEN 'CDE' WHEN 3 THEN 'NMPA' ELSE 'OTHER' END AS agency FROM pages",
)
def txt_1(g: Graph) -> DataFrame:
    """By the agency given, the address, then the organisation."""
    k = F.col("page_id") % 5
    given, url = F.when(k == 0, "ICH").when(k == 1, "unknown"), F.when(k == 1, F.concat(F.lit("https://www.FDA.gov/"), "page_id")).when(k == 2, "http://www.cde.org.cn/").otherwise(F.lit("http://example.com"))
    return g.pages.select("page_id", classify.agency(given, url, F.when(k == 3, "国家药监局")).alias("agency"))


@query("txt_10_guidance_types", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'revised_guideline' WHEN 1 THEN 'question_answer' WHEN 2 THEN 'guideline' WHEN 3 THEN 'reflection_paper' ELSE 'other' END AS kind FROM documents")
def txt_10(g: Graph) -> DataFrame:
    k = F.col("doc_id") % 5
    title = cases([(k == 0, "Revised Guideline on X"), (k == 1, "Q&A: guideline"), (k == 2, "Guideline on X"), (k == 3, "Reflection Paper, guidance")], "Minutes")
    return g.documents.select("doc_id", classify.first_rule(title, classify.GUIDANCE_TYPES, "other").alias("kind"))


_PROTEINS = """SELECT concat('Q', s_suppkey) AS accession, s_name AS name, concat('gene', s_suppkey) AS gene, array(named_struct('id', 'GO:1', 'term', 'F:binding'), named_struct('id', 'GO:2', 'term', 'P:growth'), named_struct('id', 'GO:3', 'term', 'F:transport')) AS go_terms,
    array(named_struct('id', concat('D', s_nationkey), 'name', 'One', 'note', CASE WHEN s_suppkey % 2 = 0 THEN 'a Biomarker of it' END)) AS diseases, CASE WHEN s_acctbal > 0 THEN array('x') ELSE array() END AS drugs FROM {supplier}"""


@query("txt_11_protein_terms", "SELECT concat('Q', s_suppkey) AS accession, 'binding,transport' AS functions, 'growth' AS processes, s_acctbal > 0 AS drug_target FROM supplier")
def txt_11(g: Graph) -> DataFrame:
    """Terms by aspect, and whether a drug acts on the protein."""
    rows = g.spark.sql(_PROTEINS, supplier=g.supplier)
    return rows.select("accession", F.array_join(agencies.terms_of(rows, "molecular_function"), ",").alias("functions"), F.array_join(agencies.terms_of(rows, "biological_process"), ",").alias("processes"), (F.size("drugs") > 0).alias("drug_target"))


def triples(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "rel").distinct()


@query("ent_1_molecules", "SELECT DISTINCT * FROM (SELECT concat('chembl:', l_partkey) AS src, concat('chembl.target:', l_suppkey) AS dst, CASE l_returnflag WHEN 'R' THEN 'INHIBITS' WHEN 'A' THEN 'ACTIVATES' ELSE 'BINDS_TO' END AS rel FROM lineitem UNION ALL SELECT concat('assay:', l_orderkey), concat('chembl:', l_partkey), 'TESTS_COMPOUND' FROM lineitem UNION ALL SELECT concat('assay:', l_orderkey), concat('chembl.target:', l_suppkey), 'TESTS_TARGET' FROM lineitem)")
def ent_1(g: Graph) -> DataFrame:
    raw = g.lineitem.selectExpr(
        "string(l_partkey) AS chembl_id", "concat('N', l_partkey) AS name", "string(null) AS inchikey",
        "array(named_struct('assay_id', string(l_orderkey), 'target_id', string(l_suppkey), 'target_name', 'T', 'standard_type', CASE l_returnflag WHEN 'R' THEN 'IC50' WHEN 'A' THEN 'EC50' ELSE 'Kd' END, 'standard_value', l_quantity)) AS activities",
    )
    return triples(agencies.of_molecules(raw)[1])


_NUMBER = "concat(CASE o_orderkey % 3 WHEN 0 THEN 'ANDA' WHEN 1 THEN 'BLA' ELSE 'NDA' END, o_orderkey)"


@query(
    "ent_4_applications",
    f"""WITH a AS (SELECT {_NUMBER} AS n, o_custkey, o_orderkey FROM orders), r AS (SELECT concat('Submission-', n, '-ORIG1') AS src, concat('Approval-', n) AS dst, 'SUBMITTED_FOR_APPROVAL' AS rel FROM a
    UNION ALL SELECT concat('Approval-', n), concat('Submission-', n, '-ORIG1'), 'HAS_SUBMISSION' FROM a UNION ALL SELECT concat('Approval-', n), concat('Product-', n, '-001'), 'APPROVED_PRODUCT' FROM a
    UNION ALL SELECT concat('Product-', n, '-001'), concat('manufacturer:c-', o_custkey), 'MANUFACTURED_BY' FROM a UNION ALL SELECT concat('Approval-', n), concat('compound:drug-', o_orderkey % 200), 'APPROVAL_FOR' FROM a
    UNION ALL SELECT concat('Approval-', n), 'agency:fda', 'HAS_MARKETING_AUTHORIZATION' FROM a) SELECT DISTINCT * FROM r""",
)
def ent_4(g: Graph) -> DataFrame:
    """Applications whose every record comes twice."""
    raw = g.orders.selectExpr(
        f"{_NUMBER} AS application_number", "concat('C ', o_custkey) AS sponsor_name",
        "array(named_struct('submission_type', 'ORIG', 'submission_number', '1', 'submission_status', 'AP', 'submission_status_date', date_format(o_orderdate, 'yyyyMMdd'))) AS submissions",
        "array(named_struct('product_number', '001', 'brand_name', 'B', 'dosage_form', 'TABLET', 'marketing_status', 'Prescription', 'active_ingredients', array(named_struct('name', concat('Drug ', o_orderkey % 200), 'strength', '1 mg')))) AS products",
    )
    # partitions of some 200,000 records and 500,000 edges, which stay so as the table grows
    records = g.orders.count()
    twice = raw.unionByName(raw).repartition(math.ceil(2 * records / 200_000) or 1, "application_number")
    edges = agencies.of_applications(twice)[1].select("src", "dst", "rel")
    return edges.repartition(math.ceil(6 * records / 500_000) or 1, "src", "dst").distinct()


@query(
    "ent_5_shortages",
    """WITH a AS (SELECT event_id AS k, user_id AS u FROM events WHERE event_type = 'signup'), r AS (SELECT concat('compound:drug-', k % 200) AS src, concat('DrugShortage-', k) AS dst, 'EXPERIENCES_SHORTAGE' AS rel FROM a
    UNION ALL SELECT concat('manufacturer:maker-', u), concat('DrugShortage-', k), 'EXPERIENCES_SHORTAGE' FROM a UNION ALL SELECT concat('manufacturer:maker-', u), concat('facility:plant-', u), 'HAS_FACILITY' FROM a
    UNION ALL SELECT concat('DrugShortage-', k), concat('facility:plant-', u), 'CAUSED_BY_QUALITY_ISSUE' FROM a WHERE k % 3 = 0 UNION ALL SELECT concat('DrugShortage-', k), 'agency:fda', 'REPORTED_TO_AGENCY' FROM a) SELECT DISTINCT * FROM r""",
)
def ent_5(g: Graph) -> DataFrame:
    raw = g.events.filter("event_type = 'signup'").selectExpr(
        "string(event_id) AS shortage_id", "concat('Drug ', event_id % 200) AS generic_name", "concat('Maker ', user_id) AS company_name", "'Current' AS status", "CASE WHEN event_id % 3 = 0 THEN 'Quality problem' ELSE 'Demand' END AS reason",
        "date_format(ts, 'yyyy-MM-dd') AS start_date", "string(null) AS end_date", "array(named_struct('name', concat('Plant ', user_id), 'country', 'X')) AS facilities",
    )
    return triples(agencies.of_shortages(raw)[1])


@query(
    "ent_7_labels",
    """SELECT DISTINCT * FROM (SELECT concat('compound:drug-', p_partkey) AS src, concat('condition:pain-', p_size) AS dst, 'TREATS' AS rel FROM part UNION ALL SELECT concat('compound:drug-', p_partkey), concat('condition:', lower(p_type)), 'CONTRAINDICATED_FOR' FROM part
    UNION ALL SELECT concat('compound:drug-', p_partkey), 'biomarker:her2', 'HAS_BIOMARKER' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT concat('compound:drug-', p_partkey), 'event:nausea', 'CAUSES_ADVERSE_EVENT' FROM part)""",
)
def ent_7(g: Graph) -> DataFrame:
    raw = g.part.selectExpr(
        "string(p_partkey) AS set_id", "concat('Drug ', p_partkey) AS drug", "array(concat('Pain ', p_size)) AS indications", "array(p_type) AS contraindications", "CAST(null AS array<string>) AS warnings", "CAST(array() AS array<string>) AS boxed",
        "CASE WHEN p_partkey % 5 = 0 THEN array('HER2') END AS biomarkers", "array('Nausea', ' nausea ') AS reactions",
    )
    return triples(agencies.of_labels(raw)[1])


@query("ent_8_pathways", "SELECT DISTINCT * FROM (SELECT concat('kegg.gene:', s_nationkey) AS src, concat('pathway:', s_suppkey) AS dst, 'PARTICIPATES_IN' AS rel FROM supplier UNION ALL SELECT concat('pathway:', s_suppkey), concat('kegg.compound:', s_suppkey % 10), 'PATHWAY_HAS_COMPOUND' FROM supplier UNION ALL SELECT concat('pathway:', s_suppkey), concat('pathway:', s_suppkey + 1), 'REGULATES_PATHWAY' FROM supplier)")
def ent_8(g: Graph) -> DataFrame:
    raw = g.supplier.selectExpr("string(s_suppkey) AS entry", "s_name AS name", "'lipid' AS description", "array(string(s_nationkey)) AS genes", "array(string(s_suppkey % 10)) AS compounds", "array(string(s_suppkey + 1)) AS related")
    return triples(agencies.of_pathways(raw)[1])


@query("ent_9_proteins", "SELECT concat('uniprot:Q', s_suppkey) AS src, concat('disease:D', s_nationkey) AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 'BIOMARKER_FOR' ELSE 'ASSOCIATED_WITH_DISEASE' END AS rel FROM supplier")
def ent_9(g: Graph) -> DataFrame:
    return triples(agencies.of_proteins(g.spark.sql(_PROTEINS, supplier=g.supplier))[1])


@query("ent_10_letters", "SELECT concat('CRL-', doc_id) AS src, concat('company:', source) AS dst, 'ISSUED_TO' AS rel FROM documents UNION ALL SELECT concat('CRL-', doc_id), concat('Submission-NDA', doc_id), 'ABOUT' FROM documents UNION ALL SELECT concat('person:dr-', lang), concat('CRL-', doc_id), 'APPROVED' FROM documents")
def ent_10(g: Graph) -> DataFrame:
    raw = g.documents.selectExpr("string(doc_id) AS letter_id", "source AS company_name", "array(concat('NDA ', doc_id), ' ') AS application_number", "array('CDER') AS approver_center", "concat('Dr ', lang) AS approver_name", "'2020-01-02' AS letter_date", "CAST(array() AS array<string>) AS drugs", "text")
    return triples(agencies.of_letters(raw)[1])


@query("ent_12_mentions", r"SELECT DISTINCT concat('document:', doc_id) AS src, concat('insult:', w) AS dst, 'MENTIONS' AS rel FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), 'stupid|clown|idiot|trash')) AS w FROM documents)")
def ent_12(g: Graph) -> DataFrame:
    """What whole texts mention, as entities with edges."""
    return triples(agencies.of_documents(g.documents, {"Insult": "stupid|clown|idiot|trash"})[1])


#: What each type of record must have and look like.
TYPE_RULES: dict[str, list[tuple[str, str, str, str]]] = {
    "Compound": [("id", "ERROR", "REQUIRED", "id IS NULL"), ("name", "ERROR", "REQUIRED", "name IS NULL"), ("inchikey", "ERROR", "FORMAT", "NOT inchikey RLIKE '^[A-Z]{14}-[A-Z]{10}-[A-Z]$'"), ("mass", "WARNING", "RANGE", "mass < 50 OR mass > 2000"), ("structure", "WARNING", "MISSING_STRUCTURE", "smiles IS NULL AND inchikey IS NULL")],
    "Target": [("id", "ERROR", "REQUIRED", "id IS NULL"), ("uniprot", "ERROR", "FORMAT", "NOT uniprot RLIKE '^[OPQ][0-9A-Z]{3}[0-9A-Z]{1}[0-9A-Z]{3}$'")],
    "Disease": [("name", "ERROR", "REQUIRED", "name IS NULL"), ("id", "ERROR", "FORMAT", "NOT id RLIKE '^D:[0-9]+$'")],
    "ClinicalTrial": [("id", "ERROR", "REQUIRED", "id IS NULL"), ("id", "ERROR", "FORMAT", "NOT id RLIKE '^NCT[0-9]{8}$'"), ("completed_on", "ERROR", "INVALID_DATE_RANGE", "completed_on < start_date"), ("phase", "WARNING", "BUSINESS", "status = 'Completed' AND phase = 'N/A'")],
    "SupplyChain": [("id", "ERROR", "REQUIRED", "id IS NULL"), ("status", "WARNING", "UNKNOWN_STATUS", "NOT lower(status) IN ('active', 'resolved', 'current', 'non-current')")],
    "Regulatory": [("id", "ERROR", "REQUIRED", "id IS NULL"), ("granted_on", "WARNING", "REQUIRED", "granted AND granted_on IS NULL")],
}
TYPE_VIEWS = {"Compound": "structure", "Target": "protein", "Disease": "disease", "ClinicalTrial": "trial", "SupplyChain": "shortage", "Regulatory": "authorisation"}


def checked(g: Graph, kind: str) -> DataFrame:
    rules: list[records.Rule] = [(f, s, c, lambda e=e: F.expr(e)) for f, s, c, e in TYPE_RULES[kind]]
    return records.findings(getattr(g, TYPE_VIEWS[kind]), rules).withColumn("kind", F.lit(kind))


def _duck(condition: str) -> str:
    """A rule's condition for DuckDB, which has another pattern operator."""
    left, found, pattern = condition.partition(" RLIKE ")
    return f"NOT regexp_matches({left.removeprefix('NOT ')}, {pattern})" if found else condition


_FINDINGS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{f}' AS field, '{s}' AS severity, '{c}' AS code FROM {TYPE_VIEWS[kind]} WHERE {_duck(e)}" for kind, rules in TYPE_RULES.items() for f, s, c, e in rules)


@query("dq_10_rules_by_type", f"SELECT kind, field, severity, code, count(*) AS n FROM ({_FINDINGS}) GROUP BY ALL")
def dq_10(g: Graph) -> DataFrame:
    """How often each rule of each type of record is broken."""
    out = None
    for kind in TYPE_RULES:
        one = checked(g, kind).select("kind", F.explode("findings").alias("f")).groupBy("kind", "f.field", "f.severity", "f.code").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_INVALID = {k: " OR ".join(f"coalesce(({_duck(e)}), false)" for _, s, _, e in rules if s == "ERROR") for k, rules in TYPE_RULES.items()}


@query(
    "dq_7_report",
    "SELECT *, round(1 - invalid * 1.0 / total, 6)::DOUBLE AS validity, CASE WHEN invalid * 20 > total THEN concat('Address ', invalid, ' validation errors') END AS recommendation FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS total, count(CASE WHEN {bad} THEN 1 END) AS invalid FROM {TYPE_VIEWS[k]}" for k, bad in _INVALID.items())
    + ")",
)
def dq_7(g: Graph) -> DataFrame:
    """Valid share by type of record, and what to do where it is under 95 %."""
    out = None
    for kind in TYPE_RULES:
        one = checked(g, kind).groupBy("kind").agg(F.count("*").alias("total"), F.count_if(~F.col("valid")).alias("invalid"))
        out = one if out is None else out.unionByName(one)
    advice = F.when(F.col("invalid") * 20 > F.col("total"), F.concat(F.lit("Address "), "invalid", F.lit(" validation errors")))
    return out.select("*", F.round(1 - F.col("invalid") / F.col("total"), 6).alias("validity"), advice.alias("recommendation"))


@query("prj_5_mapped_fields", "SELECT p_partkey AS source_id, upper(p_name) AS title, coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_size END, 70) AS quality FROM part")
def prj_5(g: Graph) -> DataFrame:
    """Fields renamed, given a default and transformed."""
    raw = g.part.withColumn("p_size", F.when(F.col("p_size") <= 40, F.col("p_size")))
    return records.mapped(raw, [("p_partkey", "source_id", None, None), ("p_name", "title", None, F.upper), ("p_size", "quality", 70, None)])


@query("srt_7_union_page", "SELECT id, day FROM (SELECT id, strftime(submitted, '%Y-%m-%d') AS day FROM submission UNION ALL SELECT id, strftime(granted_on, '%Y-%m-%d') FROM authorisation) ORDER BY coalesce(day, '') DESC, id LIMIT 20 OFFSET 20")
def srt_7(g: Graph) -> DataFrame:
    """The second page of two lists put together, the latest first and undated ones last."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    both = g.submission.select("id", day("submitted")).unionByName(g.authorisation.select("id", day("granted_on")))
    return both.orderBy(F.coalesce("day", F.lit("")).desc(), F.col("id").asc()).offset(20).limit(20)


@query("snk_4_merge", "SELECT key, CASE WHEN key % 3 = 0 THEN 'seen again' ELSE name END AS name, CASE WHEN key % 3 = 0 THEN 'match' END AS how FROM compound UNION ALL SELECT key + 100000000, 'new', 'create' FROM compound WHERE key % 300 = 0")
def snk_4(g: Graph) -> DataFrame:
    """A merge that sets other properties on rows it creates than on those it finds."""
    new = g.compound.filter("key % 3 = 0").select("key").unionByName(g.compound.filter("key % 300 = 0").select((F.col("key") + 100_000_000).alias("key")))
    old = g.compound.select("key", "name").withColumn("how", F.lit(None).cast("string"))
    return records.merged(old, new, "key", {"name": F.lit("new"), "how": F.lit("create")}, {"name": F.lit("seen again"), "how": F.lit("match")})


_RULES = ("rul_1_potential_treatment", "rul_2_confirmed_risk", "rul_3_quality_issue", "rul_6_trial_success")


def inferred(g: Graph, least: float = 0.5) -> DataFrame:
    """Every rule's edges with a confidence, rounded to three places, of at least so much."""
    out = None
    for name in _RULES:
        one = QUERIES[name](g.spark, g.folder).select(F.lit(name).alias("rule"), F.round("confidence", 3).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("confidence") >= least)


_INFERRED = " UNION ALL ".join(f"SELECT '{name}' AS rule, round(confidence, 3) AS confidence FROM ({SQL[name]})" for name in _RULES)


@query("rul_7_inferred", f"SELECT rule, CAST(floor(confidence * 10) AS INT) AS tenth, count(*) AS n, max(confidence)::DOUBLE AS best FROM ({_INFERRED}) WHERE confidence >= 0.5 GROUP BY ALL")
def rul_7(g: Graph) -> DataFrame:
    """What the rules infer with enough confidence: a histogram by rule."""
    return inferred(g).groupBy("rule", F.floor(F.col("confidence") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
