"""Records of agencies and databases - applications, shortages, letters, labels, molecules, proteins, pathways - to nodes and edges.

Files are read with json_records or the XML reader under the schemas here; builders take rows of these schemas and give
(nodes, edges) as those in entities do. Rows without their identifier give nothing; null arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import normalise
from lattica.sources.entities import Graph, _edge, _node, _union, once

APPLICATION = """application_number STRING, sponsor_name STRING, submissions ARRAY<STRUCT<submission_type: STRING, submission_number: STRING, submission_status: STRING, submission_status_date: STRING>>,
    products ARRAY<STRUCT<product_number: STRING, brand_name: STRING, dosage_form: STRING, marketing_status: STRING, active_ingredients: ARRAY<STRUCT<name: STRING, strength: STRING>>>>"""
SHORTAGE = "shortage_id STRING, generic_name STRING, company_name STRING, status STRING, reason STRING, start_date STRING, end_date STRING, facilities ARRAY<STRUCT<name: STRING, country: STRING>>"
LETTER = "letter_id STRING, company_name STRING, application_number ARRAY<STRING>, approver_center ARRAY<STRING>, approver_name STRING, letter_date STRING, drugs ARRAY<STRING>, text STRING"
MOLECULE = "chembl_id STRING, name STRING, inchikey STRING, activities ARRAY<STRUCT<assay_id: STRING, target_id: STRING, target_name: STRING, standard_type: STRING, standard_value: DOUBLE>>"
PROTEIN = "accession STRING, name STRING, gene STRING, go_terms ARRAY<STRUCT<id: STRING, term: STRING>>, diseases ARRAY<STRUCT<id: STRING, name: STRING, note: STRING>>, drugs ARRAY<STRING>"
LABEL = "set_id STRING, drug STRING, indications ARRAY<STRING>, contraindications ARRAY<STRING>, warnings ARRAY<STRING>, boxed ARRAY<STRING>, biomarkers ARRAY<STRING>, reactions ARRAY<STRING>"
PATHWAY = "entry STRING, name STRING, description STRING, genes ARRAY<STRING>, compounds ARRAY<STRING>, related ARRAY<STRING>"
PRODUCT_XML = "product_number STRING, appl_no STRING, applicant STRING, form STRING, strength STRING, marketing_status STRING, approval_date STRING"


def products(spark: SparkSession, path: str, sponsor: str | None = None, kind: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """<product> elements of an agency's XML, with the kind of application by its number, filtered by what is given."""
    rows = spark.read.format("xml").option("rowTag", "product").schema(PRODUCT_XML).load(path)
    out = rows.withColumn("kind", application_kind(F.col("appl_no"))).withColumn("approved_on", normalise.agency_date(F.col("approval_date")))
    wanted = [
        None if sponsor is None else F.lower("applicant").contains(sponsor.lower()),
        None if kind is None else F.col("kind") == kind,
        None if first is None else F.col("approved_on") >= F.lit(first).cast("date"),
        None if last is None else F.col("approved_on") <= F.lit(last).cast("date"),
    ]
    for w in wanted:
        out = out if w is None else out.filter(w)
    return out


def application_kind(number: Column) -> Column:
    """ANDA, BLA or sNDA by how a number starts, else NDA."""
    n = F.upper(F.trim(number))
    return F.when(n.startswith("ANDA"), "ANDA").when(n.startswith("BLA"), "BLA").when(n.startswith("SNDA"), "sNDA").otherwise("NDA")


def _each(rows: DataFrame, column: str, *kept: str) -> DataFrame:
    return rows.select(*kept, F.explode(column).alias("x"))


def _key(prefix: str, c: Column) -> Column:
    """prefix:slug; null where the slug is empty."""
    return F.concat(F.lit(f"{prefix}:"), F.nullif(normalise.slug(c), F.lit("")))


def of_applications(rows: DataFrame) -> Graph:
    """Approvals, submissions, products, compounds and the agency; an application number counts once."""
    rows = rows.filter("application_number IS NOT NULL").dropDuplicates(["application_number"])
    number = F.col("application_number")
    approval = F.concat(F.lit("Approval-"), number)
    s, p = _each(rows, "submissions", "application_number"), _each(rows, "products", "application_number", "sponsor_name")
    submission = F.concat(F.lit("Submission-"), number, F.lit("-"), F.col("x.submission_type"), F.col("x.submission_number"))
    product = F.concat(F.lit("Product-"), number, F.lit("-"), F.col("x.product_number"))
    i = p.select("application_number", F.col("x.product_number").alias("product_number"), F.explode("x.active_ingredients").alias("x"))
    compound = _key("compound", F.col("x.name"))
    agency = F.lit("agency:fda")
    nodes = _union(
        _node(rows, approval, "Approval", number, kind=application_kind(number), sponsor=F.col("sponsor_name"), products=F.coalesce(F.size("products"), F.lit(0))),
        _node(s, submission, "Submission", submission, status=F.col("x.submission_status"), on=normalise.agency_date(F.col("x.submission_status_date"))),
        _node(p, product, "DrugProduct", F.col("x.brand_name"), form=normalise.form(F.col("x.dosage_form")), status=normalise.marketing_status(F.col("x.marketing_status"))),
        _node(i, compound, "Compound", F.col("x.name")),
        _node(rows.limit(1), agency, "RegulatoryAgency", F.lit("FDA")),
    )
    edges = _union(
        _edge(s, submission, approval, F.lit("SUBMITTED_FOR_APPROVAL")),
        _edge(s, approval, submission, F.lit("HAS_SUBMISSION")),
        _edge(p, approval, product, F.lit("APPROVED_PRODUCT")),
        _edge(p, product, _key("manufacturer", F.col("sponsor_name")), F.lit("MANUFACTURED_BY")),
        _edge(i, approval, compound, F.lit("APPROVAL_FOR")),
        _edge(rows, approval, agency, F.lit("HAS_MARKETING_AUTHORIZATION")),
    )
    return once(nodes), edges


def of_shortages(rows: DataFrame) -> Graph:
    """Shortages, compounds, manufacturers and their facilities; a quality reason ties the facility to the shortage."""
    rows = rows.filter("shortage_id IS NOT NULL")
    shortage, compound, maker = F.concat(F.lit("DrugShortage-"), "shortage_id"), _key("compound", F.col("generic_name")), _key("manufacturer", F.col("company_name"))
    f = _each(rows, "facilities", "shortage_id", "company_name", "reason")
    facility = _key("facility", F.col("x.name"))
    nodes = _union(
        _node(rows, shortage, "DrugShortage", F.col("generic_name"), status=normalise.shortage_status(F.col("status")), start=normalise.date(F.col("start_date")), end=normalise.date(F.col("end_date")), reason=F.col("reason")),
        _node(rows, compound, "Compound", F.col("generic_name")),
        _node(rows, maker, "Manufacturer", F.col("company_name")),
        _node(f, facility, "Facility", F.col("x.name"), country=F.col("x.country")),
    )
    edges = _union(
        _edge(rows, compound, shortage, F.lit("EXPERIENCES_SHORTAGE")),
        _edge(rows, maker, shortage, F.lit("EXPERIENCES_SHORTAGE")),
        _edge(f, maker, facility, F.lit("HAS_FACILITY")),
        _edge(f.filter(F.lower("reason").contains("quality")), shortage, facility, F.lit("CAUSED_BY_QUALITY_ISSUE")),
        _edge(rows, shortage, F.lit("agency:fda"), F.lit("REPORTED_TO_AGENCY")),
    )
    return once(nodes), edges


def of_letters(rows: DataFrame) -> Graph:
    """Letters, the companies they went to, submissions and drugs they are about, centres and who signed them."""
    rows = rows.filter("letter_id IS NOT NULL")
    letter, company, person = F.concat(F.lit("CRL-"), "letter_id"), _key("company", F.col("company_name")), _key("person", F.when(F.length(F.trim("approver_name")) > 3, F.col("approver_name")))
    a, c, d = _each(rows, "application_number", "letter_id"), _each(rows, "approver_center", "letter_id"), _each(rows, "drugs", "letter_id")
    number = F.nullif(F.regexp_replace("x", r"\s", ""), F.lit(""))
    nodes = _union(
        _node(rows, letter, "Document", F.concat(F.lit("Letter "), "letter_id"), on=normalise.agency_date(F.col("letter_date")), length=F.length("text")),
        _node(rows, company, "Company", F.trim("company_name")),
        _node(rows, person, "Person", F.trim("approver_name")),
        _node(a, F.concat(F.lit("Submission-"), number), "Submission", number, kind=application_kind(number)),
        _node(c, _key("agency", F.col("x")), "RegulatoryAgency", F.trim("x")),
        _node(d, _key("compound", F.col("x")), "Compound", F.trim("x")),
    )
    edges = _union(
        _edge(rows, letter, company, F.lit("ISSUED_TO")),
        _edge(a, letter, F.concat(F.lit("Submission-"), number), F.lit("ABOUT")),
        _edge(d, letter, _key("compound", F.col("x")), F.lit("ABOUT")),
        _edge(rows, person, letter, F.lit("APPROVED")),
    )
    return once(nodes), edges


def of_molecules(rows: DataFrame) -> Graph:
    """Compounds, targets and assays; the kind of activity gives the edge between compound and target."""
    rows = rows.filter("chembl_id IS NOT NULL")
    compound = normalise.compound_id(F.col("inchikey"), F.lit("chembl"), F.col("chembl_id"), F.col("name"))
    a = rows.select(compound.alias("id"), F.explode("activities").alias("x"))
    target, assay = F.concat(F.lit("chembl.target:"), "x.target_id"), F.concat(F.lit("assay:"), "x.assay_id")
    nodes = _union(
        _node(rows, compound, "Compound", F.col("name")),
        _node(a, target, "Target", F.col("x.target_name")),
        _node(a, assay, "Assay", F.col("x.assay_id"), type=F.col("x.standard_type")),
    )
    edges = _union(
        _edge(a, F.col("id"), target, normalise.edge_type(F.coalesce("x.standard_type", F.lit(""))), value=F.col("x.standard_value")),
        _edge(a, assay, F.col("id"), F.lit("TESTS_COMPOUND")),
        _edge(a, assay, target, F.lit("TESTS_TARGET")),
    )
    return once(nodes), edges


#: What the letter before a term's name stands for.
ASPECTS = {"F": "molecular_function", "P": "biological_process", "C": "cellular_component"}


def terms_of(rows: DataFrame, aspect: str) -> Column:
    """The names of a protein's terms of one aspect, which stands before the name as a letter and a colon."""
    letter = {v: k for k, v in ASPECTS.items()}[aspect]
    own = F.filter(rows["go_terms"], lambda t: t["term"].startswith(f"{letter}:"))
    return F.transform(F.coalesce(own, F.array().cast("array<struct<id: string, term: string>>")), lambda t: F.substring(t["term"], 3, 1_000_000))


def of_proteins(rows: DataFrame) -> Graph:
    """Targets and diseases; a note that mentions a biomarker makes the target one, else it is associated."""
    rows = rows.filter("accession IS NOT NULL")
    target = F.concat(F.lit("uniprot:"), "accession")
    d = _each(rows, "diseases", "accession")
    disease = F.coalesce(F.concat(F.lit("disease:"), "x.id"), _key("disease", F.col("x.name")))
    biomarker = F.lower(F.coalesce("x.note", F.lit(""))).contains("biomarker")
    nodes = _union(
        _node(rows, target, "Target", F.col("name"), gene=F.upper("gene"), drug_target=F.coalesce(F.size("drugs") > 0, F.lit(False)), functions=F.size(terms_of(rows, "molecular_function")), processes=F.size(terms_of(rows, "biological_process"))),
        _node(d, disease, "Disease", F.col("x.name")),
    )
    return once(nodes), _edge(d, target, disease, F.when(biomarker, "BIOMARKER_FOR").otherwise("ASSOCIATED_WITH_DISEASE"))


def of_labels(rows: DataFrame) -> Graph:
    """Compounds with what their labels name: indications, contraindications, warnings, biomarkers, reactions."""
    compound = _key("compound", F.col("drug"))
    kinds = (
        ("indications", "TREATS", "condition", "Condition"),
        ("contraindications", "CONTRAINDICATED_FOR", "condition", "Condition"),
        ("warnings", "HAS_WARNING_FOR", "condition", "Condition"),
        ("boxed", "HAS_BOXED_WARNING", "condition", "Condition"),
        ("biomarkers", "HAS_BIOMARKER", "biomarker", "Biomarker"),
        ("reactions", "CAUSES_ADVERSE_EVENT", "event", "AdverseEvent"),
    )
    each = [(_each(rows, column, "drug"), rel, prefix, label) for column, rel, prefix, label in kinds]
    nodes = _union(_node(rows, compound, "Compound", F.col("drug")), *[_node(x, _key(prefix, F.col("x")), label, normalise.text(F.col("x"))) for x, _, prefix, label in each])
    return once(nodes), _union(*[_edge(x, compound, _key(prefix, F.col("x")), F.lit(rel)) for x, rel, prefix, _ in each])


def of_pathways(rows: DataFrame) -> Graph:
    """Pathways with their category, the genes that take part, their compounds, and pathways that regulate each other."""
    from lattica.functions.classify import pathway_category

    rows = rows.filter("entry IS NOT NULL")
    pathway = F.concat(F.lit("pathway:"), "entry")
    genes, compounds, related = (_each(rows, c, "entry") for c in ("genes", "compounds", "related"))
    gene, compound = F.concat(F.lit("kegg.gene:"), "x"), F.concat(F.lit("kegg.compound:"), "x")
    nodes = _union(
        _node(rows, pathway, "Pathway", F.col("name"), category=pathway_category(F.col("name"), F.col("description"))),
        _node(genes, gene, "Target", F.col("x")),
        _node(compounds, compound, "Compound", F.col("x")),
    )
    edges = _union(
        _edge(genes, gene, pathway, F.lit("PARTICIPATES_IN")),
        _edge(compounds, pathway, compound, F.lit("PATHWAY_HAS_COMPOUND")),
        _edge(related, pathway, F.concat(F.lit("pathway:"), "x"), F.lit("REGULATES_PATHWAY")),
    )
    return once(nodes), edges


def of_documents(rows: DataFrame, patterns: dict[str, str]) -> Graph:
    """Documents (doc_id, text) and what they mention: label -> pattern; an entity counts once a document, whatever its case."""
    from lattica.functions.classify import mentions

    doc = F.concat(F.lit("document:"), F.col("doc_id").cast("string"))
    found = [(rows.select("doc_id", F.explode(mentions(F.lower("text"), p)).alias("x")), label) for label, p in patterns.items()]
    nodes = _union(_node(rows, doc, "Document", doc), *[_node(x, _key(label.lower(), F.col("x")), label, F.col("x")) for x, label in found])
    return once(nodes), _union(*[_edge(x, doc, _key(label.lower(), F.col("x")), F.lit("MENTIONS")) for x, label in found])
