"""Technical reports, pathway maps and files of results over the tables, whose rows are put into the sources' forms first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.state import saved
from lattica.plans.binding import Graph
from lattica.plans.registry import query
from lattica.sources import details, entities, pathway_maps, reports, results, web_pages

_KIND = "CASE s_suppkey % 3 WHEN 0 THEN 'cleanroom' WHEN 1 THEN 'aseptic area' ELSE 'warehouse' END"
#: A report as a maker's data would fill it in.
_REPORT = f"""concat('PDA TR', s_suppkey % 30, '. The ', {_KIND}, ' of ', s_name, ' is held at 2', s_suppkey % 10, ' C under ISO Class ', 5 + s_suppkey % 4, '. It follows ISO 14644-', 1 + s_suppkey % 3,
    ' and EU GMP Annex 1. A bioburden is taken daily. A particle count is made weekly. Steam sterilization is shown by media fill.')"""


def _reports(g: Graph) -> DataFrame:
    return reports.read_reports(g.supplier.select(F.col("s_suppkey").alias("key"), F.expr(_REPORT).alias("text")), "key")


@query(
    "txt_8_reports",
    f"""SELECT s_suppkey AS key, concat('TR', s_suppkey % 30) AS number, concat({_KIND}, ' (TR', s_suppkey % 30, ')') AS facility, concat('ISO ', 5 + s_suppkey % 4) AS classification, CASE s_suppkey % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'aseptic_processing' ELSE 'storage' END AS use,
    concat('2', s_suppkey % 10) AS temperature_c, concat('ISO 14644-', 1 + s_suppkey % 3, ',EU GMP Annex 1') AS standards, 'bioburden:daily,particle count:weekly' AS assays, 'Steam sterilization:media_fill_simulation,media fill:media_fill_simulation' AS processes FROM supplier""",
)
def txt_8(g: Graph) -> DataFrame:
    """What reports say of facilities, standards, assays and processes."""
    f = F.get("facilities", F.lit(0))
    told = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a], x[b])), ",").alias(c)
    names = F.array_join(F.transform("standards", lambda x: x["name"]), ",").alias("standards")
    return _reports(g).select("key", "number", f["name"].alias("facility"), f["classification"].alias("classification"), f["use"].alias("use"), f["temperature_c"].alias("temperature_c"), names, told("assays", "kind", "frequency"), told("processes", "kind", "validation"))


@query(
    "txt_9_report_links",
    """SELECT concat('TR', s_suppkey % 30) AS number, concat('aseptic area (TR', s_suppkey % 30, ')') AS src, 'EU GMP Annex 1' AS dst, 'REQUIRES_STANDARD' AS rel, 0.75::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 3 = 1
    UNION ALL SELECT concat('TR', s_suppkey % 30), 'particle count Test', concat('cleanroom (TR', s_suppkey % 30, ')'), 'TEST_QUALITY', 0.7::DOUBLE FROM supplier WHERE s_suppkey % 3 = 0""",
)
def txt_9(g: Graph) -> DataFrame:
    """Links within reports: standards that facilities require, assays that test them, makers and validations."""
    return reports.report_links(_reports(g))


@query(
    "ent_11_report_nodes",
    f"""SELECT DISTINCT concat('facility:', {_KIND}, ' (tr', s_suppkey % 30, ')') AS id, 'Facility' AS label, concat({_KIND}, ' (TR', s_suppkey % 30, ')') AS name FROM supplier
    UNION ALL SELECT DISTINCT concat('qualitystandard:iso 14644-', 1 + s_suppkey % 3), 'QualityStandard', concat('ISO 14644-', 1 + s_suppkey % 3) FROM supplier UNION ALL SELECT * FROM (VALUES ('qualitystandard:eu gmp annex 1', 'QualityStandard', 'EU GMP Annex 1'),
    ('assay:bioburden test', 'Assay', 'bioburden Test'), ('assay:particle count test', 'Assay', 'particle count Test'), ('process:steam sterilization process', 'Process', 'Steam sterilization Process'), ('process:media fill process', 'Process', 'media fill Process')) WHERE EXISTS (SELECT 1 FROM supplier)""",
)
def ent_11(g: Graph) -> DataFrame:
    """The nodes that reports make."""
    return reports.of_facility_reports(_reports(g))[0].select("id", "label", "name")


_MAP = """concat('<pathway name="path:', s_suppkey % 25, '" org="hsa" title="Pathway ', s_suppkey % 25, '"><entry id="1" name="S:', s_suppkey, '" type="gene"/><entry id="2" name="S:', s_suppkey + 1, ' S:', s_suppkey + 2, '" type="gene"/>',
    '<relation entry1="1" entry2="2" type="PPrel"><subtype name="', CASE s_suppkey % 2 WHEN 0 THEN 'inhibition' ELSE 'activation' END, '" value="x"/></relation><reaction id="3" name="rn:', s_suppkey, '" type="reversible"><substrate id="4" name="cpd:', s_suppkey % 7, '"/><product id="5" name="cpd:', 7 + s_suppkey % 5, '"/></reaction></pathway>')"""


@query(
    "src_15_pathway_maps",
    """SELECT src, dst, rel, count(*) AS n FROM (SELECT concat('S:', s_suppkey + i) AS src, concat('pathway:path:', s_suppkey % 25) AS dst, 'PARTICIPATES_IN' AS rel FROM supplier, range(0, 3) r(i)
    UNION ALL SELECT concat('S:', s_suppkey), concat('S:', s_suppkey + i), CASE s_suppkey % 2 WHEN 0 THEN 'INHIBITS' ELSE 'ACTIVATES' END FROM supplier, range(1, 3) r(i) UNION ALL SELECT concat('cpd:', s_suppkey % 7), concat('cpd:', 7 + s_suppkey % 5), 'CONVERTED_TO' FROM supplier) GROUP BY ALL""",
)
def src_15(g: Graph) -> DataFrame:
    """The edges of pathway maps in XML."""
    maps = pathway_maps.parsed_maps(g.supplier.select(F.expr(_MAP).alias("text")))
    return pathway_maps.of_pathway_maps(maps)[1].groupBy("src", "dst", "rel").agg(F.count("*").alias("n"))


@query("snk_7_summary", "SELECT 'node' AS kind, label AS type, count(*) AS n FROM node GROUP BY label UNION ALL SELECT 'edge', rel, count(*) FROM link GROUP BY rel")
def snk_7(g: Graph) -> DataFrame:
    """The summary that goes with files of nodes and edges by type."""
    return results.summary(g.node, g.link)


@query(
    "snk_8_document_statistics",
    """SELECT field, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) AS rank FROM (SELECT 'source' AS field, source AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY ALL)) WHERE rank <= 10""",
)
def snk_8(g: Graph) -> DataFrame:
    """The commonest sources and languages of documents."""
    return results.document_statistics(g.documents, ["source", "lang"])


_STUDY = """to_json(named_struct('protocolSection', named_struct('identificationModule', named_struct('nctId', concat('NCT', o_orderkey)),
    'sponsorCollaboratorsModule', named_struct('leadSponsor', named_struct('name', concat('Sponsor ', o_custkey), 'class', 'INDUSTRY'), 'responsibleParty', named_struct('type', CASE o_orderkey % 3 WHEN 0 THEN 'PRINCIPAL_INVESTIGATOR' WHEN 1 THEN 'SPONSOR_INVESTIGATOR' ELSE 'SPONSOR' END, 'name', o_clerk_, 'investigatorFullName', concat('Dr ', o_clerk_))),
    'contactsLocationsModule', named_struct('centralContacts', array(named_struct('name', o_clerk_, 'role', 'CONTACT'))), 'outcomesModule', named_struct('primaryOutcomes', array(named_struct('measure', 'survival')), 'secondaryOutcomes', array(named_struct('measure', 'response'), named_struct('measure', 'pain'))),
    'eligibilityModule', named_struct('eligibilityCriteria', concat('Inclusion Criteria:\\n adults\\n order ', o_orderkey, '\\n\\nExclusion Criteria:\\n none'), 'sex', 'ALL'))))"""


def _study_details(g: Graph) -> DataFrame:
    text = g.orders.withColumn("o_clerk_", F.concat(F.lit("Person "), F.col("o_orderkey") % 97)).select(F.expr(_STUDY).alias("value"))
    return details.flat_details(text.select(F.from_json("value", details.STUDY_DETAILS).alias("r")).select("r.*"))


@query(
    "ent_2_study_details",
    """SELECT src, dst, rel FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders), LATERAL (SELECT concat('trial:NCT', k) AS src, concat('sponsor:sponsor-', c) AS dst, 'SPONSORED_BY' AS rel UNION ALL SELECT concat('trial:NCT', k), concat('investigator:person-', k % 97), 'HAS_PRINCIPAL_INVESTIGATOR' WHERE k % 3 = 0
    UNION ALL SELECT concat('trial:NCT', k), concat('investigator:dr-person-', k % 97), 'HAS_PRINCIPAL_INVESTIGATOR' WHERE k % 3 = 1 UNION ALL SELECT concat('trial:NCT', k), concat('investigator:NCT', k, '-0'), 'HAS_INVESTIGATOR' WHERE k % 3 > 0
    UNION ALL SELECT concat('trial:NCT', k), concat('outcome:NCT', k, o), 'HAS_OUTCOME' FROM (VALUES ('-primary-0'), ('-secondary-0'), ('-secondary-1')) v(o) UNION ALL SELECT concat('trial:NCT', k), concat('eligibility:NCT', k), 'HAS_ELIGIBILITY')""",
)
def ent_2(g: Graph) -> DataFrame:
    """Who sponsors and leads trials, what they measure, and who may take part."""
    # each kind of edge reads the records, which are parsed once
    return details.of_study_details(saved(_study_details(g), "details"))[1].select("src", "dst", "rel")


@query("ent_2_criteria", "SELECT concat('NCT', o_orderkey) AS trial_id, concat('adults|order ', o_orderkey) AS inclusion, 'none' AS exclusion FROM orders")
def ent_2_criteria(g: Graph) -> DataFrame:
    """Criteria of eligibility by the headings that they stand under."""
    c = details.criteria(F.col("eligibility.eligibilityCriteria"))
    return _study_details(g).select("trial_id", F.array_join(c["inclusion"], "|").alias("inclusion"), F.array_join(c["exclusion"], "|").alias("exclusion"))


_DRUG = """concat('<drug><drugbank-id primary="true">DB', p_partkey, '</drugbank-id><name>', p_name, '</name><enzymes><enzyme><id>BE', p_partkey % 50, '</id><name>cyp</name><organism>Humans</organism>', CASE WHEN p_partkey % 2 = 0 THEN concat('<polypeptide><external-identifiers><external-identifier><resource>UniProt</resource><identifier>UP', p_partkey % 50, '</identifier></external-identifier></external-identifiers></polypeptide>') ELSE '' END,
    '</enzyme></enzymes><transporters><transporter><id>BT', p_partkey % 20, '</id><name>abc</name></transporter></transporters><pharmacokinetics><half-life>', p_size, ' hours</half-life></pharmacokinetics><toxicity>low</toxicity><drug-interactions><drug-interaction><drugbank-id>DB', p_partkey + 1, '</drugbank-id><name>x</name><description>',
    CASE p_partkey % 3 WHEN 0 THEN 'The serum level may rise; avoid it.' WHEN 1 THEN 'The risk is moderate.' ELSE 'Nothing known' END, '</description></drug-interaction></drug-interactions></drug>')"""


@query(
    "ent_6_drug_details",
    """SELECT src, dst, rel, severity, kind FROM (SELECT p_partkey AS k FROM part), LATERAL (SELECT concat('drugbank:DB', k) AS src, concat('target:', CASE WHEN k % 2 = 0 THEN 'UP' ELSE 'BE' END, k % 50) AS dst, 'METABOLIZED_BY' AS rel, NULL AS severity, NULL AS kind UNION ALL SELECT concat('drugbank:DB', k), concat('target:BT', k % 20), 'TRANSPORTED_BY', NULL, NULL
    UNION ALL SELECT concat('drugbank:DB', k), concat('drugbank:DB', k + 1), 'INTERACTS_WITH', CASE k % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'moderate' ELSE 'unknown' END, CASE k % 3 WHEN 0 THEN 'pharmacokinetic' WHEN 1 THEN 'pharmacodynamic' ELSE 'unknown' END)""",
)
def ent_6(g: Graph) -> DataFrame:
    """Enzymes, transporters and interactions of drug records in XML."""
    records = g.part.select(F.from_xml(F.expr(_DRUG), details.DRUG_DETAILS).alias("r")).select("r.*")
    e = details.of_drug_details(details.flat_drugs(records))[1]
    return e.select("src", "dst", "rel", F.try_element_at("props", F.lit("severity")).alias("severity"), F.try_element_at("props", F.lit("kind")).alias("kind"))


@query(
    "ent_3_reports",
    """SELECT src, dst, rel, count(*) AS n FROM (SELECT concat('compound:drug-', event_id % 200) AS src, concat('event:', event_id) AS dst, 'CAUSED_ADVERSE_EVENT' AS rel FROM events WHERE event_type = 'error' AND event_id % 4 > 0 UNION ALL SELECT concat('event:', event_id), concat('condition:term-', user_id % 90), 'ASSOCIATED_WITH' FROM events WHERE event_type = 'error') GROUP BY ALL""",
)
def ent_3(g: Graph) -> DataFrame:
    """Reports of adverse events: only suspected drugs cause them."""
    rows = g.events.filter("event_type = 'error'")
    report = F.col("event_id").cast("string").alias("safetyreportid")
    demo = rows.select(report, F.date_format("ts", "yyyyMMdd").alias("receivedate"), F.lit("Y").alias("serious"))
    drug = rows.select(report, F.when(F.col("event_id") % 4 > 0, 1).otherwise(2).alias("drugcharacterization"), F.concat(F.lit("DRUG "), F.col("event_id") % 200).alias("drugname"))
    reaction = rows.select(report, F.concat(F.lit("Term  "), F.col("user_id") % 90).alias("reactionmeddraversionpt"))
    return entities.of_reports(demo, drug, reaction)[1].groupBy("src", "dst", "rel").agg(F.count("*").alias("n"))


@query(
    "src_25_page_links",
    r"""SELECT page_id, place, href, concat(regexp_extract(url, '^[a-z]+://[^/?#]*'), href) AS url, label FROM (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS place, unnest(h) AS href, unnest(l) AS label FROM
    (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages))""",
)
def src_25_links(g: Graph) -> DataFrame:
    """Where every page links to."""
    return web_pages.links(g.pages, "page_id")


_TABLE = """concat('<table><tr><th>Document</th><th>Issue Date</th><th>Type</th></tr><tr><td><a class="x" href="/doc/', p_partkey, '">', p_name, '</a> &amp; more</td><td>2001-0', 1 + p_size % 9, '-01</td><td>', p_mfgr_, '</td></tr><tr><td>no link</td><td></td></tr></table><table><tr><td><a href="x.pdf">', p_name, '</a></td></tr></table>')"""


@query(
    "src_25_listed_documents",
    """SELECT p_partkey AS key, 0 AS "table", 1 AS row, concat(p_name, ' & more') AS title, concat('https://agency.example/doc/', p_partkey) AS url, concat('kind ', p_size % 4) AS kind, concat('2001-0', 1 + p_size % 9, '-01') AS date FROM part
    UNION ALL SELECT p_partkey, 1, 0, p_name, 'https://agency.example/lists/x.pdf', NULL, NULL FROM part""",
)
def src_25_documents(g: Graph) -> DataFrame:
    """Documents that tables of web pages list."""
    # a table of few bytes makes long pages, so its rows are dealt to all cores first
    cores = g.spark.sparkContext.defaultParallelism
    made = g.part.select("p_partkey", "p_name", "p_size").repartition(4 * cores, "p_partkey").withColumn("p_mfgr_", F.concat(F.lit("kind "), F.col("p_size") % 4))
    pages = made.select(F.col("p_partkey").alias("key"), F.lit("https://agency.example/lists/all?x=1").alias("url"), F.expr(_TABLE).alias("html"))
    return web_pages.listed_documents(pages, "key").select("key", "table", "row", "title", "url", "kind", "date")
