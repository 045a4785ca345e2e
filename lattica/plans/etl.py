"""ETL over the tables: normalising, classifying, deduplicating, identity, repair, quality and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import classify, normalise
from lattica.operators import records
from lattica.plans.binding import Graph
from lattica.plans.registry import query


@query("nrm_1_text", r"SELECT doc_id, nullif(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')), '') AS clean FROM documents")
def nrm_1(g: Graph) -> DataFrame:
    return g.documents.select("doc_id", normalise.text(F.col("text")).alias("clean"))


@query(
    "nrm_2_date",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS read FROM orders""",
)
def nrm_2(g: Graph) -> DataFrame:
    """Dates written in four ways, and one that is none, are read back. Days over 12 keep the two slashed forms apart."""
    d = F.col("o_orderdate")
    form = F.col("o_orderkey") % 5
    slashed = F.when(F.day(d) > 12, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    written = F.when(form == 0, F.date_format(d, "yyyy-MM-dd")).when(form == 1, F.date_format(d, "dd/MM/yyyy")).when(form == 2, slashed).when(form == 3, F.date_format(d, "yyyyMMdd")).otherwise("soon")
    return g.orders.select("o_orderkey", F.date_format(normalise.date(written), "yyyy-MM-dd").alias("read"))


@query("nrm_4_number", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 2 THEN l_quantity * 10 ELSE l_quantity END AS reading FROM lineitem")
def nrm_4(g: Graph) -> DataFrame:
    """Readings with units and powers of ten."""
    q = F.col("l_quantity").cast("string")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(" nM"))).when(F.col("l_linenumber") % 3 == 1, F.concat(q, F.lit(" mg"))).otherwise(F.concat(q, F.lit(" ×10^1")))
    return g.lineitem.select("l_orderkey", "l_linenumber", normalise.number(text).alias("reading"))


@query("nrm_5_compound_id", "SELECT key, CASE WHEN key % 3 = 0 THEN 'inchikey:' || inchikey WHEN key % 3 = 1 THEN 'chembl:' || key ELSE 'compound:' || replace(name, ' ', '-') END AS primary_id FROM compound")
def nrm_5(g: Graph) -> DataFrame:
    k = F.col("key") % 3
    return g.compound.select("key", normalise.compound_id(F.when(k == 0, F.col("inchikey")), F.lit("ChEMBL"), F.when(k == 1, F.col("key").cast("string")), F.col("name")).alias("primary_id"))


@query("nrm_10_documents", "SELECT doc_id, 'DOC-' || substring(md5(source || '/' || doc_id), 1, 8) AS id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS snippet FROM documents")
def nrm_10(g: Graph) -> DataFrame:
    path = F.concat_ws("/", "source", "doc_id")
    return g.documents.select("doc_id", normalise.document_id(path).alias("id"), normalise.snippet(F.col("text")).alias("snippet"))


@query("txt_2_document_type", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'guidance|guideline') THEN 'guidance' WHEN regexp_matches(lower(text), 'warning letter|warning') THEN 'warning' WHEN regexp_matches(lower(text), 'approv') THEN 'approval' WHEN regexp_matches(lower(text), 'recall') THEN 'recall' WHEN regexp_matches(lower(text), 'report|review') THEN 'report' ELSE 'other' END AS kind FROM documents")
def txt_2(g: Graph) -> DataFrame:
    return g.documents.select("doc_id", classify.first_rule(F.col("text"), classify.DOCUMENT_TYPES, "other").alias("kind"))


def _area_sql() -> str:
    hits = [" + ".join(f"contains(lower(text), '{k}')::INT" for k in ks) for ks in classify.AREAS.values()]
    h = ", ".join(f"{x} AS h{i}" for i, x in enumerate(hits))
    top = "greatest(" + ", ".join(f"h{i}" for i in range(len(hits))) + ")"
    whens = " ".join(f"WHEN h{i} = {top} THEN '{n}'" for i, n in enumerate(classify.AREAS))
    return f"SELECT doc_id, CASE WHEN {top} = 0 THEN 'GENERAL' {whens} END AS area FROM (SELECT doc_id, {h} FROM documents)"


@query("txt_3_area", _area_sql())
def txt_3(g: Graph) -> DataFrame:
    return g.documents.select("doc_id", classify.best_area(F.col("text")).alias("area"))


@query("txt_7_mentions", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{3,}'))), ',') AS numbers FROM documents")
def txt_7(g: Graph) -> DataFrame:
    """The distinct long numbers in each text."""
    return g.documents.select("doc_id", F.array_join(F.array_sort(classify.mentions(F.col("text"), "[0-9]{3,}")), ",").alias("numbers"))


@query("ded_1_first_compound", "SELECT inchikey, min(key) AS key FROM compound GROUP BY inchikey")
def ded_1(g: Graph) -> DataFrame:
    return records.first_seen(g.compound.select("inchikey", "key"), "inchikey", ["key"])


@query(
    "ded_4_documents",
    """WITH d AS (SELECT doc_id, source || '/' || (doc_id % 400) AS url, left(text, 40) AS title, text FROM documents), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS r FROM d) WHERE r = 1)
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(concat_ws('|', title, url, lower(title), substring(text, 1, 500))) ORDER BY doc_id) AS r FROM once) WHERE r = 1""",
)
def ded_4(g: Graph) -> DataFrame:
    d = g.documents.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id") % 400).alias("url"), F.left("text", F.lit(40)).alias("title"), F.lower(F.left("text", F.lit(40))).alias("date"), "text")
    return records.distinct_documents(d, ["doc_id"]).select("doc_id")


@query("idm_2_canonical", "SELECT key, CASE WHEN key % 2 = 0 THEN 'COMPOUND:inchikey:' || inchikey ELSE 'COMPOUND:HASH:' || substring(md5('{\"key\":' || key || ',\"name\":\"' || name || '\"}'), 1, 16) END AS canonical FROM compound")
def idm_2(g: Graph) -> DataFrame:
    key = F.when(F.col("key") % 2 == 0, F.col("inchikey"))
    return g.compound.select("key", records.canonical_id("COMPOUND", [("inchikey", key)], ["name", "key"]).alias("canonical"))


@query("idm_4_merged_to", "SELECT DISTINCT id AS src, first_value(id) OVER (PARTITION BY inchikey ORDER BY id) AS dst FROM compound")
def idm_4(g: Graph) -> DataFrame:
    """Every compound's edge to the canonical one of the same structure."""
    first = g.compound.groupBy("inchikey").agg(F.min("id").alias("dst"))
    return g.compound.select(F.col("id").alias("src"), "inchikey").join(first, "inchikey").select("src", "dst").distinct()


@query(
    "idm_7_repair",
    """SELECT CASE event_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'loose' ELSE 'none' END AS how, count(*) AS n FROM events WHERE user_id < (SELECT count(*) FROM supplier) GROUP BY ALL""",
)
def idm_7(g: Graph) -> DataFrame:
    """Edges that name their nodes exactly, loosely or not at all."""
    nodes = g.supplier.select(F.concat(F.lit("FEI_"), "s_suppkey").alias("id"))
    k = F.col("event_id") % 3
    name = F.when(k == 0, F.concat(F.lit("FEI_"), "user_id")).when(k == 1, F.concat(F.lit("fei__"), "user_id", F.lit(" "))).otherwise(F.concat(F.lit("unknown "), "user_id"))
    least = g.supplier.agg(F.count("*").alias("suppliers"))
    edges = g.events.join(F.broadcast(least)).filter("user_id < suppliers").select("event_id", name.alias("dst"))
    return records.repaired(edges, nodes, "dst").groupBy("how").agg(F.count("*").alias("n"))


RULES: list[records.Rule] = [
    ("weight", "ERROR", "RANGE", lambda: (F.col("weight") < 905) | (F.col("weight") > 995)),
    ("name", "ERROR", "REQUIRED", lambda: F.col("name").isNull()),
    ("size", "WARNING", "RANGE", lambda: F.col("size") > 45),
]


@query("dq_2_findings", "SELECT code, severity, field, count(*) AS n FROM (SELECT 'RANGE' AS code, 'ERROR' AS severity, 'weight' AS field FROM compound WHERE weight < 905 OR weight > 995 UNION ALL SELECT 'REQUIRED', 'ERROR', 'name' FROM compound WHERE name IS NULL UNION ALL SELECT 'RANGE', 'WARNING', 'size' FROM compound WHERE size > 45) GROUP BY ALL")
def dq_2(g: Graph) -> DataFrame:
    f = records.findings(g.compound, RULES).select(F.explode("findings").alias("f"))
    return f.groupBy("f.code", "f.severity", "f.field").agg(F.count("*").alias("n"))


@query(
    "dq_6_quality",
    """WITH m AS (SELECT round((avg((id IS NOT NULL)::INT) + avg((evidence_level IS NOT NULL)::INT)) / 2, 6) AS completeness, round(avg(1 - (confidence < 0.1)::INT), 6) AS validity, round(avg((confidence >= 0.05)::INT), 6) AS consistency,
        round(count(DISTINCT id) * 1.0 / count(id), 6) AS uniqueness, round(avg((seen >= DATE '2001-08-01' - INTERVAL 365 DAY)::INT), 6) AS timeliness
        FROM (SELECT target || disease AS id, evidence_level, confidence, o_orderdate AS seen FROM associated JOIN orders ON disease = 'D:' || o_custkey))
    SELECT *, round(completeness * 0.25 + validity * 0.3 + consistency * 0.2 + uniqueness * 0.15 + timeliness * 0.1, 4)::DOUBLE AS score FROM m""",
)
def dq_6(g: Graph) -> DataFrame:
    """A quality report over associations and when they were seen."""
    rows = g.associated.join(g.orders.select(F.concat(F.lit("D:"), "o_custkey").alias("disease"), F.col("o_orderdate").alias("seen")), "disease").select(F.concat("target", "disease").alias("id"), "evidence_level", "confidence", "seen")
    rules: list[records.Rule] = [("confidence", "ERROR", "RANGE", lambda: F.col("confidence") < 0.1)]
    return records.quality(rows, "id", ["id", "evidence_level"], rules, [F.col("confidence") >= 0.05], "seen", "2001-08-01")


@query("snk_1_upsert", "SELECT key, CASE WHEN key % 4 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN key % 4 = 0 THEN 1.5 ELSE weight END AS weight FROM compound UNION ALL SELECT key + 100000000, 'renamed', 1.5 FROM compound WHERE key % 400 = 1")
def snk_1(g: Graph) -> DataFrame:
    """New properties over old ones, and new rows beside old rows."""
    old = g.compound.select("key", "name", "weight")
    same = old.filter("key % 4 = 0").select("key")
    fresh = old.filter("key % 400 = 1").select((F.col("key") + 100000000).alias("key"))
    new = same.unionByName(fresh).withColumns({"name": F.lit("renamed"), "weight": F.lit(1.5)})
    return records.upserted(old, new, "key")


@query("snk_2_connected", "SELECT DISTINCT 'P:' || (event_id % 3000) AS src, 'S:' || user_id AS dst, event_type AS rel FROM events WHERE event_id % 3000 IN (SELECT p_partkey FROM part) AND user_id IN (SELECT s_suppkey FROM supplier)")
def snk_2(g: Graph) -> DataFrame:
    """Edges from events whose two ends exist."""
    e = g.events.select(F.concat(F.lit("P:"), F.col("event_id") % 3000).alias("src"), F.concat(F.lit("S:"), "user_id").alias("dst"), F.col("event_type").alias("rel"))
    return records.connected_edges(e, g.compound, g.target).select("src", "dst", "rel")


@query("snk_5_detach", "SELECT src, dst, rel FROM link WHERE src NOT IN (SELECT id FROM compound WHERE stage = 'preclinical') AND dst NOT IN (SELECT id FROM compound WHERE stage = 'preclinical')")
def snk_5(g: Graph) -> DataFrame:
    """What is left of the edges when some nodes go."""
    return records.detached(g.compound, g.link, g.compound.filter("stage = 'preclinical'"))[1]


@query("snk_9_last_written", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def snk_9(g: Graph) -> DataFrame:
    return records.last_written(g.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")
