"""More ETL: identifiers and categories, processed files, constraints, coverage, approval states, severity of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import classify, normalise
from lattica.functions.cypher import cases
from lattica.plans.binding import Graph
from lattica.plans.registry import query


@query("nrm_3_choice", "SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'urgent' WHEN '2-high' THEN 'high' ELSE 'normal' END AS level FROM orders")
def nrm_3(g: Graph) -> DataFrame:
    return g.orders.select("o_orderkey", normalise.choice(F.col("o_orderpriority"), {"1-urgent": "urgent", "2-high": "high"}, "normal").alias("level"))


@query("nrm_11_yes_and_dates", "SELECT event_id, event_type = 'error' AS serious, strftime(ts, '%Y-%m-%d') AS received FROM events")
def nrm_11(g: Graph) -> DataFrame:
    """Truth words and eight-digit dates."""
    word = F.when(F.col("event_type") == "error", "Yes").otherwise("n")
    digits = F.date_format("ts", "yyyyMMdd")
    serious = F.upper(word).isin("Y", "YES", "1", "TRUE")
    received = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return g.events.select("event_id", serious.alias("serious"), received.alias("received"))


@query("nrm_12_trial_phases", "SELECT phase AS given, CASE phase WHEN 'Phase 1' THEN 'PHASE1' WHEN 'Phase 2' THEN 'PHASE2' WHEN 'Phase 3' THEN 'PHASE3' WHEN 'Phase 4' THEN 'PHASE4' ELSE 'NA' END AS phase, count(*) AS n FROM trial GROUP BY ALL")
def nrm_12(g: Graph) -> DataFrame:
    rows = g.trial.groupBy(F.col("phase").alias("given")).agg(F.count("*").alias("n"))
    number = F.regexp_extract("given", r"^Phase ([1-4])$", 1)
    return rows.select("given", F.when(number != "", F.concat(F.lit("PHASE"), number)).otherwise("NA").alias("phase"), "n")


@query(
    "nrm_15_approval_state",
    "SELECT c.id, CASE WHEN count(a.id) = 0 THEN 'Unknown' WHEN bool_or(a.status = 'approved') THEN 'Approved' ELSE 'Pending' END AS state FROM compound c LEFT JOIN approval a ON a.product = c.id GROUP BY c.id",
)
def nrm_15(g: Graph) -> DataFrame:
    """The state of each compound from all its approvals."""
    a = g.approval.groupBy(F.col("product").alias("id")).agg(F.collect_set("status").alias("statuses"))
    rows = g.compound.select("id").join(a, "id", "left")
    state = cases([(F.col("statuses").isNull(), "Unknown"), (F.exists("statuses", lambda s: s == "approved"), "Approved")], "Pending")
    return rows.select("id", state.alias("state"))


@query("txt_4_severity", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'contraindicated|severe|fatal|avoid') THEN 'major' WHEN regexp_matches(lower(text), 'moderate|monitor|caution') THEN 'moderate' WHEN regexp_matches(lower(text), 'minor|mild') THEN 'minor' ELSE 'unknown' END AS severity FROM documents")
def txt_4(g: Graph) -> DataFrame:
    return g.documents.select("doc_id", classify.first_rule(F.col("text"), classify.SEVERITY, "unknown").alias("severity"))


@query("txt_5_sentences", "SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), '.'), lambda s: regexp_matches(s, 'stupid|clown'))) AS n FROM documents")
def txt_5(g: Graph) -> DataFrame:
    """How many sentences hold a word of a list."""
    return g.documents.select("doc_id", F.size(classify.sentences(F.col("text"), "stupid|clown", 1_000_000)).cast("long").alias("n"))


@query("txt_6_names", r"SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"/([A-Za-z]+)\"', 1))) AS names FROM pages")
def txt_6(g: Graph) -> DataFrame:
    """The distinct names that pages link to."""
    return g.pages.select("page_id", F.size(classify.mentions(F.col("html"), '<a href="/([A-Za-z]+)"', 1)).cast("long").alias("names"))


@query("txt_12_last_part", "SELECT page_id, list_extract(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'), -1) AS place FROM pages")
def txt_12(g: Graph) -> DataFrame:
    """The last part of an address."""
    return g.pages.select("page_id", F.element_at(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\."), -1).alias("place"))


@query("ded_5_hashed_ids", "SELECT substring(md5(concat_ws('_', source, lang, n_chars)), 1, 16) AS id, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def ded_5(g: Graph) -> DataFrame:
    """The first document of each id made from its properties."""
    return g.documents.groupBy(F.substring(F.md5(F.concat_ws("_", "source", "lang", "n_chars")), 1, 16).alias("id")).agg(F.min("doc_id").alias("doc_id"))


@query("ded_6_new_only", "SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE source IN ('src0', 'src1'))")
def ded_6(g: Graph) -> DataFrame:
    """Documents whose content wasn't processed before."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    done = g.documents.filter("source IN ('src0', 'src1')").select(digest)
    return g.documents.select("doc_id", digest).join(done, "digest", "left_anti").select("doc_id")


@query("idm_1_categories", "SELECT CASE WHEN key % 5 = 0 THEN 'compound' WHEN key % 3 = 0 THEN 'target' WHEN key % 2 = 0 THEN 'disease' ELSE 'unknown' END AS kind, count(*) AS n FROM compound GROUP BY ALL")
def idm_1(g: Graph) -> DataFrame:
    """What a record is, by the first identifier that it has."""
    k = F.col("key")
    rows = g.compound.select(F.when(k % 5 == 0, k).alias("inchikey"), F.when(k % 3 == 0, k).alias("uniprot"), F.when(k % 2 == 0, k).alias("mondo"))
    kind = cases([(F.col(c).isNotNull(), name) for c, name in (("inchikey", "compound"), ("uniprot", "target"), ("mondo", "disease"))], "unknown")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("idm_5_coverage", "SELECT 'evidence_level' AS field, round(100.0 * count(evidence_level) / count(*), 4)::DOUBLE AS percent FROM associated UNION ALL SELECT 'disease', round(100.0 * count(disease) / count(*), 4)::DOUBLE FROM associated")
def idm_5(g: Graph) -> DataFrame:
    fields = ["evidence_level", "disease"]
    one = g.associated.agg(*[F.round(100.0 * F.count(f) / F.count("*"), 4).alias(f) for f in fields])
    return one.unpivot([], fields, "field", "percent")


@query("idm_6_loose_ids", r"SELECT s_suppkey, lower(regexp_replace(regexp_replace(replace('Fei//' || s_name || '--x', '/', '-'), '[^\w-]', '', 'g'), '-+', '-', 'g')) AS loose FROM supplier")
def idm_6(g: Graph) -> DataFrame:
    return g.supplier.select("s_suppkey", normalise.loose_id(F.concat(F.lit("Fei//"), "s_name", F.lit("--x"))).alias("loose"))


@query("dq_3_uniqueness", "SELECT count(*) AS keys, count(DISTINCT name) AS different, round((count(DISTINCT name)) * 1.0 / count(name), 6)::DOUBLE AS uniqueness FROM compound")
def dq_3(g: Graph) -> DataFrame:
    """How many of the keys are different, by two counts that combine before they shuffle."""
    n = g.compound.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("keys"), F.count("*").alias("different")).withColumn("uniqueness", F.round(F.col("different") / F.col("keys"), 6))


@query("dq_11_document_score", "SELECT doc_id, round((2.0 * ((text IS NOT NULL)::INT + (lang IS NOT NULL)::INT) + (n_chars > 1000)::INT) / 5, 4)::DOUBLE AS score FROM documents")
def dq_11(g: Graph) -> DataFrame:
    """Twice the required fields there are, and the recommended ones, out of all."""
    have = lambda c: c.cast("int")
    total = 2 * (have(F.col("text").isNotNull()) + have(F.col("lang").isNotNull())) + have(F.col("n_chars") > 1000)
    return g.documents.select("doc_id", F.round(total / 5.0, 4).alias("score"))


@query("snk_6_constraints", "SELECT 'part' AS label, 'unique' AS rule, count(*) - count(DISTINCT p_partkey) AS broken FROM part UNION ALL SELECT 'lineitem', 'unique', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'customer', 'exists', count(*) - count(c_name) FROM customer")
def snk_6(g: Graph) -> DataFrame:
    """Rows that break unique and existence constraints."""

    def unique(df: DataFrame, label: str, *keys: str) -> DataFrame:
        return df.groupBy(*keys).count().agg(F.lit(label).alias("label"), F.lit("unique").alias("rule"), (F.sum("count") - F.count("*")).alias("broken"))

    exists = g.customer.agg(F.lit("customer").alias("label"), F.lit("exists").alias("rule"), F.count_if(F.col("c_name").isNull()).alias("broken"))
    return unique(g.part, "part", "p_partkey").unionByName(unique(g.lineitem, "lineitem", "l_orderkey", "l_linenumber")).unionByName(exists)


@query("snk_13_import_counts", "SELECT label, count(*) AS n FROM node GROUP BY label HAVING count(*) > 0")
def snk_13(g: Graph) -> DataFrame:
    return g.node.groupBy("label").agg(F.count("*").alias("n"))


@query("set_4_not_loaded", "SELECT l_partkey AS key FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10")
def set_4(g: Graph) -> DataFrame:
    """Keys used that weren't loaded."""
    return g.lineitem.select(F.col("l_partkey").alias("key")).distinct().join(g.part.filter("p_size > 10").select(F.col("p_partkey").alias("key")), "key", "left_anti")


@query("set_3_area_overlap", "SELECT a.area AS left_area, b.area AS right_area, count(DISTINCT a.compound) AS shared FROM (SELECT DISTINCT t.compound, d.area FROM treats t JOIN disease d ON d.id = t.disease) a JOIN (SELECT DISTINCT t.compound, d.area FROM treats t JOIN disease d ON d.id = t.disease) b ON b.compound = a.compound AND a.area < b.area GROUP BY ALL")
def set_3(g: Graph) -> DataFrame:
    """Compounds that two areas share."""
    a = g.treats.join(g.disease.select(F.col("id").alias("disease"), "area"), "disease").select("compound", F.col("area").alias("left_area")).distinct()
    return a.join(a.select("compound", F.col("left_area").alias("right_area")), "compound").filter("left_area < right_area").groupBy("left_area", "right_area").agg(F.count("*").alias("shared"))
