"""Details of one node, filters by group and activity, and identifiers looked up in a cross-reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.cypher import asc, desc
from lattica.operators import paths
from lattica.plans.binding import Graph
from lattica.plans.registry import query


@query(
    "api_3_compound_detail",
    """SELECT s.id, s.name, s.smiles, s.inchikey, round(s.mass, 3)::DOUBLE AS mass, c.stage, (SELECT count(DISTINCT target) FROM acts_on WHERE compound = 'P:12') AS targets, (SELECT count(*) FROM trial_compound WHERE compound = 'P:12') AS trials FROM structure s JOIN compound c ON c.id = s.id WHERE s.id = 'P:12'""",
)
def api_3(g: Graph) -> DataFrame:
    """A compound with its structure, stage, and how many targets and trials it has."""
    s = g.at("structure", "id", "P:12").select("id", "name", "smiles", "inchikey", F.round("mass", 3).alias("mass"))
    stage = g.compound.filter("id = 'P:12'").select("id", "stage")
    targets = g.at("acts_on", "compound", "P:12").agg(F.count_distinct("target").alias("targets"))
    trials = g.at("trial_compound", "compound", "P:12").agg(F.count("*").alias("trials"))
    return s.join(stage, "id").join(F.broadcast(targets)).join(F.broadcast(trials))  # one row each


@query("api_4_compound_targets", "SELECT a.target, t.name, a.rel, a.pchembl FROM acts_on a JOIN target t ON t.id = a.target WHERE a.compound = 'P:12' ORDER BY a.pchembl DESC NULLS FIRST, a.target, a.rel LIMIT 50")
def api_4(g: Graph) -> DataFrame:
    """The fifty targets that a compound acts on most strongly."""
    own = g.at("acts_on", "compound", "P:12").orderBy(desc("pchembl"), asc("target"), asc("rel")).limit(50)
    return own.join(g.target.select(F.col("id").alias("target"), "name"), "target").select("target", "name", "rel", "pchembl")


@query(
    "api_8_path_by_types",
    """WITH s AS (SELECT min(id) AS id FROM compound), e AS (SELECT DISTINCT src, dst FROM link), w AS (SELECT min(pathway) AS id FROM pathway_target), u AS (SELECT * FROM e UNION SELECT dst, src FROM e)
    SELECT 2 AS length, concat(s.id, '>', min(a.dst), '>', w.id) AS path FROM s, w, u a JOIN u b ON b.src = a.dst WHERE a.src = s.id AND b.dst = w.id GROUP BY s.id, w.id""",
)
def api_8(g: Graph) -> DataFrame:
    """A shortest path between the first nodes of two kinds, as asked for by kind instead of by id."""
    first = g.compound.agg(F.min("id").alias("a")).join(F.broadcast(g.pathway_target.agg(F.min("pathway").alias("b")))).first()  # two ids
    return paths.shortest_path(g.link, first["a"], first["b"]).select("length", F.array_join("nodes", ">").alias("path"))


@query("cl_9_outcomes", "SELECT id, kind, measure FROM outcome WHERE trial = 'T:7' ORDER BY CASE kind WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 ELSE 3 END, id, measure")
def cl_9(g: Graph) -> DataFrame:
    """A trial's outcomes, primary ones first; the rank isn't returned."""
    rank = F.when(F.col("kind") == "primary", 1).when(F.col("kind") == "secondary", 2).otherwise(3)
    return g.at("outcome", "trial", "T:7").orderBy(rank, "id", "measure").select("id", "kind", "measure")


@query("rg_8_inspection", "SELECT i.id, i.kind, i.result, m.name AS manufacturer, m.country FROM inspection i LEFT JOIN manufacturer m ON m.id = i.manufacturer WHERE i.kind = 'for_cause'")
def rg_8(g: Graph) -> DataFrame:
    """Inspections for cause with who was inspected."""
    m = g.manufacturer.select(F.col("id").alias("manufacturer"), "name", "country")
    rows = g.inspection.filter("kind = 'for_cause'").select("id", "kind", "result", "manufacturer").join(m, "manufacturer", "left")
    return rows.select("id", "kind", "result", F.col("name").alias("manufacturer"), "country")


@query("flt_10_groups", "SELECT id, stage FROM compound WHERE stage IN ('approved', 'phase_3') AND size % 7 <> 0")
def flt_10(g: Graph) -> DataFrame:
    """Compounds by groups that are wanted and groups that aren't."""
    groups = F.array_compact(F.array("stage", F.when(F.col("size") % 7 == 0, "withdrawn")))
    wanted, unwanted = F.array(F.lit("approved"), F.lit("phase_3")), F.array(F.lit("withdrawn"), F.lit("illicit"))
    return g.compound.filter(F.arrays_overlap(groups, wanted) & ~F.arrays_overlap(groups, unwanted)).select("id", "stage")


@query("flt_12_potent", "SELECT compound, target, rel FROM acts_on WHERE pchembl >= 8")
def flt_12(g: Graph) -> DataFrame:
    """Pairs at or above an activity; those without one fall out. The value isn't returned: the engines round its halves differently."""
    return g.acts_on.filter("pchembl >= 8").select("compound", "target", "rel")


@query(
    "idm_3_cross_references",
    """WITH x AS (SELECT uniprot, concat('registry_a=X', substring(uniprot, 3)) AS known FROM protein WHERE CAST(substring(uniprot, 3) AS BIGINT) % 2 = 0 UNION ALL SELECT uniprot, concat('registry_b=Y', substring(uniprot, 3)) FROM protein WHERE CAST(substring(uniprot, 3) AS BIGINT) % 3 = 0)
    SELECT p.id, string_agg(x.known, ',' ORDER BY x.known) AS known FROM protein p LEFT JOIN x ON x.uniprot = p.uniprot GROUP BY p.id""",
)
def idm_3(g: Graph) -> DataFrame:
    """What other registries call a protein, by its accession; null where none knows it."""
    number = F.substring("uniprot", 3, 20)
    table = g.protein.filter("uniprot is not null").select("uniprot", F.array_compact(F.array(F.when(number.cast("long") % 2 == 0, F.concat(F.lit("registry_a=X"), number)), F.when(number.cast("long") % 3 == 0, F.concat(F.lit("registry_b=Y"), number)))).alias("known"))
    known = table.filter(F.size("known") > 0).select("uniprot", F.array_join("known", ",").alias("known"))
    return g.protein.select("id", "uniprot").join(known, "uniprot", "left").select("id", "known")
