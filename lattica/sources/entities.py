"""Entity building: nested source records to nodes and edges.

Each builder gives (nodes, edges): nodes (id, label, name, props) and edges (src, dst, rel, props).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.normalise import slug, text

Graph = tuple[DataFrame, DataFrame]


def _node(rows: DataFrame, key: Column, label: str, name: Column, **props: Column) -> DataFrame:
    made = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]) if props else F.create_map().cast("map<string,string>")
    return rows.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"), made.alias("props")).filter("id IS NOT NULL")


def _edge(rows: DataFrame, src: Column, dst: Column, rel: Column, **props: Column) -> DataFrame:
    made = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]) if props else F.create_map().cast("map<string,string>")
    return rows.select(src.alias("src"), dst.alias("dst"), rel.alias("rel"), made.alias("props")).filter("src IS NOT NULL AND dst IS NOT NULL")


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def once(nodes: DataFrame) -> DataFrame:
    """Nodes once each: by id, the first name in order (maps can't be compared, so props come with it)."""
    return nodes.groupBy("id", "label").agg(F.min_by(F.struct("name", "props"), F.coalesce("name", F.lit(""))).alias("n")).select("id", "label", "n.name", "n.props")


def of_studies(studies: DataFrame) -> Graph:
    """Trials, conditions, interventions, sites and sponsors."""
    trial = F.concat(F.lit("trial:"), "trial_id")
    c = studies.select("trial_id", F.explode("conditions").alias("c"))
    i = studies.select("trial_id", F.explode("interventions").alias("i"))
    s = studies.select("trial_id", F.explode("locations").alias("l"))
    condition, item = F.concat(F.lit("condition:"), slug(F.col("c"))), F.concat(F.lit("intervention:"), slug(F.col("i.name")))
    site, sponsor = F.concat(F.lit("site:"), slug(F.concat_ws(" ", "l.facility", "l.city"))), F.concat(F.lit("sponsor:"), slug(F.col("sponsor")))
    nodes = _union(
        _node(studies, trial, "ClinicalTrial", F.col("title"), status=F.col("status"), phase=F.col("phase"), enrollment=F.col("enrollment")),
        _node(c, condition, "Condition", text(F.col("c"))),
        _node(i, item, "Intervention", text(F.col("i.name")), type=F.col("i.type")),
        _node(s, site, "StudySite", F.col("l.facility"), city=F.col("l.city"), country=F.col("l.country")),
        _node(studies, sponsor, "Sponsor", F.col("sponsor")),
    )
    edges = _union(
        _edge(c, trial, condition, F.lit("STUDIES_CONDITION")),
        _edge(i, trial, item, F.lit("TESTS_INTERVENTION")),
        _edge(s, trial, site, F.lit("CONDUCTED_AT_SITE")),
        _edge(studies, trial, sponsor, F.lit("SPONSORED_BY")),
    )
    return once(nodes), edges


def of_reports(demo: DataFrame, drug: DataFrame, reaction: DataFrame) -> Graph:
    """Adverse-event reports: events, compounds and conditions; only suspected drugs caused the event.

    Reports come once (the first row of an id by its own order of columns); drugs and reactions join by the report.
    """
    demo = demo.dropDuplicates(["safetyreportid"])
    event = F.concat(F.lit("event:"), "safetyreportid")
    serious = F.upper("serious").isin("Y", "YES", "1", "TRUE")
    compound, term = F.concat(F.lit("compound:"), slug(F.col("drugname"))), F.concat(F.lit("condition:"), slug(F.col("reactionmeddraversionpt")))
    day = F.concat_ws("-", F.substring("receivedate", 1, 4), F.substring("receivedate", 5, 2), F.substring("receivedate", 7, 2))
    known_drug, known_reaction = drug.join(demo.select("safetyreportid"), "safetyreportid", "left_semi"), reaction.join(demo.select("safetyreportid"), "safetyreportid", "left_semi")
    nodes = _union(
        _node(demo, event, "AdverseEvent", F.col("safetyreportid"), serious=serious, received=day),
        _node(known_drug, compound, "Compound", F.initcap(text(F.col("drugname")))),
        _node(known_reaction, term, "Condition", text(F.col("reactionmeddraversionpt"))),
    )
    edges = _union(
        _edge(known_drug.filter("drugcharacterization = 1"), compound, event, F.lit("CAUSED_ADVERSE_EVENT")),
        _edge(known_reaction, event, term, F.lit("ASSOCIATED_WITH")),
    )
    return once(nodes), edges


def of_drugs(drugs: DataFrame) -> Graph:
    """Compounds, targets and interactions of drug records; an action gives the type of its edge."""
    from lattica.functions.normalise import edge_type

    compound = F.concat(F.lit("drugbank:"), "id")
    t = drugs.select("id", F.explode("targets").alias("t"))
    x = drugs.select("id", F.explode("interactions").alias("x"))
    target = F.concat(F.lit("target:"), F.col("t.id"))
    action = F.coalesce(F.get(F.col("t.actions.action"), 0), F.lit(""))
    nodes = _union(_node(drugs, compound, "Compound", F.col("name"), indication=F.col("indication")), _node(t, target, "Target", F.col("t.name")))
    edges = _union(
        _edge(t, compound, target, edge_type(action), action=action),
        _edge(x, compound, F.concat(F.lit("drugbank:"), F.col("x.`drugbank-id`")), F.lit("INTERACTS_WITH"), description=F.col("x.description")),
    )
    return once(nodes), edges
