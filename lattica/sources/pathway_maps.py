"""Maps of pathways in XML: entries, relations between them and reactions, to nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.entities import Graph, _edge, _node, _union, once

MAP = """_name STRING, _org STRING, _number STRING, _title STRING, _image STRING, _link STRING, entry ARRAY<STRUCT<_id: STRING, _name: STRING, _type: STRING>>,
    reaction ARRAY<STRUCT<_id: STRING, _name: STRING, _type: STRING, substrate: ARRAY<STRUCT<_name: STRING>>, product: ARRAY<STRUCT<_name: STRING>>>>,
    relation ARRAY<STRUCT<_entry1: STRING, _entry2: STRING, _type: STRING, subtype: ARRAY<STRUCT<_name: STRING, _value: STRING>>>>"""


def _flat(m: DataFrame) -> DataFrame:
    none = lambda c: F.coalesce(c, F.array())
    entries = F.transform(none(F.col("entry")), lambda e: F.struct(e["_id"].alias("entry"), F.split(e["_name"], r"\s+").alias("ids"), e["_type"].alias("type")))
    reactions = F.transform(none(F.col("reaction")), lambda r: F.struct(r["_id"].alias("id"), r["_name"].alias("name"), r["_type"].alias("type"), F.transform(none(r["substrate"]), lambda x: x["_name"]).alias("substrates"), F.transform(none(r["product"]), lambda x: x["_name"]).alias("products")))
    relations = F.transform(none(F.col("relation")), lambda r: F.struct(r["_entry1"].alias("entry1"), r["_entry2"].alias("entry2"), r["_type"].alias("type"), F.transform(none(r["subtype"]), lambda x: F.struct(x["_name"].alias("name"), x["_value"].alias("value"))).alias("subtypes")))
    return m.select(F.col("_name").alias("name"), F.col("_org").alias("org"), F.col("_number").alias("number"), F.col("_title").alias("title"), F.col("_link").alias("link"), entries.alias("entries"), reactions.alias("reactions"), relations.alias("relations"))


def pathway_maps(spark: SparkSession, path: str) -> DataFrame:
    """name, org, number, title, link, entries (entry, ids, type), reactions and relations of every <pathway> in files."""
    return _flat(spark.read.format("xml").option("rowTag", "pathway").schema(MAP).load(path))


def parsed_maps(rows: DataFrame, text: str = "text") -> DataFrame:
    """The same from a column of XML, one pathway a row; what isn't XML is left out."""
    m = F.from_xml(F.col(text), MAP, {"mode": "PERMISSIVE"})
    return _flat(rows.select(m.alias("m")).select("m.*").filter("_name is not null"))


def of_pathway_maps(maps: DataFrame) -> Graph:
    """Pathways, genes and compounds; what takes part in a pathway, what acts on what, and what is converted to what.

    An entry of several genes takes part with each. Relations whose entries are missing give nothing, as do null names.
    """
    pathway = F.concat(F.lit("pathway:"), "name")
    member = maps.select("name", F.explode("entries").alias("e")).filter("e.type IN ('gene', 'compound')").select("name", F.col("e.type").alias("type"), F.explode("e.ids").alias("id"))
    label = F.when(F.col("type") == "gene", "Target").otherwise("Compound")
    of = F.map_from_entries(F.transform(F.array_distinct(F.transform("entries", lambda e: e["entry"])), lambda i: F.struct(i, F.get(F.filter("entries", lambda e: e["entry"] == i), 0)["ids"])))
    acting = maps.withColumn("of", of).select("name", "of", F.explode("relations").alias("r"))
    acting = acting.select("name", F.col("r.type").alias("type"), F.array_join(F.transform("r.subtypes", lambda s: s["name"]), ",").alias("how"), F.explode(F.try_element_at("of", F.col("r.entry1"))).alias("src"), F.try_element_at("of", F.col("r.entry2")).alias("to"))
    acting = acting.select("name", "type", "how", "src", F.explode("to").alias("dst"))
    made = maps.select("name", F.explode("reactions").alias("x")).select("name", "x.name", "x.type", F.explode("x.substrates").alias("src"), F.col("x.products").alias("to"))
    made = made.toDF("name", "reaction", "type", "src", "to").select("reaction", "type", "src", F.explode("to").alias("dst"))

    def labelled(which: str, name: str) -> DataFrame:
        rows = member.filter(F.col("type") == which)
        return _node(rows, F.col("id"), name, F.col("id"))

    nodes = _union(_node(maps, pathway, "Pathway", F.col("title"), organism=F.col("org")), labelled("gene", "Target"), labelled("compound", "Compound"))
    edges = _union(
        _edge(member, F.col("id"), F.concat(F.lit("pathway:"), "name"), F.lit("PARTICIPATES_IN"), kind=label),
        _edge(acting, F.col("src"), F.col("dst"), _relation(F.col("how")), type=F.col("type"), pathway=F.col("name")),
        _edge(made, F.col("src"), F.col("dst"), F.lit("CONVERTED_TO"), reaction=F.col("reaction"), type=F.col("type")),
    )
    return once(nodes), edges


def _relation(how: Column) -> Column:
    """The type of an edge from the names of a relation's subtypes."""
    return F.when(how.contains("inhibition"), "INHIBITS").when(how.contains("activation"), "ACTIVATES").when(how.contains("binding"), "BINDS_TO").otherwise("RELATED_TO")
