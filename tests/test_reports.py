import json

import pytest
from pyspark.sql import functions as F

from lattica.sources import pathway_maps, reports, results

TEXT = """This is PDA TR13 on rooms. The cleanroom of the plant is held at 21 °C and 45 %RH under ISO Class 5 with 20 air changes. The cleanroom of the plant is held at 21 °C and 45 %RH under ISO Class 7.
Each aseptic area needs EU GMP Grade A air and 15 Pa of pressure. Short hall. It follows ISO 5, ISO 14644-1, EU GMP Annex 1, FDA rules, USP <71> and EP 9.0!
A bioburden is taken daily; every particle count is made each shift, and the LAL test is run per batch. Steam sterilization is shown by media fill at 121 C for 15 min.
Fitted by Acme Freeze Systems and Box GmbH."""


@pytest.fixture(scope="module")
def read(spark):
    return reports.read_reports(spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "nothing of the kind " * 2000)], "doc_id long, text string").selectExpr("*", "1 AS number", "2 AS standards"))


def test_extracts(read):
    rows = {r["doc_id"]: r for r in read.collect()}
    one = rows[1]
    assert one["number"] == "TR13" and rows[3]["number"] == "doc 3"
    assert all(rows[i][c] == [] for i in (2, 3, 4) for c in ("facilities", "standards", "assays", "processes", "makers"))
    # two sentences that begin alike are one; too short sentences tell nothing
    assert [(f["kind"], f["name"], f["classification"], f["use"]) for f in one["facilities"]] == [("cleanroom", "cleanroom (TR13)", "ISO 5", "general"), ("aseptic area", "aseptic area (TR13)", "EU GMP Grade A", "aseptic_processing")]
    first, second = one["facilities"]
    assert (first["temperature_c"], first["humidity_percent"], first["air_changes_per_hour"], first["pressure_differential_pa"]) == ("21", "45", "20", None)
    assert second["pressure_differential_pa"] == "15" and second["temperature_c"] is None
    assert [s["name"] for s in one["standards"]] == ["ISO 5", "ISO 14644-1", "EU GMP", "EU GMP Annex 1", "FDA Guideline", "USP <71>", "European Pharmacopoeia 9.0"]
    assert {(a["kind"], a["name"], a["sampling"], a["frequency"]) for a in one["assays"]} == {("bioburden", "bioburden Test", "daily", "daily"), ("particle count", "particle count Test", "per_batch", "per_batch"), ("LAL", "LAL Test", "per_batch", "per_batch")}
    assert [(p["kind"], p["validation"]) for p in one["processes"]] == [("Steam sterilization", "media_fill_simulation"), ("media fill", "media_fill_simulation")]
    assert one["processes"][0]["critical"][0] == "121 C"
    assert len(one["makers"]) == 2 and one["makers"][0].endswith("GmbH") and one["makers"][1].endswith("Systems")


def test_links(read):
    links = {(r["src"], r["dst"], r["rel"]) for r in reports.report_links(read).collect()}
    assert ("cleanroom (TR13)", "ISO 5", "REQUIRES_STANDARD") in links and ("cleanroom (TR13)", "ISO 14644-1", "REQUIRES_STANDARD") not in links
    assert {d for s, d, r in links if s == "aseptic area (TR13)" and r == "REQUIRES_STANDARD"} == {"EU GMP", "EU GMP Annex 1"}
    assert ("particle count Test", "cleanroom (TR13)", "TEST_QUALITY") in links
    assert sum(r == "EQUIPPED_WITH" for _, _, r in links) == 4
    nodes, edges = reports.of_facility_reports(read)
    ids = {r["id"] for r in nodes.collect()}
    assert all(e["src"] in ids and e["dst"] in ids for e in edges.collect()) and nodes.count() == len(ids)


MAP = """<?xml version="1.0"?><pathway name="path:hsa1" org="hsa" number="1" title="One" link="x">
<entry id="1" name="hsa:10 hsa:11" type="gene"/><entry id="2" name="hsa:20" type="gene"/><entry id="3" name="cpd:C1" type="compound"/><entry id="4" name="path:hsa2" type="map"/>
<relation entry1="1" entry2="2" type="PPrel"><subtype name="inhibition" value="--|"/><subtype name="phosphorylation" value="+p"/></relation><relation entry1="1" entry2="9" type="PPrel"/>
<reaction id="7" name="rn:R1" type="reversible"><substrate id="3" name="cpd:C1"/><substrate id="5" name="cpd:C2"/><product id="6" name="cpd:C3"/></reaction></pathway>"""


def test_pathway_maps(spark, tmp_path):
    (tmp_path / "a.xml").write_text(MAP)
    (tmp_path / "b.xml").write_text('<pathway name="path:hsa3" title="Bare"></pathway>')
    read = pathway_maps.pathway_maps(spark, str(tmp_path))
    parsed = pathway_maps.parsed_maps(spark.createDataFrame([(MAP,), ("not xml",), (None,)], "text string"))
    assert read.count() == 2 and parsed.count() == 1
    for maps in (read, parsed):
        nodes, edges = pathway_maps.of_pathway_maps(maps)
        made = {(e["src"], e["dst"], e["rel"]) for e in edges.collect()}
        assert {("hsa:10", "hsa:20", "INHIBITS"), ("hsa:11", "hsa:20", "INHIBITS"), ("cpd:C1", "cpd:C3", "CONVERTED_TO"), ("cpd:C2", "cpd:C3", "CONVERTED_TO")} == {x for x in made if x[2] != "PARTICIPATES_IN"}
        assert {x[0] for x in made if x[2] == "PARTICIPATES_IN"} == {"hsa:10", "hsa:11", "hsa:20", "cpd:C1"}
        assert {r["id"] for r in nodes.filter("label = 'Target'").collect()} == {"hsa:10", "hsa:11", "hsa:20"}


def test_results(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "X", "A"), ("b", "X", "B"), ("c", "Y", None)], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "c", "S")], "src string, dst string, rel string")
    for form in ("json", "parquet"):
        for _ in range(2):
            results.write_results(nodes, edges, str(tmp_path / form), form)
        n, e, s = results.read_results(spark, str(tmp_path / form), form)
        assert sorted((r["id"], r["label"]) for r in n.collect()) == [("a", "X"), ("b", "X"), ("c", "Y")] and e.count() == 2
        assert sorted((r["kind"], r["type"], r["n"]) for r in s.collect()) == [("edge", "R", 1), ("edge", "S", 1), ("node", "X", 2), ("node", "Y", 1)]
    docs = spark.createDataFrame([(1, "fda", None), (2, "fda", "x"), (3, "ema", "x")], "doc_id long, agency string, area string")
    found = {(r["field"], r["value"]): (r["n"], r["rank"]) for r in results.document_statistics(docs, ["agency", "area"]).collect()}
    assert found == {("agency", "fda"): (2, 1), ("agency", "ema"): (1, 2), ("area", "x"): (2, 1), ("area", None): (1, 2)}
    results.write_documents(docs, ["agency"], str(tmp_path / "docs"))
    assert json.loads(next((tmp_path / "docs" / "metadata").glob("*.json")).read_text())["documents"] == 3
    tricky = spark.createDataFrame([('say "hi", you', 1)], "t string, n int")
    results.export(tricky, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()[0] == 'say "hi", you'
    results.export(tricky, str(tmp_path / "js"), "json")
    with pytest.raises(ValueError):
        results.export(tricky, str(tmp_path / "no"), "xls")
    assert docs.filter(F.col("area").isNull()).count() == 1
