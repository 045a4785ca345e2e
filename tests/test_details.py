import json

from lattica.sources import details

STUDY = {"protocolSection": {
    "identificationModule": {"nctId": "NCT1"}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Acme  Inc", "class": "INDUSTRY"}, "collaborators": [{"name": "Uni"}, {"name": None}], "responsibleParty": {"type": "SPONSOR_INVESTIGATOR", "investigatorFullName": "Jo Do", "name": "other"}},
    "contactsLocationsModule": {"centralContacts": [{"name": "Jo Do"}, {"name": "Al Fa"}]}, "outcomesModule": {"primaryOutcomes": [{"measure": "OS", "timeFrame": "1 y"}], "secondaryOutcomes": [{"measure": "PFS"}]},
    "eligibilityModule": {"eligibilityCriteria": "first line\nInclusion Criteria:\n\n - adult\n - well\nKey exclusion\n ill", "sex": "ALL", "healthyVolunteers": True},
    "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": " Aspirin "}, {"type": "Device", "name": "aspirin"}, {"type": "Drug", "name": "unknown"}]},
}}


def test_study_details(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([STUDY, {"protocolSection": {"identificationModule": {"nctId": "NCT2"}}}, {"protocolSection": {}}]))
    rows = details.study_details(spark, str(tmp_path))
    assert rows.count() == 2
    compounds = spark.createDataFrame([("P:2", "ASPIRIN"), ("P:1", "aspirin"), ("P:3", None)], "id string, name string")
    nodes, edges = details.of_study_details(rows, compounds)
    made = {(e["src"], e["dst"], e["rel"]) for e in edges.collect()}
    assert made == {
        ("trial:NCT1", "sponsor:acme-inc", "SPONSORED_BY"), ("trial:NCT1", "sponsor:uni", "SPONSORED_BY"), ("trial:NCT1", "investigator:jo-do", "HAS_PRINCIPAL_INVESTIGATOR"), ("trial:NCT1", "investigator:NCT1-1", "HAS_INVESTIGATOR"),
        ("trial:NCT1", "outcome:NCT1-primary-0", "HAS_OUTCOME"), ("trial:NCT1", "outcome:NCT1-secondary-0", "HAS_OUTCOME"), ("trial:NCT1", "eligibility:NCT1", "HAS_ELIGIBILITY"), ("P:1", "trial:NCT1", "TESTED_IN_CLINICAL_TRIAL"),
    }
    by = {n["id"]: n for n in nodes.collect()}
    assert by["eligibility:NCT1"]["props"]["inclusion"] == "- adult\n- well" and by["eligibility:NCT1"]["props"]["exclusion"] == "ill"
    assert by["sponsor:acme-inc"]["props"]["agency_class"] == "INDUSTRY" and by["outcome:NCT1-primary-0"]["props"]["time_frame"] == "1 y"
    assert details.of_study_details(rows)[1].count() == 7


DRUG = """<drugs><drug><drugbank-id>X9</drugbank-id><drugbank-id primary="true">DB1</drugbank-id><name>One</name><enzymes><enzyme><id>BE1</id><name>CYP</name><organism>Humans</organism><polypeptide><external-identifiers>
<external-identifier><resource>GenBank</resource><identifier>G</identifier></external-identifier><external-identifier><resource>UniProt</resource><identifier>P1</identifier></external-identifier></external-identifiers></polypeptide></enzyme><enzyme><name>no id</name></enzyme></enzymes>
<transporters><transporter><id>BT1</id></transporter></transporters><atc-codes><atc-code code="A01"/><atc-code code="B02"/></atc-codes><pharmacokinetics><half-life> 3  h </half-life></pharmacokinetics><ld50>5</ld50>
<drug-interactions><drug-interaction><drugbank-id>DB2</drugbank-id><description>Contraindicated: fatal</description></drug-interaction><drug-interaction><name>lost</name></drug-interaction></drug-interactions></drug>
<drug><name>without id</name></drug><drug><drugbank-id>DB3</drugbank-id></drug></drugs>"""


def test_drug_details(spark, tmp_path):
    (tmp_path / "a.xml").write_text(DRUG)
    rows = details.drug_details(spark, str(tmp_path))
    assert {r["id"]: (r["atc_codes"], r["properties"]) for r in rows.collect()} == {"DB1": (["A01", "B02"], {"half_life": "3 h", "ld50": "5"}), "DB3": ([], {})}
    nodes, edges = details.of_drug_details(rows)
    assert {(e["src"], e["dst"], e["rel"], e["props"].get("severity"), e["props"].get("kind")) for e in edges.collect()} == {
        ("drugbank:DB1", "target:P1", "METABOLIZED_BY", None, None), ("drugbank:DB1", "target:BT1", "TRANSPORTED_BY", None, None), ("drugbank:DB1", "drugbank:DB2", "INTERACTS_WITH", "major", "contraindication")
    }
    assert sorted(n["id"] for n in nodes.collect()) == ["drugbank:DB1", "drugbank:DB3", "target:BT1", "target:P1"]
