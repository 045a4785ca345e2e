import json
import sqlite3

from lattica.sources import entities, readers


def test_studies_to_graph(spark, tmp_path):
    study = {"protocolSection": {
        "identificationModule": {"nctId": "NCT00000001", "briefTitle": "One"}, "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2020-02-03"}},
        "designModule": {"phases": ["PHASE3"], "enrollmentInfo": {"count": 12}}, "conditionsModule": {"conditions": ["Lung  Cancer", "Asthma"]},
        "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "Aspirin"}]}, "contactsLocationsModule": {"locations": [{"facility": "A", "city": "B", "country": "C"}]},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Acme"}},
    }}
    sparse = {"protocolSection": {"identificationModule": {"nctId": "NCT00000002"}}}
    (tmp_path / "a.json").write_text(json.dumps([study, sparse]))
    (tmp_path / "b.json").write_text(json.dumps({"other": 1}))
    rows = readers.studies(spark, str(tmp_path))
    assert {r.trial_id: (r.phase, r.enrollment) for r in rows.collect()} == {"NCT00000001": ("PHASE3", 12), "NCT00000002": (None, None)}
    assert readers.studies(spark, str(tmp_path), since="2021-01-01").count() == 0
    nodes, edges = entities.of_studies(rows)
    assert sorted(r.id for r in nodes.collect()) == ["condition:asthma", "condition:lung-cancer", "intervention:aspirin", "site:a-b", "sponsor:acme", "trial:NCT00000001", "trial:NCT00000002"]
    assert edges.groupBy("rel").count().count() == 4 and edges.count() == 5


def test_reports_to_graph(spark, tmp_path):
    (tmp_path / "DEMO20Q1.txt").write_text("safetyreportid$receivedate$serious\n1$20200131$Y\n2$20200201$N\n1$20200131$Y\n")
    (tmp_path / "DRUG20Q1.txt").write_text("safetyreportid$drugcharacterization$drugname\n1$1$ASPIRIN\n1$2$IBU PROFEN\n2$1$aspirin\n9$1$lost\n")
    (tmp_path / "REAC20Q1.txt").write_text("safetyreportid$reactionmeddraversionpt\n1$Head ache\n2$Nausea\n")
    path = str(tmp_path)
    demo = readers.delimited_reports(spark, path, "DEMO", "safetyreportid string, receivedate string, serious string")
    drug = readers.delimited_reports(spark, path, "DRUG", "safetyreportid string, drugcharacterization int, drugname string")
    reac = readers.delimited_reports(spark, path, "REAC", "safetyreportid string, reactionmeddraversionpt string")
    assert {r.file for r in demo.collect()} == {"DEMO20Q1.txt"}
    nodes, edges = entities.of_reports(demo, drug, reac)
    assert sorted((r.src, r.dst) for r in edges.filter("rel = 'CAUSED_ADVERSE_EVENT'").collect()) == [("compound:aspirin", "event:1"), ("compound:aspirin", "event:2")]
    assert {r.id: r.props.get("serious") for r in nodes.filter("label = 'AdverseEvent'").collect()} == {"event:1": "true", "event:2": "false"}
    assert nodes.filter("label = 'Compound'").count() == 2


def test_drugs_to_graph(spark, tmp_path):
    drug = lambda i, g: f"""<drug type="small"><drugbank-id primary="true">DB{i}</drugbank-id><drugbank-id>X</drugbank-id><name>N{i}</name><groups><group>{g}</group></groups><indication>pain</indication>
        <targets><target><id>T1</id><name>Cox</name><actions><action>inhibitor</action></actions></target></targets><drug-interactions><drug-interaction><drugbank-id>DB9</drugbank-id><name>x</name><description>d</description></drug-interaction></drug-interactions></drug>"""
    (tmp_path / "d.xml").write_text("<drugbank>" + drug(1, "approved") + drug(2, "withdrawn") + drug(3, "experimental") + "</drugbank>")
    rows = readers.drugs(spark, str(tmp_path / "d.xml"))
    assert sorted(r.id for r in rows.collect()) == ["DB1", "DB3"]
    nodes, edges = entities.of_drugs(rows)
    assert sorted((r.src, r.dst, r.rel) for r in edges.collect()) == [("drugbank:DB1", "drugbank:DB9", "INTERACTS_WITH"), ("drugbank:DB1", "target:T1", "INHIBITS"), ("drugbank:DB3", "drugbank:DB9", "INTERACTS_WITH"), ("drugbank:DB3", "target:T1", "INHIBITS")]
    assert nodes.count() == 3


def test_documents_json_sections_sqlite(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("Title é\nbody")
    (tmp_path / "t/b.txt").write_bytes("标题\n内容".encode("gbk"))
    docs = readers.text_documents(spark, str(tmp_path / "t")).collect()
    assert {d.title for d in docs} == {"Title é", "标题"} and all(len(d.sha256) == 64 for d in docs)
    (tmp_path / "j").mkdir()
    for name, x in {"a": [{"id": 1}], "b": {"data": [{"id": 2}, {"id": 3}]}, "c": {"results": [{"id": 4}]}, "d": {"id": 5}}.items():
        (tmp_path / f"j/{name}.json").write_text(json.dumps(x))
    assert sorted(r.id for r in readers.json_records(spark, str(tmp_path / "j"), "id: int").collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "k.txt").write_text("ENTRY       hsa1  Pathway\nNAME        Glyco\nGENE        10  A\n            11  B\n///\nENTRY       hsa2  Pathway\nNAME        Other\n///\n")
    found = {(r.entry, r.section): r.lines for r in readers.sections(spark, str(tmp_path / "k.txt")).collect()}
    assert found[("hsa1", "GENE")] == ["10  A", "11  B"] and found[("hsa2", "NAME")] == ["Other"]
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("CREATE TABLE m (id INTEGER PRIMARY KEY, name TEXT)")
        c.executemany("INSERT INTO m VALUES (?, ?)", [(i, f"n{i}") for i in range(1, 101)])
    rows = readers.sqlite_table(spark, str(tmp_path / "x.db"), "m", "id long, name string", parts=4)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 100 and rows.filter("id = 7").first().name == "n7"
