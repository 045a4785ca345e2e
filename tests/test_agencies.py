import itertools
import json

from pyspark.sql import functions as F

from lattica.functions import classify, normalise
from lattica.operators import algorithms, paths, records
from lattica.sources import agencies, readers


def written(tmp_path, records):
    (tmp_path / "r.json").write_text(json.dumps({"results": records}))
    return str(tmp_path)


def found(edges):
    return sorted((r.src, r.rel, r.dst) for r in edges.collect())


def test_applications(spark, tmp_path):
    one = {"application_number": "BLA1", "sponsor_name": "Acme Inc", "submissions": [{"submission_type": "ORIG", "submission_number": "1", "submission_status": "AP", "submission_status_date": "20200131"}], "products": [{"product_number": "001", "brand_name": "X", "dosage_form": "ORAL TABLET", "marketing_status": "Prescription", "active_ingredients": [{"name": "Drug A", "strength": "1 mg"}]}]}
    rows = readers.json_records(spark, written(tmp_path, [one, one, {"application_number": "NDA2"}, {"sponsor_name": "none"}]), agencies.APPLICATION)
    nodes, edges = agencies.of_applications(rows)
    props = {r.id: r.props for r in nodes.collect()}
    assert sorted(props) == ["Approval-BLA1", "Approval-NDA2", "Product-BLA1-001", "Submission-BLA1-ORIG1", "agency:fda", "compound:drug-a"]
    assert props["Approval-BLA1"]["kind"] == "BLA" and props["Approval-NDA2"]["products"] == "0"
    assert props["Product-BLA1-001"] == {"form": "Oral Tablet", "status": "RX"} and props["Submission-BLA1-ORIG1"]["on"] == "2020-01-31"
    assert ("Product-BLA1-001", "MANUFACTURED_BY", "manufacturer:acme-inc") in found(edges) and edges.count() == 7


def test_letters_shortages_and_empty(spark, tmp_path):
    letters = [{"letter_id": "7", "company_name": " Acme ", "application_number": ["NDA 12", " "], "approver_center": ["CDER"], "approver_name": "Al", "drugs": ["Drug A"], "text": "t"}, {"letter_id": None}]
    nodes, edges = agencies.of_letters(readers.json_records(spark, written(tmp_path, letters), agencies.LETTER))
    assert found(edges) == [("CRL-7", "ABOUT", "Submission-NDA12"), ("CRL-7", "ABOUT", "compound:drug-a"), ("CRL-7", "ISSUED_TO", "company:acme")]
    assert nodes.filter("label = 'Person'").count() == 0
    nothing = spark.createDataFrame([], agencies.SHORTAGE)
    nodes, edges = agencies.of_shortages(nothing)
    assert nodes.count() == 0 and edges.count() == 0


def test_products_of_xml(spark, tmp_path):
    one = lambda n, a, d: f"<product><product_number>{n}</product_number><appl_no>{a}</appl_no><applicant>Acme</applicant><approval_date>{d}</approval_date></product>"
    (tmp_path / "p.xml").write_text("<products>" + one(1, "ANDA1", "01/31/2020") + one(2, "N2", "31-Jan-2021") + one(3, "BLA3", "?") + "</products>")
    path = str(tmp_path / "p.xml")
    assert {r.product_number: r.kind for r in agencies.products(spark, path).collect()} == {"1": "ANDA", "2": "NDA", "3": "BLA"}
    assert [r.product_number for r in agencies.products(spark, path, sponsor="acme", first="2021-01-01").collect()] == ["2"]
    assert [r.product_number for r in agencies.products(spark, path, kind="ANDA", last="2020-12-31").collect()] == ["1"]


def test_proteins_labels_pathways(spark):
    protein = spark.createDataFrame([("Q1", "N", "g", [("1", "F:bind"), ("2", "P:grow")], [("D1", "One", "Biomarker"), (None, "Two x", None)], None), (None, "lost", None, None, None, None)], agencies.PROTEIN)
    nodes, edges = agencies.of_proteins(protein)
    assert found(edges) == [("uniprot:Q1", "ASSOCIATED_WITH_DISEASE", "disease:two-x"), ("uniprot:Q1", "BIOMARKER_FOR", "disease:D1")]
    label = spark.createDataFrame([("s", "Drug A", ["Pain"], None, [], ["Death"], ["HER2"], [" nausea", "Nausea"])], agencies.LABEL)
    assert {r.rel for r in agencies.of_labels(label)[1].collect()} == {"TREATS", "HAS_BOXED_WARNING", "HAS_BIOMARKER", "CAUSES_ADVERSE_EVENT"}
    pathway = spark.createDataFrame([("p1", "Lipid way", None, ["g"], ["c"], ["p2"])], agencies.PATHWAY)
    nodes, edges = agencies.of_pathways(pathway)
    assert {r.id: r.props.get("category") for r in nodes.collect()}["pathway:p1"] == "Metabolism" and edges.count() == 3


def test_normalisers_and_classes(spark):
    row = spark.range(1).select(
        normalise.target_id(F.lit("P12345AB"), F.lit("C"), F.lit("n")), normalise.target_id(F.lit("x"), F.lit(None).cast("string"), F.lit("A b")), normalise.species(F.lit("MUS  musculus")), normalise.protein_type(F.lit(None).cast("string")),
        normalise.shortage_status(F.lit(None).cast("string")), classify.agency(F.lit(None).cast("string"), F.lit("http://EMA.europa.eu/x"), F.lit("fda")), classify.agency(F.lit("PMDA"), F.lit("fda.gov"), F.lit("")),
    ).first()
    assert tuple(row) == ("uniprot:P12345AB", "target:a-b", "Mouse", "Protein", "unknown", "EMA", "PMDA")


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, x string, how string")
    new = spark.createDataFrame([(2,), (2,), (3,)], "id int")
    got = records.merged(old, new, "id", {"x": F.lit("n"), "how": F.lit("create")}, {"how": F.lit("match")})
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, "b", "match"), (3, "n", "create")]


def test_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", "R") for c in "abcd" for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0", "R"), ("b1", "c1", "R"), ("c2", "d2", "R"), ("d3", "a3", "R"), ("a1", "a1", "R")]
    edges = spark.createDataFrame(cliques, "src string, dst string, rel string")
    member = algorithms.communities(edges)
    groups = {}
    for r in member.collect():
        groups.setdefault(r.community, set()).add(r.id[0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"], ["c"], ["d"]]
    m = 2 * (len(cliques) - 1)
    assert abs(algorithms.modularity(edges, member).first()[0] - sum(20 / m - (22 / m) ** 2 for _ in range(4))) < 1e-12
    assert algorithms.communities(edges.limit(0)).count() == 0


def test_paths_between(spark):
    links = [("a", "b"), ("c", "b"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "d"), ("a", "d")]
    edges = spark.createDataFrame([(s, t, "R") for s, t in links], "src string, dst string, rel string")
    both = [(s, t, i) for i, (s, t) in enumerate(links)] + [(t, s, i) for i, (s, t) in enumerate(links) if s != t]
    wanted = []
    for n in (1, 2, 3):
        for walk in itertools.product(both, repeat=n):
            if walk[0][0] == "a" and walk[-1][1] == "d" and all(x[1] == y[0] for x, y in zip(walk, walk[1:])) and len({x[2] for x in walk}) == n:
                wanted.append("a" + "".join(x[1] for x in walk))
    assert sorted("".join(r.nodes) for r in paths.paths_between(edges, "a", "d", 3).collect()) == sorted(wanted)
