"""The pipelines of the five kinds of records, bound to the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import normalise
from lattica.operators.pipelines import Pipeline, report
from lattica.plans.binding import Graph
from lattica.plans.registry import query

_c = F.col


def pipelines(g: Graph) -> list[tuple[Pipeline, DataFrame]]:
    """Each pipeline with the records that it reads."""
    return [
        (
            Pipeline("Compound", "id", [("name", "name", None, normalise.text), ("inchikey", "id", None, None), ("smiles", "smiles", None, None), ("mass", "mass", None, None), ("key", "source_key", None, None)], ["source_key"], [("smiles", "ERROR", "REQUIRED", lambda: _c("smiles").isNull()), ("mass", "WARN", "RANGE", lambda: ~_c("mass").between(50, 700))]),
            g.structure,
        ),
        (
            Pipeline("ClinicalTrial", "id", [("id", "id", None, None), ("phase", "phase", "N/A", None), ("status", "status", "Unknown", normalise.text), ("enrollment", "enrollment", 0, None), ("start_date", "start_date", None, None), ("completed_on", "completed_on", None, None)], ["start_date"], [("phase", "ERROR", "NO_PHASE", lambda: (_c("status") == "Completed") & (_c("phase") == "N/A")), ("enrollment", "ERROR", "RANGE", lambda: _c("enrollment") < 50)]),
            g.trial,
        ),
        (
            Pipeline("Manufacturer", "name", [("name", "name", None, normalise.text), ("country", "country", "UNKNOWN", None), ("rating", "rating", None, None)], ["rating"], [("rating", "ERROR", "RANGE", lambda: _c("rating") < 0)]),
            g.manufacturer,
        ),
        (
            Pipeline("Submission", "id", [("id", "id", None, None), ("kind", "kind", None, None), ("agency", "agency", None, None), ("submitted", "submitted", None, None)], ["submitted"], [("kind", "ERROR", "ENUM", lambda: ~_c("kind").isin("NDA", "BLA", "ANDA", "sNDA"))]),
            g.submission,
        ),
        (
            Pipeline("RegulatoryDocument", "digest", [("text", "digest", None, lambda t: F.sha2(t, 256)), ("text", "snippet", None, normalise.snippet), ("lang", "language", "und", None), ("key", "doc_id", None, None)], ["doc_id"], [("snippet", "ERROR", "EMPTY", lambda: F.length("snippet") == 0)]),
            g.document,
        ),
    ]


@query(
    "orc_1_pipelines",
    """SELECT label, count(*) AS read, count(*) FILTER (NOT valid) AS rejected, count(*) FILTER (valid) - count(DISTINCT k) FILTER (valid) AS repeated, count(DISTINCT k) FILTER (valid) AS kept FROM (
        SELECT 'Compound' AS label, inchikey AS k, inchikey IS NOT NULL AND smiles IS NOT NULL AS valid FROM structure
        UNION ALL SELECT 'ClinicalTrial', id, NOT (status = 'Completed' AND phase = 'N/A' OR enrollment < 50) FROM trial UNION ALL SELECT 'Manufacturer', name, rating >= 0 FROM manufacturer
        UNION ALL SELECT 'Submission', id, kind <> 'OTHER' FROM submission UNION ALL SELECT 'RegulatoryDocument', sha256(text), text IS NOT NULL AND length(text) > 0 FROM document) GROUP BY label""",
)
def orc_1(g: Graph) -> DataFrame:
    """What each pipeline reads, rejects, drops as repeated and keeps."""
    return reduce(DataFrame.unionByName, [report(p, rows) for p, rows in pipelines(g)])
