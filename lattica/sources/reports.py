"""Technical reports on facilities as text: what they say of facilities, standards, assays, processes and makers of equipment.

Everything of a report is found in one projection over its row, by patterns in the JVM; nothing is shuffled before nodes are
made once each. A report's extracts are arrays in the order of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.entities import Graph, _edge, _node, _union, once

#: Patterns of report numbers, facilities, processes, assays, frequencies and makers, in order; the first group names what is found.
REPORT_NUMBER = r"(?i)\bPDA\s*TR(\d+)\b"
FACILITIES = (
    r"(?i)\b(clean\s*room|cleanroom)\b",
    r"(?i)\b(manufactur(?:ing|e)\s*area|production\s*area)\b",
    r"(?i)\b(packag(?:ing|e)\s*area|packing\s*area)\b",
    r"(?i)\b(aseptic\s*(?:area|room|suite))\b",
    r"(?i)\b(stor(?:age|e)\s*area|warehouse)\b",
    r"(?i)\b(corridor|passage|hall)\b",
    r"(?i)\b(chang(?:ing|e)\s*room|gown\s*room)\b",
)
PROCESSES = (
    r"(?i)\b(moist\s*heat\s*sterilization|steam\s*sterilization)\b",
    r"(?i)\b(dry\s*heat\s*sterilization)\b",
    r"(?i)\b(gamma\s*irradiation|gamma\s*sterilization)\b",
    r"(?i)\b(ethylene\s*oxide|ETO)\s*sterilization\b",
    r"(?i)\b(filtration|steriliz(?:ing|e)\s*filtration)\b",
    r"(?i)\b(fill(?:ing|e)|aseptic\s*fill)\b",
    r"(?i)\b(lyophilization|freeze\s*drying)\b",
    r"(?i)\b(inspect(?:ion|e)|visual\s*inspect(?:ion|e))\b",
    r"(?i)\b(media\s*fill|process\s*simulation)\b",
    r"(?i)\b(clean(?:ing|e)|sanitiz(?:ation|e))\b",
)
ASSAYS = (
    r"(?i)\b(microbio(?:logical|logic)\s*(?:test|examination|analysis))\b",
    r"(?i)\b(endotoxin|LAL)\s*test\b",
    r"(?i)\b(sterylity|sterile)\s*test\b",
    r"(?i)\b(particle\s*(?:count|test)|particulate)\b",
    r"(?i)\b(bioburden)\b",
    r"(?i)\b(HPLC|UPLC|LC)\b",
    r"(?i)\b(GC|gas\s*chromatography)\b",
    r"(?i)\b(FTIR|IR)\s*(?:spectroscopy)?\b",
    r"(?i)\b(visibility|clarity)\s*test\b",
    r"(?i)\b(pH)\s*(?:determination|measurement)?\b",
    r"(?i)\b(osmolality|osmolarity)\b",
)
FREQUENCIES = (
    r"(?i)\b(once|per batch|batch-wise)\b",
    r"(?i)\b(daily|every day)\b",
    r"(?i)\b(weekly|every week)\b",
    r"(?i)\b(monthly|every month)\b",
    r"(?i)\b(quarterly|every quarter|every 3 months)\b",
    r"(?i)\b(annually|yearly|every year)\b",
    r"(?i)\b(per shift|each shift)\b",
    r"(?i)\b(continuous|continuously|on-line)\b",
)
MAKERS = (
    r"\b([A-Z][a-zA-Z0-9\s&\-]+(?:Corporation|Corp|Inc|LLC|Ltd|GmbH|AG|SA|S\.p\.A))\b",
    r"\b([A-Z][a-zA-Z0-9\s&\-]+(?:Technologies|Systems|Equipment|Machinery|Engineering))\b",
)
#: Standards as (pattern, name before the number, name after it, kind); the number may lack in all but the first.
STANDARDS = (
    (r"(?i)\bISO\s*(\d+(?:-\d+)?)\b", "ISO ", "", "international"),
    (r"(?i)\bEU\s*GMP(?:\s*Annex\s+(\d+|[A-Z]))?\b", "EU GMP Annex ", "", "regional"),
    (r"(?i)\bFDA\b()", "FDA Guideline", "", "regulatory"),
    (r"(?i)\bUSP\b(?:\s*<(\d+(?:-\d+)?)>)?", "USP <", ">", "pharmacopoeia"),
    (r"(?i)\b(?:European\s*Pharmacopoeia|EP)\b\s*(\d+(?:\.\d+)?)?", "European Pharmacopoeia ", "", "pharmacopoeia"),
    (r"(?i)\bASTM\s*(?:E|F)?(\d+(?:-\d+)?)?\b", "ASTM ", "", "testing"),
)
#: Words that tell a use, a validation and a sampling plan, the first that fits decides.
USES = (("aseptic_processing", "aseptic|sterile"), ("manufacturing", "manufacturing|production"), ("packaging", "packaging"), ("storage", "storage|warehous"), ("personnel_facility", "changing|gown"))
VALIDATIONS = (("media_fill_simulation", "media fill|process simulation"), ("challenge_study", "challenge study"), ("worst_case_validation", "worst case"), ("parametric_release", "parametric release"))
SAMPLING = (("per_batch", "per batch"), ("per_shift", "each shift"), ("daily", "daily"), ("weekly", "weekly"))
#: How many of its kind an entity is linked with at most, the first in the text.
MOST_STANDARDS, MOST_ASSAYS, MOST_MAKERS, MOST_VALIDATIONS = 3, 5, 3, 2


def _first(c: Column, pattern: str) -> Column:
    """The first group of a pattern's first match; null without one."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _by(c: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    out = None
    for name, words in rules:
        out = F.when(F.lower(c).rlike(words), name) if out is None else out.when(F.lower(c).rlike(words), name)
    return out.otherwise(otherwise)


def clean_class(c: Column) -> Column:
    """The class of a clean room that a sentence names, ISO before EU GMP grades before other grades; empty without one."""
    iso, gmp, grade = _first(c, r"(?i)\bISO\s*(?:Class\s*)?(\d+)\b"), _first(c, r"(?i)\bEU\s*GMP\s*Grade\s*([A-D])\b"), _first(c, r"\bGrade\s*([A-D])\b")
    return F.coalesce(F.concat(F.lit("ISO "), iso), F.concat(F.lit("EU GMP Grade "), gmp), F.concat(F.lit("Grade "), grade), F.lit(""))


def frequency(c: Column) -> Column:
    """How often something is done, the first pattern that fits, in lower case with underscores."""
    return F.coalesce(*[F.replace(F.lower(_first(c, p)), F.lit(" "), F.lit("_")) for p in FREQUENCIES], F.lit("as_required"))


def requirements(c: Column) -> dict[str, Column]:
    """Values that a sentence asks of the air: text, null where it says nothing."""
    return {
        "temperature_c": _first(c, r"(\d{2})\s*[°-]?\s*C\b"),
        "humidity_percent": _first(c, r"(\d+)\s*%?\s*RH?\b"),
        "microbial_limit_cfu": _first(c, r"(?i)(?:≥|>=|not more than)\s*(\d+)\s*CFU/(?:m³|ft³)"),
        "air_changes_per_hour": _first(c, r"(?i)(\d+)\s*(?:air changes|ACH)\b"),
        "pressure_differential_pa": _first(c, r"(\d+(?:\.\d+)?)\s*Pa(?:scal)?\b"),
    }


def _told(text: Column, stops: str, least: int, patterns: tuple[str, ...], make) -> Column:
    """make(type, sentence) for what patterns find in sentences of some length; once for each type and beginning of a sentence."""
    sentences = F.filter(F.transform(F.split(text, stops), lambda s: F.trim(s)), lambda s: F.length(s) >= least)

    def of(s: Column) -> Column:
        found = F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in patterns])
        return F.transform(found, lambda kind: F.struct(F.concat(kind, F.lit("_"), F.left(s, F.lit(50))).alias("key"), kind.alias("kind"), s.alias("sentence")))

    every = F.flatten(F.transform(sentences, of))
    keys = F.transform(every, lambda x: x["key"])
    return F.transform(F.filter(every, lambda x, i: F.array_position(keys, x["key"]) == i + 1), lambda x: make(x["kind"], x["sentence"]))


def read_reports(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number, facilities, standards, assays, processes, makers of every report; null and empty texts have empty arrays.

    facilities: kind, name, classification, use and the requirements; assays: kind, name, sampling, frequency; processes:
    kind, name, validation, critical (up to five values with units); standards: name, kind; makers: names.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.concat(F.lit("TR"), _first(c, REPORT_NUMBER)), F.concat(F.lit("doc "), F.col(key).cast("string")))

    def facility(kind: Column, s: Column) -> Column:
        asked = [v.alias(k) for k, v in requirements(s).items()]
        return F.struct(kind.alias("kind"), F.concat(kind, F.lit(" ("), number, F.lit(")")).alias("name"), clean_class(s).alias("classification"), _by(s, USES, "general").alias("use"), *asked)

    def assay(kind: Column, s: Column) -> Column:
        return F.struct(kind.alias("kind"), F.concat(kind, F.lit(" Test")).alias("name"), _by(s, SAMPLING, "as_required").alias("sampling"), frequency(s).alias("frequency"))

    def process(kind: Column, s: Column) -> Column:
        critical = F.slice(F.regexp_extract_all(s, F.lit(r"(\d+(?:\.\d+)?\s*[°C%FPa|m³Lin]+)\b"), F.lit(1)), 1, 5)
        return F.struct(kind.alias("kind"), F.concat(kind, F.lit(" Process")).alias("name"), _by(s, VALIDATIONS, "standard_validation").alias("validation"), critical.alias("critical"))

    def named(pattern: str, before: str, after: str, kind: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        bare = before.strip(" <").removesuffix(" Annex")
        name = lambda n: F.when(n == "", bare).otherwise(F.concat(F.lit(before), n, F.lit(after)))
        return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda n: F.struct(name(n).alias("name"), F.lit(kind).alias("kind")))

    standards = F.array_distinct(F.concat(*[named(*s) for s in STANDARDS]))
    makers = F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in MAKERS]), lambda m: F.trim(m)))
    return docs.select(
        F.col(key), number.alias("number"), _told(c, r"[.!?]+", 20, FACILITIES, facility).alias("facilities"), standards.alias("standards"), _told(c, r"[.!?;]+", 15, ASSAYS, assay).alias("assays"),
        _told(c, r"[.!?]+", 20, PROCESSES, process).alias("processes"), makers.alias("makers"),
    )


def _fitting_assays(name: Column, most: int) -> Column:
    """The assays that fit what is named: microbes for what is sterile, particles for clean rooms."""
    low = F.lower(name)
    wanted = F.when(low.rlike("aseptic|sterile"), "microbial|sterility|endotoxin").when(low.rlike("clean|room"), "particle")
    return F.slice(F.filter("assays", lambda a: F.coalesce(F.rlike(F.lower(a["kind"]), wanted), F.lit(False))), 1, most)


def report_links(reports: DataFrame) -> DataFrame:
    """number, src, dst, rel, confidence: links within each report of read_reports()."""
    f, p = F.explode("facilities").alias("f"), F.explode("processes").alias("p")
    of = reports.select("number", "standards", "assays", "makers", f)
    iso = F.regexp_extract("f.classification", r"ISO (\d+)", 1)
    fits = lambda s: ((iso != "") & s["name"].startswith(F.concat(F.lit("ISO "), iso))) | ((F.col("f.use") == "aseptic_processing") & s["name"].rlike("Annex 1|GMP"))
    link = lambda rows, src, dst, rel, sure: rows.select("number", src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.lit(sure).alias("confidence"))
    name = F.col("f.name")
    s = of.select("number", "f", F.explode(F.slice(F.filter("standards", fits), 1, MOST_STANDARDS)).alias("to"))
    a = of.select("number", "f", F.explode(_fitting_assays(name, MOST_ASSAYS)).alias("to"))
    m = of.select("number", "f", F.explode(F.slice("makers", 1, MOST_MAKERS)).alias("to"))
    v = reports.select("number", "assays", p)
    v = v.select("number", "p", F.explode(_fitting_assays(F.col("p.name"), MOST_VALIDATIONS)).alias("to"))
    return (
        link(s, name, F.col("to.name"), "REQUIRES_STANDARD", 0.75)
        .unionByName(link(a, F.col("to.name"), name, "TEST_QUALITY", 0.70))
        .unionByName(link(m, name, F.col("to"), "EQUIPPED_WITH", 0.65))
        .unionByName(link(v, F.col("p.name"), F.col("to.name"), "VALIDATED_BY", 0.70))
    )


def of_facility_reports(reports: DataFrame) -> Graph:
    """Nodes of what reports tell of, and the links among them; the same name is one node."""
    kinds = [("facilities", "Facility", ["classification", "use", "temperature_c", "humidity_percent"]), ("standards", "QualityStandard", ["kind"]), ("assays", "Assay", ["kind", "sampling", "frequency"]), ("processes", "Process", ["kind", "validation"])]
    key = lambda label, name: F.concat(F.lit(f"{label.lower()}:"), F.lower(name))
    parts = []
    for column, label, props in kinds:
        rows = reports.select(F.explode(column).alias("x"))
        name = F.col("x.name")
        parts.append(_node(rows, key(label, name), label, name, **{p: F.col(f"x.{p}") for p in props}))
    makers = reports.select(F.explode("makers").alias("x"))
    parts.append(_node(makers, key("Manufacturer", F.col("x")), "Manufacturer", F.col("x")))
    links = report_links(reports)
    ends = {"REQUIRES_STANDARD": ("Facility", "QualityStandard"), "TEST_QUALITY": ("Assay", "Facility"), "EQUIPPED_WITH": ("Facility", "Manufacturer"), "VALIDATED_BY": ("Process", "Assay")}
    edges = _union(*[_edge(links.filter(F.col("rel") == rel), key(a, F.col("src")), key(b, F.col("dst")), F.col("rel"), confidence=F.col("confidence"), report=F.col("number")) for rel, (a, b) in ends.items()])
    return once(_union(*parts)), edges
