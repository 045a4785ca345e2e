"""Normalisers for source records: each takes and gives columns, and yields null for what it can't read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.cypher import lookup

DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyyMMdd")
UNITS = (" nM", " μM", " mM", " M", " mg", " kg")
#: Dates as agencies write them, states of marketing, species.
AGENCY_DATES = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$", "dd-MMM-yyyy": r"^\d{2}-[A-Z][a-z]{2}-\d{4}$", "yyyyMMdd": r"^\d{8}$"}
MARKETING = {"Prescription": "RX", "Over-the-counter": "OTC", "Discontinued": "DISCONTINUED"}
SPECIES = {"homo sapiens": "Human", "mus musculus": "Mouse", "rattus norvegicus": "Rat", "danio rerio": "Zebrafish", "drosophila melanogaster": "Fruit fly"}
PROTEIN_TYPES = (("enzyme", "Enzyme"), ("receptor", "Receptor"), ("channel", "IonChannel"), ("transporter", "Transporter"), ("factor", "TranscriptionFactor"))
PHASES = {"0": "preclinical", "1": "phase_1", "2": "phase_2", "3": "phase_3", "4": "approved", "APPROVED": "approved", "LAUNCHED": "approved"}


def text(c: Column) -> Column:
    """Trimmed, with white space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date by the first format that fits; day before month where both would."""
    c = F.trim(c)
    strict = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$", "yyyyMMdd": r"^\d{8}$"}
    return F.coalesce(*[F.when(c.rlike(strict[f]), F.try_to_date(c, f)) for f in formats])


def choice(c: Column, values: dict, otherwise: object = None) -> Column:
    """A value by its lower-case key."""
    return lookup(F.lower(F.trim(c)), values, otherwise)


def number(c: Column) -> Column:
    """A number, whose unit is taken off unconverted and in which ×10^ is an exponent."""
    out = c
    for unit in UNITS:
        out = F.regexp_replace(out, f"{unit}$", "")
    return F.regexp_replace(F.trim(out), r"\s*×\s*10\^", "e").try_cast("double")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def compound_id(inchikey: Column, source: Column, source_id: Column, name: Column) -> Column:
    """inchikey:… before source:id before compound:slug."""
    by_source = F.concat(F.lower(source), F.lit(":"), source_id)
    return F.coalesce(F.concat(F.lit("inchikey:"), inchikey), by_source, F.concat(F.lit("compound:"), slug(name)))


def phase(c: Column) -> Column:
    return lookup(F.upper(F.trim(c)), PHASES, None)


def edge_type(activity: Column) -> Column:
    """The relation that an activity's text stands for, by the first keyword in order."""
    a = F.lower(activity)
    return F.when(a.rlike("inhibit|ic50|ki"), "INHIBITS").when(a.rlike("activate|ec50"), "ACTIVATES").otherwise("BINDS_TO")


def loose_id(c: Column) -> Column:
    """An identifier without what sources write differently: slashes, punctuation, repeats, case."""
    out = F.regexp_replace(F.regexp_replace(c, "/", "-"), r"[^\w-]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(out, "-+", "-"), "_+", "_"))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("DOC-"), F.substring(F.md5(path), 1, 8))


def snippet(content: Column, length: int = 500) -> Column:
    return F.when(F.length(content) > length, F.concat(F.left(content, F.lit(length)), F.lit("..."))).otherwise(content)


def agency_date(c: Column) -> Column:
    """The date by the first of the agencies' formats that fits."""
    c = F.trim(c)
    return F.coalesce(*[F.when(c.rlike(pattern), F.try_to_date(c, form)) for form, pattern in AGENCY_DATES.items()])


def form(c: Column) -> Column:
    """A dosage form with capital words; null if empty."""
    return F.nullif(F.initcap(F.trim(c)), F.lit(""))


def strength(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def marketing_status(c: Column) -> Column:
    """RX, OTC or DISCONTINUED for the agency's words; any other in capitals."""
    return lookup(c, MARKETING, F.upper(c))


def shortage_status(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s.rlike("current|active"), "current").when(s.rlike("resolved|recovered"), "resolved").otherwise("unknown")


def uniprot(c: Column) -> Column:
    """An accession of the fixed format; null for any other."""
    c = text(c)
    return F.when(c.rlike("^[OPQ][0-9A-Z]{3}[0-9A-Z]{1}[0-9A-Z]{3}$"), c)


def target_id(accession: Column, chembl: Column, name: Column) -> Column:
    """uniprot:… before chembl.target:… before target:name with dashes for blanks."""
    by_name = F.concat(F.lit("target:"), F.replace(F.lower(name), F.lit(" "), F.lit("-")))
    return F.coalesce(F.concat(F.lit("uniprot:"), uniprot(accession)), F.concat(F.lit("chembl.target:"), chembl), by_name)


def protein_type(target_class: Column) -> Column:
    """By the first of the fixed words in the class."""
    c = F.lower(F.coalesce(target_class, F.lit("")))
    out = F.when(F.lit(False), "")
    for word, kind in PROTEIN_TYPES:
        out = out.when(c.contains(word), kind)
    return out.otherwise("Protein")


def species(c: Column) -> Column:
    c = F.lower(text(c))
    return lookup(c, SPECIES, F.initcap(c))


def disease_id(mondo: Column, doid: Column, icd10: Column) -> Column:
    """mondo:… before doid:… before icd10:…."""
    return F.coalesce(*[F.concat(F.lit(f"{kind}:"), c) for kind, c in (("mondo", mondo), ("doid", doid), ("icd10", icd10))])
