"""What study and drug records say beyond their outline: people, sponsors, outcomes and eligibility; enzymes, transporters and properties.

Files are read under the schemas here; builders take rows of these forms and give (nodes, edges) as those in entities do.
Null arrays count as empty, and records without an identifier give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.classify import SEVERITY, first_rule
from lattica.functions.normalise import slug, text
from lattica.sources.entities import Graph, _edge, _node, _union, once

_ORGANISATION, _OUTCOME = "STRUCT<name: STRING, class: STRING>", "STRUCT<measure: STRING, description: STRING, timeFrame: STRING>"
STUDY_DETAILS = f"""protocolSection STRUCT<identificationModule: STRUCT<nctId: STRING>,
    sponsorCollaboratorsModule: STRUCT<leadSponsor: {_ORGANISATION}, collaborators: ARRAY<{_ORGANISATION}>, responsibleParty: STRUCT<type: STRING, name: STRING, title: STRING, affiliation: STRING, investigatorFullName: STRING, investigatorTitle: STRING, investigatorAffiliation: STRING>>,
    contactsLocationsModule: STRUCT<centralContacts: ARRAY<STRUCT<name: STRING, role: STRING>>>, outcomesModule: STRUCT<primaryOutcomes: ARRAY<{_OUTCOME}>, secondaryOutcomes: ARRAY<{_OUTCOME}>>,
    eligibilityModule: STRUCT<eligibilityCriteria: STRING, sex: STRING, minimumAge: STRING, maximumAge: STRING, healthyVolunteers: BOOLEAN>,
    armsInterventionsModule: STRUCT<interventions: ARRAY<STRUCT<type: STRING, name: STRING>>>>"""


def study_details(spark: SparkSession, path: str) -> DataFrame:
    """trial_id, lead, collaborators, investigator, contacts, outcomes, eligibility and drugs of study records in JSON files."""
    return flat_details(spark.read.option("multiLine", True).schema(STUDY_DETAILS).json(path))


def flat_details(rows: DataFrame) -> DataFrame:
    p = F.col("protocolSection")
    s, party = p["sponsorCollaboratorsModule"], p["sponsorCollaboratorsModule"]["responsibleParty"]
    by = lambda own, other: F.when(party["type"] == "SPONSOR_INVESTIGATOR", party[own]).when(party["type"] == "PRINCIPAL_INVESTIGATOR", party[other])
    person = F.struct(by("investigatorFullName", "name").alias("name"), by("investigatorTitle", "title").alias("title"), by("investigatorAffiliation", "affiliation").alias("organisation"))

    def outcomes(which: str, kind: str) -> Column:
        own = F.coalesce(p["outcomesModule"][which], F.array())
        return F.transform(own, lambda o, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), o["measure"].alias("measure"), o["description"].alias("description"), o["timeFrame"].alias("time_frame")))

    drugs = F.filter(F.coalesce(p["armsInterventionsModule"]["interventions"], F.array()), lambda x: F.lower(x["type"]) == "drug")
    return rows.filter(p["identificationModule"]["nctId"].isNotNull()).select(
        p["identificationModule"]["nctId"].alias("trial_id"), s["leadSponsor"].alias("lead"), s["collaborators"].alias("collaborators"), person.alias("investigator"),
        p["contactsLocationsModule"]["centralContacts"].alias("contacts"), F.concat(outcomes("primaryOutcomes", "primary"), outcomes("secondaryOutcomes", "secondary")).alias("outcomes"),
        p["eligibilityModule"].alias("eligibility"), F.transform(drugs, lambda x: x["name"]).alias("drugs"),
    )


def criteria(c: Column) -> Column:
    """inclusion and exclusion: the lines that follow a heading of either kind; lines that hold such a word are headings."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    kind = lambda x: F.when(F.lower(x).rlike("inclusion|include"), "inclusion").when(F.lower(x).rlike("exclusion|exclude"), "exclusion")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("now"), none.alias("inclusion"), none.alias("exclusion"))

    def step(state: Column, line: Column) -> Column:
        head = kind(line)
        add = lambda name: F.when(head.isNull() & (state["now"] == name), F.array_append(state[name], line)).otherwise(state[name]).alias(name)
        return F.struct(F.coalesce(head, state["now"]).alias("now"), add("inclusion"), add("exclusion"))

    return F.aggregate(lines, start, step, lambda s: F.struct(s["inclusion"], s["exclusion"]))


def of_study_details(details: DataFrame, compounds: DataFrame | None = None) -> Graph:
    """Sponsors, investigators, outcomes and eligibility of trials; compounds (id, name): drugs tested that have such a name are linked too."""
    trial = F.concat(F.lit("trial:"), "trial_id")
    of = lambda name: F.concat(F.lit("sponsor:"), slug(name))
    more = details.select("trial_id", F.explode("collaborators").alias("x"))
    sponsors = details.select("trial_id", F.col("lead").alias("x"), F.lit("Lead Sponsor").alias("kind")).unionByName(more.withColumn("kind", F.lit("Collaborator"))).filter("x.name is not null")
    person = F.concat(F.lit("investigator:"), slug(F.col("investigator.name")))
    contacts = details.select("trial_id", "investigator", F.posexplode("contacts").alias("place", "x")).filter("x.name is not null and not x.name <=> investigator.name")
    contact = F.concat(F.lit("investigator:"), "trial_id", F.lit("-"), "place")
    outcomes = details.select("trial_id", F.explode("outcomes").alias("x"))
    outcome = F.concat(F.lit("outcome:"), "trial_id", F.lit("-"), "x.kind", F.lit("-"), "x.place")
    rules = details.filter("eligibility is not null").withColumn("c", criteria(F.col("eligibility.eligibilityCriteria")))
    rule = F.concat(F.lit("eligibility:"), "trial_id")
    nodes = _union(
        _node(sponsors, of(F.col("x.name")), "Sponsor", F.col("x.name"), agency_class=F.col("x.class")),
        _node(details, person, "Investigator", F.col("investigator.name"), role=F.lit("Principal Investigator"), title=F.col("investigator.title"), organisation=F.col("investigator.organisation")),
        _node(contacts, contact, "Investigator", F.col("x.name"), role=F.coalesce("x.role", F.lit("Sub-Investigator"))),
        _node(outcomes, outcome, "Outcome", F.col("x.measure"), kind=F.col("x.kind"), time_frame=F.col("x.time_frame"), description=F.col("x.description")),
        _node(rules, rule, "EligibilityCriteria", F.col("trial_id"), gender=F.col("eligibility.sex"), minimum_age=F.col("eligibility.minimumAge"), maximum_age=F.col("eligibility.maximumAge"), healthy=F.col("eligibility.healthyVolunteers"), inclusion=F.array_join("c.inclusion", "\n"), exclusion=F.array_join("c.exclusion", "\n")),
    )
    parts = [
        _edge(sponsors, trial, of(F.col("x.name")), F.lit("SPONSORED_BY"), kind=F.col("kind"), agency_class=F.col("x.class")),
        _edge(details, trial, person, F.lit("HAS_PRINCIPAL_INVESTIGATOR")),
        _edge(contacts, trial, contact, F.lit("HAS_INVESTIGATOR")),
        _edge(outcomes, trial, outcome, F.lit("HAS_OUTCOME"), kind=F.col("x.kind")),
        _edge(rules, trial, rule, F.lit("HAS_ELIGIBILITY")),
    ]
    if compounds is not None:
        tested = details.select("trial_id", F.explode("drugs").alias("drug")).withColumn("key", F.lower(text(F.col("drug"))))
        known = compounds.select(F.col("id").alias("compound"), F.lower(text(F.col("name"))).alias("key")).filter("key is not null").groupBy("key").agg(F.min("compound").alias("compound"))
        parts.append(_edge(tested.join(known, "key"), F.col("compound"), trial, F.lit("TESTED_IN_CLINICAL_TRIAL"), intervention=F.col("drug")))
    return once(nodes), _union(*parts)


_PROTEIN = "STRUCT<id: STRING, name: STRING, organism: STRING, polypeptide: STRUCT<`external-identifiers`: STRUCT<`external-identifier`: ARRAY<STRUCT<resource: STRING, identifier: STRING>>>>>"
#: What is told of a drug's way through the body, and of its harm.
KINETICS = ("absorption", "distribution", "metabolism", "excretion", "half-life", "clearance", "route-of-elimination", "volume-of-distribution")
HARM = ("toxicity", "carcinogenicity", "mutagenicity", "ld50", "toxicity-category")
DRUG_DETAILS = f"""`drugbank-id` ARRAY<STRUCT<_VALUE: STRING, _primary: BOOLEAN>>, name STRING, enzymes STRUCT<enzyme: ARRAY<{_PROTEIN}>>, transporters STRUCT<transporter: ARRAY<{_PROTEIN}>>,
    `atc-codes` STRUCT<`atc-code`: ARRAY<STRUCT<_code: STRING>>>, pharmacokinetics STRUCT<{', '.join(f'`{k}`: STRING' for k in KINETICS)}>, {', '.join(f'`{k}` STRING' for k in HARM)},
    `drug-interactions` STRUCT<`drug-interaction`: ARRAY<STRUCT<`drugbank-id`: STRING, name: STRING, description: STRING>>>"""


def drug_details(spark: SparkSession, path: str) -> DataFrame:
    """id, name, enzymes, transporters, atc_codes, properties and interactions of <drug> elements."""
    return flat_drugs(spark.read.format("xml").option("rowTag", "drug").schema(DRUG_DETAILS).load(path))


def flat_drugs(rows: DataFrame) -> DataFrame:
    ids = F.col("`drugbank-id`")
    primary = F.coalesce(F.get(F.filter(ids, lambda x: x["_primary"]), F.lit(0))["_VALUE"], F.get(ids, F.lit(0))["_VALUE"])

    def proteins(c: Column) -> Column:
        known = lambda x: F.get(F.filter(x["polypeptide"]["external-identifiers"]["external-identifier"], lambda e: e["resource"] == "UniProt"), F.lit(0))["identifier"]
        return F.filter(F.transform(F.coalesce(c, F.array()), lambda x: F.struct(F.coalesce(known(x), x["id"]).alias("id"), x["name"].alias("name"), x["organism"].alias("organism"))), lambda x: x["id"].isNotNull())

    told = [(k.replace("-", "_"), F.col(f"pharmacokinetics.`{k}`")) for k in KINETICS] + [(k.replace("-", "_"), F.col(f"`{k}`")) for k in HARM]
    properties = F.map_filter(F.create_map(*[x for k, v in told for x in (F.lit(k), text(v))]), lambda k, v: v.isNotNull())
    codes = F.filter(F.transform(F.coalesce(F.col("`atc-codes`.`atc-code`"), F.array()), lambda x: x["_code"]), lambda x: x.isNotNull())
    interactions = F.coalesce(F.col("`drug-interactions`.`drug-interaction`"), F.array())
    other = F.transform(interactions, lambda x: F.struct(x["drugbank-id"].alias("id"), x["name"].alias("name"), x["description"].alias("description")))
    return rows.filter(primary.isNotNull()).select(primary.alias("id"), "name", proteins(F.col("enzymes.enzyme")).alias("enzymes"), proteins(F.col("transporters.transporter")).alias("transporters"), codes.alias("atc_codes"), properties.alias("properties"), F.filter(other, lambda x: x["id"].isNotNull()).alias("interactions"))


#: Kinds of interaction by words of their description, in order.
INTERACTIONS = (("contraindication", "contraindicat"), ("pharmacokinetic", "metabol|absorption|excretion|clearance|serum"), ("pharmacodynamic", "effect|activit|risk"))


def of_drug_details(drugs: DataFrame) -> Graph:
    """Compounds with their properties, the proteins that break them down and carry them, and what they interact with and how badly."""
    compound = F.concat(F.lit("drugbank:"), "id")
    proteins = {rel: drugs.select("id", F.explode(column).alias("x")) for rel, column in (("METABOLIZED_BY", "enzymes"), ("TRANSPORTED_BY", "transporters"))}
    target = F.concat(F.lit("target:"), "x.id")
    x = drugs.select("id", F.explode("interactions").alias("x"))
    told = F.col("x.description")
    named = [k.replace("-", "_") for k in (*KINETICS, *HARM)]
    nodes = _union(
        _node(drugs, compound, "Compound", F.col("name"), atc=F.array_join("atc_codes", ","), **{k: F.try_element_at("properties", F.lit(k)) for k in named}),
        *[_node(p, target, "Target", F.col("x.name"), organism=F.col("x.organism")) for p in proteins.values()],
    )
    edges = _union(
        *[_edge(p, compound, target, F.lit(rel), organism=F.col("x.organism")) for rel, p in proteins.items()],
        _edge(x, compound, F.concat(F.lit("drugbank:"), "x.id"), F.lit("INTERACTS_WITH"), severity=first_rule(told, SEVERITY, "unknown"), kind=first_rule(told, INTERACTIONS, "unknown"), description=told),
    )
    return once(nodes), edges
