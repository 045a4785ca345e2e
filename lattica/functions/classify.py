"""Classes and mentions in regulatory texts by ordered keyword rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword rules, the first that fits decides.
DOCUMENT_TYPES = (("guidance", "guidance|guideline"), ("warning", "warning letter|warning"), ("approval", "approv"), ("recall", "recall"), ("report", "report|review"))
AREAS = {
    "ONCOLOGY": ("cancer", "tumor", "oncology", "carcinoma", "malignant", "化疗", "肿瘤", "癌"),
    "CARDIOVASCULAR": ("cardio", "heart", "vascular", "hypertension", "cardiac", "心血管", "心脏"),
    "NEUROLOGY": ("neuro", "brain", "cns", "neural", "神经", "脑", "中枢神经"),
    "INFECTIOUS_DISEASE": ("infect", "viral", "bacterial", "antibiotic", "antiviral", "感染", "抗菌", "抗病毒"),
    "RESPIRATORY": ("respiratory", "pulmonary", "lung", "asthma", "呼吸", "肺"),
    "GASTROINTESTINAL": ("gi", "gastro", "digestive", "intestinal", "胃肠", "消化"),
    "ENDOCRINE": ("endocrine", "diabetes", "thyroid", "hormone", "内分泌", "糖尿病", "甲状腺"),
    "DERMATOLOGY": ("dermat", "skin", "cutaneous", "皮肤"),
    "HEMATOLOGY": ("hemat", "blood", "anemia", "血液"),
    "IMMUNOLOGY": ("immun", "vaccine", "allergy", "免疫", "疫苗", "过敏"),
    "PEDIATRICS": ("pediatric", "children", "infant", "儿科", "儿童", "婴儿"),
    "GERIATRICS": ("geriatric", "elderly", "老年"),
    "QUALITY": ("quality", "gmp", "validation", "compliance", "质量", "验证"),
    "MANUFACTURING": ("manufacturing", "production", "facility", "equipment", "生产", "制造", "设施"),
    "CLINICAL": ("clinical", "trial", "study", "investigational", "临床", "试验"),
    "PHARMACOLOGY": ("pharmac", "drug", "medicinal", "药理", "药物"),
    "TOXICOLOGY": ("toxic", "safety", "adverse", "毒理", "安全", "不良"),
}
#: Agencies by their addresses and by words of an organisation, categories of pathways, kinds of guidance, in order.
AGENCY_ADDRESSES = (("FDA", "fda.gov"), ("EMA", "ema.europa.eu"), ("CDE", "cde.org.cn"), ("NMPA", "nmpa.gov.cn"), ("PMDA", "pmda.go.jp"), ("ICH", "ich.org"))
AGENCY_WORDS = (("FDA", "fda"), ("EMA", "ema"), ("NMPA", "nmpa|药监局"), ("CDE", "cde|审评"))
PATHWAY_CATEGORIES = (
    ("Metabolism", "metabolism|carbohydrate|lipid|amino acid|nucleotide|energy|vitamin"),
    ("Genetic Information Processing", "transcription|translation|replication|repair"),
    ("Environmental Information Processing", "signal transduction|signaling"),
    ("Cellular Processes", "cell growth|cell death|apoptosis|cell motility"),
    ("Organismal Systems", "immune|nervous|endocrine|circulatory|digestive"),
    ("Human Diseases", "cancer|tumor|immune disease|neurodegenerative|metabolic disease"),
)
GUIDANCE_TYPES = (("reflection_paper", "reflection[ -]paper"), ("question_answer", "question[ -]and[ -]answer|q&a"), ("concept_paper", "concept[ -]paper"), ("revised_guideline", "guideline.*revis|revis.*guideline"), ("guideline", "guideline"), ("guidance", "guidance"), ("opinion", "opinion"), ("statement", "statement"), ("addendum", "addendum"))
SEVERITY = (("major", "contraindicated|severe|fatal|avoid"), ("moderate", "moderate|monitor|caution"), ("minor", "minor|mild"))


def first_rule(c: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The class of the first rule whose pattern is in the text, whatever its case."""
    c = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for name, pattern in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(otherwise)


def best_area(c: Column, areas: dict[str, tuple[str, ...]] = AREAS, otherwise: str = "GENERAL") -> Column:
    """The area with the most of its keywords in the text; of equals the first; otherwise without any."""
    c = F.lower(F.coalesce(c, F.lit("")))
    hits = [sum((c.contains(k).cast("int") for k in keys[1:]), c.contains(keys[0]).cast("int")) for keys in areas.values()]
    top = F.greatest(*hits, F.lit(0))
    out = F.when(top == 0, otherwise)
    for name, h in zip(areas, hits):
        out = out.when(h == top, name)
    return out


def mentions(c: Column, pattern: str, group: int = 0, most: int | None = None) -> Column:
    """The distinct matches of a pattern in the order of the text, at most so many."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group)))
    return found if most is None else F.slice(found, 1, most)


def sentences(c: Column, pattern: str, most: int = 20) -> Column:
    """Sentences of the text that match a pattern."""
    return F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), r"\."), lambda s: s.rlike(pattern)), 1, most)


def agency(given: Column, url: Column, organisation: Column) -> Column:
    """The agency given if it is a known one, else by the address, else by words of the organisation, else OTHER."""
    known = F.when(given.isin(*[name for name, _ in AGENCY_ADDRESSES]), given)
    by_url = first_rule(url, tuple((name, part.replace(".", r"\.")) for name, part in AGENCY_ADDRESSES), "")
    return F.coalesce(known, F.nullif(by_url, F.lit("")), first_rule(organisation, AGENCY_WORDS, "OTHER"))


def pathway_category(name: Column, description: Column) -> Column:
    """By the first category one of whose words is in the name or description; Other without any."""
    return first_rule(F.concat_ws(" ", name, description), PATHWAY_CATEGORIES, "Other")
