"""Search over names and texts: ranked, containing, fuzzy, by prefix, grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.cypher import asc, desc
from lattica.plans.binding import Graph
from lattica.plans.registry import query

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _times(words: Column, term: str) -> Column:
    """How often a term is among words."""
    return F.size(F.filter(words, lambda w: w == term))


def ranked(rows: DataFrame, key: str, text: str, terms: list[str], limit: int = 20) -> DataFrame:
    """BM25 scores of the rows that have any of the terms: key, score, best first.

    Term frequencies are counted within each row, so nothing but matching rows is shuffled.
    """
    words = tokens(F.col(text))
    counted = rows.select(F.col(key).alias("key"), F.size(words).alias("length"), *[_times(words, t).alias(f"tf{i}") for i, t in enumerate(terms)])
    whole = counted.agg(F.count("*").alias("rows"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(whole))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("rows") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.select("key", F.round(score, 4).alias("score")).orderBy(desc("score"), asc("key")).limit(limit)


_TF = "len(list_filter(w, lambda x: x = '{}'))"


@query(
    "srch_2_ranked",
    f"""WITH t AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), c AS (SELECT key, len(w) AS length, {_TF.format('clown')} AS a, {_TF.format('trash')} AS b FROM t),
    s AS (SELECT count(*) AS n, avg(length) AS mean, count(CASE WHEN a > 0 THEN 1 END) AS da, count(CASE WHEN b > 0 THEN 1 END) AS db FROM c)
    SELECT key, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean)), 4) AS score
    FROM c, s WHERE a > 0 OR b > 0 ORDER BY score DESC, key LIMIT 20""",
)
def srch_2(g: Graph) -> DataFrame:
    return ranked(g.documents, "doc_id", "text", ["clown", "trash"])


@query("srch_3_contains", "SELECT id, label, 1.0::DOUBLE AS score FROM node WHERE contains(name, '#00000001') AND label IN ('Target', 'Disease') ORDER BY id, label LIMIT 50")
def srch_3(g: Graph) -> DataFrame:
    """The fallback: names that hold the text, of the labels asked for."""
    return g.node.filter(F.col("name").contains("#00000001") & F.col("label").isin("Target", "Disease")).select("id", "label", F.lit(1.0).alias("score")).orderBy(asc("id"), asc("label")).limit(50)


def fuzzy(rows: DataFrame, wanted: str, field: str, most: int = 2) -> DataFrame:
    """Rows whose field is within an edit distance, with distance and similarity."""
    d = F.levenshtein(F.lower(field), F.lit(wanted.lower()), most)
    return rows.withColumn("distance", d).filter("distance >= 0").withColumn("similarity", F.round(1 - F.col("distance") / len(wanted), 4))


@query("srch_4_fuzzy", "SELECT name, count(*) AS n, levenshtein(lower(name), 'smal rings') AS distance, round(1 - levenshtein(lower(name), 'smal rings') / 10.0, 4)::DOUBLE AS similarity FROM compound WHERE levenshtein(lower(name), 'smal rings') <= 3 GROUP BY name")
def srch_4(g: Graph) -> DataFrame:
    names = g.compound.groupBy("name").agg(F.count("*").alias("n"))  # names repeat; each is compared once
    return fuzzy(names, "smal rings", "name", 3).withColumn("distance", F.col("distance").cast("long"))


@query("srch_5_suggest", "SELECT name AS suggestion, count(*) AS frequency FROM compound WHERE starts_with(lower(name), 're') GROUP BY name ORDER BY frequency DESC, name LIMIT 10")
def srch_5(g: Graph) -> DataFrame:
    return g.compound.filter(F.lower("name").startswith("re")).groupBy(F.col("name").alias("suggestion")).agg(F.count("*").alias("frequency")).orderBy(desc("frequency"), asc("suggestion")).limit(10)


@query("srch_6_grouped", "SELECT label, count(*) AS hits FROM node WHERE contains(lower(name), 'er') GROUP BY label")
def srch_6(g: Graph) -> DataFrame:
    return g.node.filter(F.lower("name").contains("er")).groupBy("label").agg(F.count("*").alias("hits"))


@query(
    "srch_7_per_entity",
    "SELECT label, id, distance FROM (SELECT label, id, levenshtein(name, 'Supplier#000000042') AS distance, row_number() OVER (PARTITION BY label ORDER BY levenshtein(name, 'Supplier#000000042'), id) AS r FROM node WHERE label IN ('Target', 'Manufacturer') AND levenshtein(name, 'Supplier#000000042') <= 2) WHERE r <= 10",
)
def srch_7(g: Graph) -> DataFrame:
    """Fuzzy search over several kinds of entity with a limit for each."""
    found = fuzzy(g.node.filter("label IN ('Target', 'Manufacturer')"), "Supplier#000000042", "name")
    r = F.row_number().over(Window.partitionBy("label").orderBy("distance", "id"))
    return found.withColumn("r", r).filter("r <= 10").select("label", "id", F.col("distance").cast("long").alias("distance"))


TEXT = {"contains": lambda c, v: c.contains(v), "not_contains": lambda c, v: ~c.contains(v), "equals": lambda c, v: c == v, "not_equals": lambda c, v: c != v, "starts_with": lambda c, v: c.startswith(v), "ends_with": lambda c, v: c.endswith(v)}
NUMBER = {"equals": lambda c, v: c == v, "not_equals": lambda c, v: c != v, "greater_than": lambda c, v: c > v, "less_than": lambda c, v: c < v, "between": lambda c, v: c.between(*v), "in_range": lambda c, v: c.between(*v)}
DATE = {"on": lambda c, v: F.to_date(c) == F.lit(v).cast("date"), "before": lambda c, v: c < F.lit(v).cast("timestamp"), "after": lambda c, v: c > F.lit(v).cast("timestamp"), "between": lambda c, v: c.between(*[F.lit(x).cast("timestamp") for x in v])}
ENUM = {"equals": lambda c, v: c == v, "not_equals": lambda c, v: c != v, "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v))}
GRAMMAR = {"text": TEXT, "number": NUMBER, "date": DATE, "enum": ENUM}


def condition(tree: dict) -> Column:
    """A filter tree as one condition: {"all": [...]}, {"any": [...]}, {"not": tree} or {field, type, op, value}."""
    if "all" in tree or "any" in tree:
        parts = [condition(t) for t in tree.get("all", tree.get("any"))]
        out = F.lit("all" in tree) if not parts else parts[0]
        for p in parts[1:]:
            out = out & p if "all" in tree else out | p
        return out
    if "not" in tree:
        return ~condition(tree["not"])
    return GRAMMAR[tree["type"]][tree["op"]](F.col(tree["field"]), tree["value"])


@query("flt_9_advanced_search", "SELECT id, phase, status, enrollment FROM trial WHERE (starts_with(phase, 'Phase') AND enrollment BETWEEN 400 AND 900 AND start_date > TIMESTAMP '1997-01-01') AND (status IN ('Completed', 'Recruiting')) AND NOT (phase = 'Phase 4')")
def flt_9(g: Graph) -> DataFrame:
    wanted = {"all": [
        {"field": "phase", "type": "text", "op": "starts_with", "value": "Phase"},
        {"field": "enrollment", "type": "number", "op": "between", "value": (400, 900)},
        {"field": "start_date", "type": "date", "op": "after", "value": "1997-01-01"},
        {"any": [{"field": "status", "type": "enum", "op": "in", "value": ("Completed", "Recruiting")}]},
        {"not": {"field": "phase", "type": "text", "op": "equals", "value": "Phase 4"}},
    ]}
    return g.trial.filter(condition(wanted)).select("id", "phase", "status", "enrollment")
