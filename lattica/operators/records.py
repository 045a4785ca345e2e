"""Operators on source records: deduplication, identity, repair, quality, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.normalise import loose_id


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key by an order; rows with a null key all stay.

    Kept as an aggregate of whole rows, which combines before it shuffles, so a key that very many rows share is no
    hot group.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    best = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return best.select("row.*").unionByName(rows.filter(F.col(key).isNull()))


def distinct_documents(docs: DataFrame, order: list[str]) -> DataFrame:
    """Documents whose url was not seen before, then those whose content was not: url, title, date, text are read.

    A document dropped for its url does not count as having been seen by its content.
    """
    once = first_seen(docs, "url", order)
    content = F.md5(F.concat_ws("|", "title", "url", "date", F.substring("text", 1, 500)))
    return first_seen(once.withColumn("content_key", content), "content_key", order).drop("content_key")


def canonical_id(kind: str, preferred: list[tuple[str, Column]], hashed: list[str]) -> Column:
    """KIND:value of the first identifier there is, else KIND:HASH: and the MD5 of some columns as JSON."""
    given = [F.concat(F.lit(f"{kind}:{name}:"), c) for name, c in preferred]
    return F.coalesce(*given, F.concat(F.lit(f"{kind}:HASH:"), F.substring(F.md5(F.to_json(F.struct(*sorted(hashed)))), 1, 16)))


def repaired(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """edges whose end names a node exactly, or else but for what loose_id() takes off; other edges keep it.

    Adds how: exact, loose or none. If several nodes are alike loosely, the least id is taken.
    """
    exact = nodes.select(F.col("id").alias(end)).distinct().withColumn("_exact", F.lit(True))
    loose = nodes.groupBy(loose_id(F.col("id")).alias("_loose")).agg(F.min("id").alias("_id"))
    out = edges.join(exact, end, "left").withColumn("_loose", loose_id(F.col(end))).join(loose, "_loose", "left")
    how = F.when(F.col("_exact"), "exact").when(F.col("_id").isNotNull(), "loose").otherwise("none")
    fixed = F.when(how == "loose", F.col("_id")).otherwise(F.col(end))
    return out.withColumn("how", how).withColumn(end, fixed).drop("_exact", "_loose", "_id")


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with new rows added and, where the key is there, each property overwritten that new gives."""
    left, right = existing.alias("a"), new.alias("b")
    columns = list(dict.fromkeys([*existing.columns, *new.columns]))
    pick = [
        F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("b", new), ("a", existing)) if c in df.columns]).alias(c)
        for c in columns
    ]
    return left.join(right, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*pick)


def connected_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose two ends exist, once each."""
    e = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return e.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi").dropDuplicates(["src", "dst", "rel"])


def detached(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without some nodes (id) and all edges at them."""
    ids = gone.select("id")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


Rule = tuple[str, str, str, Callable[[], Column]]


def findings(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with findings, an array of (field, severity, code) of the rules they break, and valid: none is an ERROR.

    A rule: field, severity, code, and a function that gives the condition of breaking it. Unknown isn't broken.
    """
    each = [F.when(F.coalesce(broken(), F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"), F.lit(c).alias("code"))) for f, s, c, broken in rules]
    out = rows.withColumn("findings", F.array_compact(F.array(*each)))
    return out.withColumn("valid", ~F.exists("findings", lambda x: x["severity"].isin("ERROR", "CRITICAL")))


#: What each metric weighs in the overall score.
WEIGHTS = {"completeness": 0.25, "validity": 0.30, "consistency": 0.20, "uniqueness": 0.15, "timeliness": 0.10}


def quality(rows: DataFrame, key: str, required: list[str], rules: list[Rule], consistent: list[Column], dated: str, as_of: str) -> DataFrame:
    """One row: completeness, validity, consistency, uniqueness, timeliness, and their weighted score."""
    checked = findings(rows, rules)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    filled = [share(F.col(c).isNotNull()) for c in required]
    passes = [share(c) for c in consistent]
    recent = F.col(dated) >= F.date_sub(F.lit(as_of).cast("date"), 365)
    one = checked.agg(
        (sum(filled[1:], filled[0]) / len(filled)).alias("completeness"),
        share(F.col("valid")).alias("validity"),
        (sum(passes[1:], passes[0]) / len(passes)).alias("consistency"),
        share(recent).alias("timeliness"),
        F.count(key).alias("_keys"),
    )
    distinct = rows.filter(F.col(key).isNotNull()).groupBy(key).count().agg(F.count("*").alias("_distinct"))
    out = one.join(F.broadcast(distinct)).withColumn("uniqueness", F.coalesce(F.try_divide("_distinct", "_keys"), F.lit(1.0)))
    score = sum((F.col(m) * w for m, w in list(WEIGHTS.items())[1:]), F.col("completeness") * WEIGHTS["completeness"])
    return out.select(*[F.round(m, 6).alias(m) for m in WEIGHTS], F.round(score, 4).alias("score"))


def last_written(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of every key that came last, as an insert-or-replace table would hold it."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(sequence)))
    return rows.withColumn("_r", r).filter("_r = 1").drop("_r")


def mapped(rows: DataFrame, fields: list[tuple[str, str, object, Callable[[Column], Column] | None]]) -> DataFrame:
    """rows with fields (source, name, default, transform) only: null takes the default, what is given is transformed."""
    out = []
    for source, name, default, change in fields:
        c = F.col(f"`{source}`")
        c = c if change is None else change(c)
        out.append((c if default is None else F.coalesce(c, F.lit(default))).alias(name))
    return rows.select(*out)


def merged(existing: DataFrame, new: DataFrame, key: str, on_create: dict[str, Column], on_match: dict[str, Column]) -> DataFrame:
    """existing with the keys of new: on_match sets properties of those that are there, on_create of those that aren't."""
    keys = new.select(key).distinct().withColumn("_new", F.lit(True))
    both = existing.withColumn("_old", F.lit(True)).join(keys, key, "full_outer")
    pick = []
    for c in existing.columns:
        own = F.col(c)
        if c in on_match:
            own = F.when(F.col("_old") & F.col("_new"), on_match[c]).otherwise(own)
        if c in on_create:
            own = F.when(F.col("_old").isNull(), on_create[c]).otherwise(own)
        pick.append(own.alias(c))
    return both.select(*pick)
