"""Files of results: nodes and edges by type, with a summary; documents with their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind ('node' or 'edge'), type, n."""
    n = nodes.groupBy(F.col("label").alias("type")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(edges.groupBy(F.col("rel").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def write_results(nodes: DataFrame, edges: DataFrame, folder: str, form: str = "json") -> None:
    """nodes/label=.../, edges/rel=.../ and summary/ in a folder, which are replaced if they are there.

    Every task writes its own files for each type, so a type with most of the rows isn't written by one task.
    """
    nodes.write.mode("overwrite").partitionBy("label").format(form).save(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").format(form).save(f"{folder}/edges")
    summary(nodes, edges).coalesce(1).write.mode("overwrite").format(form).save(f"{folder}/summary")


def read_results(spark, folder: str, form: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.format(form).load(f"{folder}/{part}") for part in ("nodes", "edges", "summary"))


def document_statistics(docs: DataFrame, fields: list[str], most: int = 10) -> DataFrame:
    """field, value, n, rank: the commonest values of each field, ties by value; null counts as a value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    counts = docs.select(each).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("field").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def write_documents(docs: DataFrame, fields: list[str], folder: str) -> None:
    """documents/ as JSON lines, statistics/ with the commonest values of some fields, metadata/ with the number of documents."""
    docs.write.mode("overwrite").json(f"{folder}/documents")
    document_statistics(docs, fields).coalesce(1).write.mode("overwrite").json(f"{folder}/statistics")
    docs.agg(F.count("*").alias("documents")).write.mode("overwrite").json(f"{folder}/metadata")


def export(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A result as CSV (quoted, with a header) or JSON lines."""
    if form == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif form == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no form {form}")
