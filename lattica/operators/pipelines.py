"""From source records to stored nodes: fields are mapped, records judged, repeated keys dropped, the rest merged into a store.

A store is a folder with a whole table a version; a version counts once it stands in the folder's list, which is written last.
So a job that dies while it writes leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.records import Rule, findings, first_seen, mapped, upserted


@dataclass(frozen=True)
class Pipeline:
    """label: of the nodes. fields: (source, name, default, change) as for mapped(). key: a mapped field that names a node.
    order: mapped fields by which the first record of a key is chosen. rules: as for findings(); one that breaks an ERROR goes."""

    label: str
    key: str
    fields: list[tuple[str, str, object, Callable[[Column], Column] | None]]
    order: list[str]
    rules: list[Rule] = field(default_factory=list)


def judged(pipeline: Pipeline, records: DataFrame) -> DataFrame:
    """Mapped records with findings and valid; a record without a key has an ERROR of its own."""
    keyed = (pipeline.key, "ERROR", "REQUIRED", lambda: F.col(pipeline.key).isNull())
    return findings(mapped(records, pipeline.fields), [keyed, *pipeline.rules])


def accepted(pipeline: Pipeline, records: DataFrame) -> DataFrame:
    """The first valid record of each key, with the fields that mapping gives."""
    valid = judged(pipeline, records).filter("valid").drop("findings", "valid")
    return first_seen(valid, pipeline.key, pipeline.order)


def rejected(pipeline: Pipeline, records: DataFrame) -> DataFrame:
    """Records that aren't valid, with what was found."""
    return judged(pipeline, records).filter("not valid")


def report(pipeline: Pipeline, records: DataFrame) -> DataFrame:
    """One row: label, read, rejected, repeated, kept."""
    rows = judged(pipeline, records)
    keys = rows.filter("valid").groupBy(pipeline.key).agg(F.count("*").alias("n")).agg(F.count("*").alias("kept"), F.coalesce(F.sum("n"), F.lit(0)).alias("valid"))
    read = rows.agg(F.count("*").alias("read"), F.count_if(~F.col("valid")).alias("rejected"))
    both = read.join(F.broadcast(keys))  # one row each
    return both.select(F.lit(pipeline.label).alias("label"), "read", "rejected", (F.col("valid") - F.col("kept")).alias("repeated"), "kept")


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The store's latest version; None before the first."""
    version = _version(spark, store)
    return None if version is None else spark.read.parquet(f"{store}/data-{version}")


def _versions(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.schema("version int, batch long").json(f"{store}/versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _version(spark: SparkSession, store: str) -> int | None:
    found = _versions(spark, store)
    return None if found is None else found.agg(F.max("version")).first()[0]


def load(rows: DataFrame, key: str, store: str, batch: int | None = None) -> int:
    """Merges rows into a store: new keys are added, given properties replace old ones. Returns the new version.

    batch: a number that rows come under; what is in the store under a batch already isn't merged again.
    """
    spark = rows.sparkSession
    version = _version(spark, store)
    if batch is not None and version is not None and not _versions(spark, store).filter(F.col("batch") == batch).isEmpty():
        return version
    merged = rows if version is None else upserted(spark.read.parquet(f"{store}/data-{version}"), rows, key)
    new = 1 if version is None else version + 1
    merged.write.mode("overwrite").parquet(f"{store}/data-{new}")
    spark.range(1).select(F.lit(new).alias("version"), F.lit(batch).cast("long").alias("batch")).write.mode("append").json(f"{store}/versions")
    return new


def run(pipeline: Pipeline, records: DataFrame, folder: str, dry: bool = False) -> DataFrame:
    """Loads what is accepted into folder/label and what isn't into folder/rejected/label; dry: writes nothing. Returns the report."""
    if not dry:
        load(accepted(pipeline, records), pipeline.key, f"{folder}/{pipeline.label}")
        rejected(pipeline, records).write.mode("overwrite").parquet(f"{folder}/rejected/{pipeline.label}")
    return report(pipeline, records)
