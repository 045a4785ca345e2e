"""Tables that hold the state of iterations, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark deletes the shuffle files of a query at its end, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder made for this session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lattica.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lattica-")
        spark.conf.set("lattica.scratch.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df written and read again: its lineage is cut, and lost executors don't undo it.

    Its shuffle files are deleted at once, so that rounds don't pile them up, as is the table that it takes the place of.
    """
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    if instead_of is not None:
        dropped(instead_of)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lattica_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
