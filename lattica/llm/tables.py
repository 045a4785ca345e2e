"""Durable intermediate tables, and joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it is counted to have no more rows than this (narrow rows, so tens of MB).
BROADCAST_ROWS = 200_000
#: A key with more than 1/HOT_SHARE of all rows is hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set up here where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("lattica.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lattica-")
        spark.conf.set("lattica.scratch.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and lost executors don't undo it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def drop(df: DataFrame, part: str = "") -> None:
    """Deletes the files of a table made by written(), or of a partition of it, that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{df._lattica_path}/{part}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are few; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def attach(rows: DataFrame, table: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """rows left join table on key (one row a key; size: how many of the total rows have it).

    Keys with over 1/HOT_SHARE of the rows are joined by broadcast, at most HOT_SHARE of them; the others
    are shuffled, so that no task gets more than such a share for one key.
    """
    least = total / HOT_SHARE
    more = [c for c in table.columns if c not in key]
    hot = table.filter(F.col(size) > least).withColumn("_hot", F.lit(True))
    first = rows.join(F.broadcast(hot), key, "left")
    cold = first.filter(F.col("_hot").isNull()).select(*rows.columns).join(table.filter(F.col(size) <= least), key, "left")
    return first.filter("_hot").select(*rows.columns, *more).unionByName(cold.select(*rows.columns, *more))


def digest_of(*of: Column) -> Column:
    """A 64-bit digest of what decides about a row besides its doc_id, nulls as empty."""
    return F.xxhash64(*[F.coalesce(c, F.lit("")) for c in of])


def without(docs: DataFrame, gone: DataFrame, digest: Column) -> DataFrame:
    """docs without the rows whose doc_id and digest are in gone (_id, _digest), nulls equal to one another."""
    gone = sized(gone, gone.count())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & digest.eqNullSafe(gone["_digest"]), "left_anti")


def lower_ascii(text: Column) -> Column:
    """text, null as empty, with A-Z in lower case and all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
