"""Files that arrive over time, taken up where the last run ended and merged into a store once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.operators.pipelines import Pipeline, accepted, load, rejected


def arriving(spark: SparkSession, path: str, schema: str, form: str = "json", files_at_once: int = 1000, **options: str) -> DataFrame:
    """A stream of the records of files in a folder, so many files a batch; broken ones are rows of nulls."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_at_once).options(**options).load(path)


def ingest(records: DataFrame, pipeline: Pipeline, store: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Takes all files that aren't done yet through a pipeline into a store, and what it rejects into store/rejected.

    The checkpoint knows which files are done, so a run goes on where the last one ended, also after a failure; a batch that was merged
    but not yet noted there is known to the store by its number. Within a batch the first record of a key counts, later batches replace
    what they give.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch if change is None else change(batch)
        load(accepted(pipeline, rows), pipeline.key, store, number)
        rejected(pipeline, rows).write.mode("overwrite").parquet(f"{store}/rejected/batch={number}")

    records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
