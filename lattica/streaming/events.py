"""Event streams: windowed counts, first-seen rows, upserts by micro-batch, escalation with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattica.operators.records import upserted

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(stream: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and their mean value by window and type; what comes later than allowed is left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with no longer gap between them."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(stream: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once within the time that late rows are awaited."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upserting(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's last row of each key over what read() gives, handed to write(). A repeated batch changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "ts").alias("r")).select(key, "r.*")
        write(upserted(read(), last, key))

    return batch


def escalated(stream: DataFrame, least: int = 3) -> DataFrame:
    """user_id, seen: once for each user, when so many errors of theirs have come."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (before,) = state.get if state.exists else (0,)
        seen = before + sum(len(p) for p in parts)
        state.update((seen,))
        if before < least <= seen:
            yield pd.DataFrame({"user_id": [key[0]], "seen": [seen]})

    errors = stream.filter("event_type = 'error'")
    return errors.groupBy("user_id").applyInPandasWithState(step, "user_id long, seen long", "n long", "append", GroupStateTimeout.NoTimeout)
