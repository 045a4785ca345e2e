"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Every shard has an order of preference over the slots of a table of prime size: a start and a step from its name's
MD5. Shards take turns, each claiming the first slot of its order that is still free, until the table is full. A row
goes to the shard in slot (MD5 of its key modulo the table's size). When a shard leaves or joins, few other slots
change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of an MD5 that make a number: 60 bits, so that it is positive in 64.
DIGITS = 15


def prime_from(n: int) -> int:
    """The least prime that is at least n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill(shards: list[str], size: int) -> list[int]:
    """Which shard (its place in the list) has each of the slots; size: a prime. Work is bound by the table, not by data.

    Equal names would have equal preferences, so names must differ; no shards, or more than slots, are errors too.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > size or prime_from(size) != size:
        raise ValueError("shards need different names and a table of prime size with a slot for each")
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:DIGITS], 16)
    at = [number(f"start {s}") % size for s in shards]
    step = [number(f"step {s}") % max(size - 1, 1) + 1 for s in shards]
    slots, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            while slots[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            slots[at[shard]] = shard
            left -= 1
            if not left:
                break
    return slots


def table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """slot, shard: the filled table as a DataFrame of exactly size rows."""
    names = F.array(*[F.lit(s) for s in shards])
    numbers = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(numbers).alias("slot", "place")).select("slot", F.element_at(names, F.col("place").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key; a null key is treated as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, DIGITS), 16, 10).cast("long") % size


def assign(rows: DataFrame, shards: list[str], key: str = "doc_id", size: int | None = None) -> DataFrame:
    """rows with slot (int) and shard (string) appended, in place of columns of these names.

    Every row keeps its place, repeated rows and rows of a null key included (they share a slot); no shuffle takes
    place. size: at least 100 slots a shard by default, which keeps shares within about 1 %. The table that is
    broadcast has size rows, whatever the data.
    """
    size = size or prime_from(100 * len(shards))
    rows = rows.drop("shard").withColumn("slot", slot_of(F.col(key), size).cast("int"))
    return rows.join(F.broadcast(table(rows.sparkSession, shards, size)), "slot")


def write_shards(rows: DataFrame, shards: list[str], path: str, key: str = "doc_id", files: int = 8) -> None:
    """A folder for each shard under path, each written by up to files tasks; a row's own hash picks which."""
    placed = assign(rows, shards, key)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith(("map", "void", "variant"))]), F.lit(files))
    placed.withColumn("_part", part).repartition(len(shards) * files, "shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
