"""Batches of documents of similar length: optimal length buckets by dynamic programming, token-budget batches in each.

All documents of a bucket are padded to its boundary, the largest length in it. The boundaries minimise the padding
summed over all documents; they come from the histogram of lengths over the whole table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.tables import written

#: Hex digits of an MD5 that deal a bucket's documents to parts, each ordered on its own.
PART_DIGITS = 3


def n_words(text: Column) -> Column:
    """The number of words, parted by the blanks space and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending boundaries, at most so many, with the least sum of counts * (boundary - length).

    Least padding F_k(j) of the j shortest lengths in k buckets = min over i of F_{k-1}(i) + cost(i, j). The best i
    never falls as j grows, so halving the j works each level out in about n log n steps. Of equally good i, the
    least is taken.
    """
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate(([0], np.cumsum(counts)))
    w = np.concatenate(([0], np.cumsum(counts * lengths)))
    top = np.concatenate(([0], lengths))
    best = top * c - w
    froms = []
    for _ in range(1, min(buckets, n)):
        new, source = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n)]
        while todo:
            lo, hi, i0, i1 = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(i0, min(i1, j - 1) + 1)
            cost = best[i] + top[j] * (c[j] - c[i]) - (w[j] - w[i])
            k = int(cost.argmin())
            new[j], source[j] = cost[k], i[k]
            todo += [(lo, j - 1, i0, int(i[k])), (j + 1, hi, int(i[k]), i1)]
        froms.append(source)
        best = new
    out, j = [int(lengths[-1])], n
    for source in reversed(froms):
        j = int(source[j])
        if not j:
            break
        out.append(int(lengths[j - 1]))
    return out[::-1]


def packed(docs: DataFrame, buckets: int = 8, budget: int = 16384, length: Column | None = None) -> DataFrame:
    """One row per document: doc_id, length, bucket (from 0), pad_to, padding, batch (from 0 in its bucket).

    A batch holds budget // pad_to documents of one bucket, at least one; only the last of a bucket can hold fewer.
    length: words by default; null text has length 0. Documents of length 0 need no padding beyond their bucket's.
    Order within a bucket is by the MD5 of doc_id (null: empty), then doc_id, then length; ties beyond that are
    alike. Repeated rows all stay; no rows give none; of other columns none is looked at. Lengths are exact, and the
    histogram on the driver stays small: d distinct lengths add up to d * d / 2 words at least, so 10 billion words have
    at most 141,000 of them.
    """
    rows = written(docs.select("doc_id", (n_words(F.col("text")) if length is None else length).alias("length")), "lengths")
    histogram = rows.groupBy("length").count().toPandas().sort_values("length")
    edges = boundaries(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    if not edges:
        return rows.select("doc_id", "length", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("pad_to"), F.lit(0).cast("long").alias("padding"), F.lit(0).cast("long").alias("batch")).limit(0)
    bucket = F.lit(0)
    for e in edges[:-1]:
        bucket = bucket + (F.col("length") > e).cast("int")
    pads = F.array(*[F.lit(e).cast("long") for e in edges])
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("bucket", bucket).withColumn("pad_to", F.element_at(pads, F.col("bucket") + 1)).withColumn("digest", digest).withColumn("part", F.substring("digest", 1, PART_DIGITS))
    # len(edges) * 16 ** PART_DIGITS counts at most; where each part of a bucket begins
    starts = rows.groupBy("bucket", "part").count().withColumn("start", F.sum("count").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.broadcast(starts.select("bucket", "part", F.coalesce("start", F.lit(0)).alias("start")))
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("digest", "doc_id", "length")) - 1
    rows = rows.withColumn("place", place).join(starts, ["bucket", "part"])
    each = F.greatest(F.floor(F.lit(budget) / F.greatest("pad_to", F.lit(1))), F.lit(1))
    return rows.select("doc_id", "length", "bucket", "pad_to", (F.col("pad_to") - F.col("length")).alias("padding"), F.floor((F.col("start") + F.col("place")) / each).cast("long").alias("batch"))
