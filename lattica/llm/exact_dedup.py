"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each partition sends every owner of a range of fingerprints its sorted distinct 64-bit fingerprints of that
range, Golomb-coded. An owner answers each partition with a bitmap over the list that it sent: which ones other
partitions sent as well. Only rows whose bit is set, or whose fingerprint came up twice in their own partition,
are suspects; only their texts are shuffled, and grouped by their very bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import golomb
from lattica.llm.tables import attach, lower_ascii, sized, written

ROWS = "block int, pos int, doc_id long, fingerprint long, sha binary"
MESSAGE = "owner int, n int, bits int, payload binary"


def _range(owner: int, owners: int) -> tuple[int, int]:
    return (owner << 64) // owners + bool((owner << 64) % owners), ((owner + 1) << 64) // owners


def fingerprints(batches: Iterator[pa.RecordBatch], owners: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, then a message for each owner that gets any; a partition is a block."""
    import hashlib

    import xxhash

    block, pos, seen = TaskContext.get().partitionId(), 0, []
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("fingerprint", pa.int64()), ("sha", pa.binary()), ("owner", pa.int32()), ("n", pa.int32()), ("bits", pa.int32()), ("payload", pa.binary())])

    def out(kind: int, count: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": np.full(count, kind, np.int32), "block": np.full(count, block, np.int32)}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    for batch in batches:
        texts = pc.ascii_lower(pc.fill_null(batch["text"].cast(pa.large_string()), "")).cast(pa.large_binary())
        n = len(texts)
        found = np.empty(n, np.uint64)
        shas = []
        for i, text in enumerate(texts):
            body = text.as_buffer()
            found[i] = xxhash.xxh3_64_intdigest(body)
            shas.append(hashlib.sha256(body).digest())
        seen.append(found)
        yield out(0, n, pos=np.arange(pos, pos + n, dtype=np.int32), doc_id=batch["doc_id"], fingerprint=found.view(np.int64), sha=shas)
        pos += n
    own = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
    sent = []
    for owner, part in _split(own, owners):
        start, end = _range(owner, owners)
        bits = golomb.rice_bits(end - start, len(part))
        sent.append((owner, len(part), bits, golomb.encode(part, start, bits)))
    if sent:
        yield out(1, len(sent), **dict(zip(("owner", "n", "bits", "payload"), map(list, zip(*sent)))))


def _split(values: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    starts = np.array([_range(o, owners)[0] for o in range(owners)], np.uint64)
    owner = np.searchsorted(starts, values, "right") - 1
    for o in np.unique(owner):
        yield int(o), values[owner == o]


def answers(messages: pd.DataFrame, owners: int) -> pd.DataFrame:
    """An owner's bitmaps: a row for each message with any fingerprint that another partition has sent too."""
    owner = int(messages["owner"].iloc[0])
    lists = [golomb.decode(p, n, _range(owner, owners)[0], b) for p, n, b in zip(messages["payload"], messages["n"], messages["bits"])]
    values, count = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[count > 1]
    maps = [np.isin(x, twice, assume_unique=True) for x in lists]
    keep = [i for i, m in enumerate(maps) if m.any()]
    return pd.DataFrame({"block": messages["block"].to_numpy()[keep], "owner": np.full(len(keep), owner, np.int32), "bitmap": [np.packbits(maps[i]).tobytes() for i in keep]})


def suspects(rows: pd.DataFrame, bitmaps: pd.DataFrame, owners: int) -> pd.DataFrame:
    """The rows of a block whose fingerprint is marked, or is there twice in the block itself."""
    own, count = np.unique(rows["fingerprint"].to_numpy().view(np.uint64), return_counts=True)
    marked = count > 1
    maps = dict(zip(bitmaps["owner"], bitmaps["bitmap"]))
    at = 0
    for owner, part in _split(own, owners):
        if owner in maps:
            marked[at : at + len(part)] |= np.unpackbits(np.frombuffer(maps[owner], np.uint8))[: len(part)].astype(bool)
        at += len(part)
    return rows[np.isin(rows["fingerprint"].to_numpy().view(np.uint64), own[marked])][["block", "pos", "doc_id", "sha"]]


def exact_groups(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and block, pos: where the row was read).

    docs: doc_id, text; other columns are not looked at. Texts are equal when identical after lower-casing A-Z.
    Null text counts as empty, and empty texts equal one another. Of equal texts the row with the largest doc_id
    stays; a null doc_id ranks below all, and of rows that repeat the largest doc_id exactly one stays. No rows give
    no rows. Texts are grouped by their bytes, of any length; should two texts share a SHA-256, the job fails.
    """
    spark = docs.sparkSession
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"kind int, {ROWS}, {MESSAGE}"
    sent = written(docs.select("doc_id", "text").mapInArrow(lambda b: fingerprints(b, owners), schema), "fingerprints", "kind")
    rows = sent.filter("kind = 0").select("block", "pos", "doc_id", "fingerprint", "sha")
    replies = sent.filter("kind = 1").select("block", "owner", "n", "bits", "payload").groupBy("owner").applyInPandas(lambda m: answers(m, owners), "block int, owner int, bitmap binary")
    found = written(
        rows.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(lambda a, b: suspects(a, b, owners), "block int, pos int, doc_id long, sha binary"), "suspects"
    )
    ids = found.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", lower_ascii(F.col("text")).alias("norm"))
    texts = texts.join(sized(ids, found.count()), texts["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    # the bytes themselves are the grouping key, combined before the shuffle; a text that isn't repeated after all drops out
    equal = texts.groupBy("norm").agg(F.count("*").alias("group_size")).filter("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    sure = F.when(F.count("*") == 1, F.max("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
    equal = equal.groupBy("sha").agg(sure.alias("group_size"))
    best = found.groupBy("sha").agg(F.max(F.struct("doc_id", -F.col("block"), -F.col("pos"))).alias("best"))
    groups = written(equal.join(best, "sha").select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col2")).alias("keep_block"), (-F.col("best.col3")).alias("keep_pos")), "groups")
    total = rows.count()
    both = attach(rows.select("block", "pos", "doc_id", "sha"), groups, ["sha"], "group_size", total)
    alone = F.col("group_size").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("block") == F.col("keep_block")) & (F.col("pos") == F.col("keep_pos")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "block",
        "pos",
    )


def deduplicated(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """docs, with all their columns, without the rows that exact_groups() drops.

    Rows that repeat both doc_id and text wholly are one row from then on.
    """
    groups = written(exact_groups(docs, owners), "kept")
    dropped = groups.filter("not kept").select("doc_id", F.col("text_sha256").alias("sha"))
    stay = groups.filter("kept and group_size > 1").select("doc_id", F.col("text_sha256").alias("sha"))
    n = dropped.count()

    def matching(left: DataFrame, right: DataFrame, how: str, sha) -> DataFrame:
        return left.join(sized(right, n), left["doc_id"].eqNullSafe(right["doc_id"]) & (sha(left) == right["sha"]), how)

    own = lambda df: df["sha"]
    of_text = lambda df: F.sha2(lower_ascii(df["text"]), 256)
    repeated = written(matching(stay, dropped, "left_semi", own), "repeated")
    left = matching(docs, matching(dropped, repeated, "left_anti", own).distinct(), "left_anti", of_text)
    if repeated.isEmpty():
        return left
    return matching(left, repeated, "left_anti", of_text).unionByName(matching(left, repeated, "left_semi", of_text).dropDuplicates(["doc_id", "text"]))
