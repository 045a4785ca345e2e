"""URL rules in a sorted digest array: memory-mapped 64-bit xxhash keys, vectorised binary search, strings confirmed."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"DIGARR01"
#: Rule files over this are not sent to every executor; judged() then joins by key instead.
MOST_BYTES = 512 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; '' for null or without '://'."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def write_array(rules: list[Rule], path: str) -> None:
    """Header, sorted keys, string offsets, the rules' paths' lengths as they occur, then the strings themselves.

    Of rules with equal host and path, the last holds.
    """
    import xxhash

    strings = {r.text.encode(): r for r in rules}
    texts = sorted(strings, key=lambda t: (xxhash.xxh64_intdigest(t), t))
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
    host = np.array([len(strings[t].host.encode()) for t in texts], np.int64)
    block = np.array([strings[t].verdict == "block" for t in texts], np.int64)
    depths = np.unique([len(strings[t].path.encode()) for t in texts]).astype(np.int64)
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<QQ", len(texts), len(depths)))
        for x in (keys, at, host, block, depths):
            f.write(x.tobytes())
        f.write(b"".join(texts))


class DigestArray:
    """A file of write_array(), memory-mapped: only the pages that searches touch are read."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a digest array")
        n, d = struct.unpack("<QQ", bytes(raw[8:24]))
        numbers = raw[24 : 24 + 8 * (4 * n + 1 + d)]
        self.keys = numbers[: 8 * n].view(np.uint64)
        self.at = numbers[8 * n : 8 * (2 * n + 1)].view(np.int64)
        self.host = numbers[8 * (2 * n + 1) : 8 * (3 * n + 1)].view(np.int64)
        self.block = numbers[8 * (3 * n + 1) : 8 * (4 * n + 1)].view(np.int64)
        self.depths = numbers[8 * (4 * n + 1) :].view(np.int64).tolist()
        self.text = raw[24 + 8 * (4 * n + 1 + d) :]

    def find(self, probes: list[tuple[bytes, int]]) -> np.ndarray:
        """For each (string, its host's length) the place of the rule that is exactly this, or -1."""
        import xxhash

        digests = np.array([xxhash.xxh64_intdigest(p) for p, _ in probes], np.uint64)
        first, end = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        out = np.full(len(probes), -1, np.int64)
        for i in np.flatnonzero(end > first).tolist():
            for k in range(first[i], end[i]):  # more than one only if digests collide
                if self.host[k] == probes[i][1] and bytes(self.text[self.at[k] : self.at[k + 1]]) == probes[i][0]:
                    out[i] = k
        return out


def candidates(host: str, path: str, depths: list[int]) -> Iterator[tuple[bytes, int]]:
    """Every rule that could fit: the host and each domain above it, with each start of the path of a length in depths."""
    h, p = host.encode(), path.encode()
    while True:
        for d in depths:
            if d <= len(p):
                yield h + p[:d], len(h)
        _, dot, h = h.partition(b".")
        if not dot:
            return


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", keep: list[str] | None = None, otherwise: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The kept columns (page_id by default), host, path, rule and verdict of each row.

    A rule fits its own host and all below it if the path starts with the rule's. The longest that fits decides, by
    host and path together, of equal length the one with the longer host; with none, rule is null and verdict is
    otherwise. A null url, or one without '://', has an empty host and path. Rows that repeat stay; no rows give none;
    columns not kept can't clash. Rules go to executors as one file up to most_bytes; beyond that they are joined.
    """
    keep = keep or ["page_id"]
    spark = pages.sparkSession
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if sum(len(r.text.encode()) + 40 for r in rules) > most_bytes:
        return _joined(rows, rules, keep, otherwise)
    folder = tempfile.mkdtemp(prefix="digests-")  # on the driver only: addFile sends it to each executor
    write_array(rules, os.path.join(folder, name := f"{os.path.basename(folder)}.bin"))
    spark.sparkContext.addFile(os.path.join(folder, name))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            hosts, paths = b["host"].to_pylist(), b["path"].to_pylist()
            probes = [list(candidates(h, p, array.depths)) for h, p in zip(hosts, paths)]
            flat = [x for own in probes for x in own]
            found = array.find(flat) if flat else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(probes)), [len(x) for x in probes])
            best = np.full(len(probes), -1, np.int64)
            hit = np.flatnonzero(found >= 0)
            size = np.array([len(flat[i][0]) for i in hit], np.int64)
            order = np.lexsort((array.host[found[hit]], size, row[hit]))
            best[row[hit][order]] = found[hit][order]  # the last, so the longest, of each row stays
            rule = [None if k < 0 else bytes(array.text[array.at[k] : array.at[k + 1]]).decode() for k in best]
            verdict = [otherwise if k < 0 else "block" if array.block[k] else "allow" for k in best]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*b.schema.names, "rule", "verdict"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + ", rule string, verdict string")


def _joined(rows: DataFrame, rules: list[Rule], keep: list[str], otherwise: str) -> DataFrame:
    """The same by a shuffle join on (host, path), for more rules than should be sent to every executor."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in {r.text: r for r in rules}.values()], "rule_host string, rule_path string, v string")
    depths = sorted({len(r.path) for r in rules})
    labels = F.split("host", "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.array(*[F.substring("path", 1, d) for d in depths]))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    probes = rows.select("_row", F.explode(hosts).alias("rule_host"), "path").select("_row", "rule_host", F.explode(F.filter(starts, lambda s: F.lit(True))).alias("rule_path"))
    best = probes.join(table, ["rule_host", "rule_path"]).groupBy("_row").agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.concat("rule_host", "rule_path").alias("rule"), "v")).alias("b"))
    return rows.join(best, "_row", "left").select(*keep, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(otherwise)).alias("verdict"))
