"""Token-id output: best-fit-decreasing packing into rows of one width, with offsets and position resets.

Documents are encoded, those longer than a row split without loss, and pieces dealt by hash to groups of a bounded
number of tokens. In each, by decreasing length, a piece goes into the row that it leaves least room in; a segment tree
over rows' room finds it. So memory is bounded by a group, and the rows don't depend on how the input is partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import ranks_of
from lattica.llm.tables import written

WIDTH = 2048
#: Tokens of a group, more or less; a group never holds twice as many.
GROUP_TOKENS = 1 << 22


class Capacities:
    """Rows by the room they have left: a segment tree over room sizes that counts rows, and the rows of each size."""

    def __init__(self, width: int):
        self.leaves = 1 << (width).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room that is at least so much, and that room; the row put last if several are alike."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Which pieces go into each row: by decreasing length (then as given), each where it leaves least room."""
    rows: list[list[int]] = []
    free = Capacities(width)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            row, room = len(rows), width
            rows.append([])
        else:
            row, room = found
        rows[row].append(i)
        free.put(row, room - n)
    return rows


@lru_cache(4)
def _encoding(rank_file: bytes, pattern: str):
    """The library's encoder, one for each vocabulary in a Python worker, and the first id left free."""
    import tiktoken

    ranks = ranks_of(rank_file)
    return tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


SCHEMA = "pack_id long, doc_ids array<long>, parts array<int>, n_tokens int, ids binary, cu_seqlens array<int>, positions binary"


def packed_ids(docs: DataFrame, rank_path: str, pattern: str, width: int = WIDTH, pad: int | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Rows of width token ids: pack_id, doc_ids and parts (of each segment), n_tokens, ids, cu_seqlens, positions.

    ids and positions: width little-endian unsigned 32-bit numbers each, so that ids of rows one upon another are a
    matrix; unused places at the end hold pad (the first id that the vocabulary leaves free, by default) and position 0.
    cu_seqlens: where segments begin and the last one ends. positions start from 0 in each segment. A document of more
    than width tokens is split into parts 0, 1, ... of width tokens and a rest, which joined give all its ids. Null or
    empty texts have no tokens and are in no row; documents that repeat are all packed; a null doc_id stays null; no
    rows give none; other columns aren't looked at. pack_id is unique.
    """
    with open(rank_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("pack_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = _encoding(held.value, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                out: list[tuple[int | None, int, int, bytes]] = []
                for doc_id, text in zip(b["doc_id"].slice(i, 1024).to_pylist(), b["text"].slice(i, 1024).to_pylist()):
                    ids = np.array(encoding.encode_ordinary(text), "<u4").tobytes() if text else b""
                    out += [(doc_id, k // width, min(width, len(ids) // 4 - k), ids[4 * k : 4 * (k + width)]) for k in range(0, len(ids) // 4, width)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "part", "n", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, free = _encoding(held.value, pattern)
        fill = free if pad is None else pad
        group: list[tuple[int | None, int, bytes]] = []
        at, tokens, next_id = None, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            lengths = np.array([len(ids) // 4 for _, _, ids in group], np.int64)
            rows = best_fit(lengths, width)
            for start in range(0, len(rows), 512):
                out = []
                for row in rows[start : start + 512]:
                    ends = np.concatenate(([0], np.cumsum(lengths[row]))).astype(np.int32)
                    ids, positions = np.full(width, fill, "<u4"), np.zeros(width, "<u4")
                    ids[: ends[-1]] = np.frombuffer(b"".join(group[i][2] for i in row), "<u4")
                    positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
                    out.append((next_id, [group[i][0] for i in row], [group[i][1] for i in row], int(ends[-1]), ids.tobytes(), ends, positions.tobytes()))
                    next_id += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            group.clear()

        for b in batches:  # groups one after another, sorted
            for own, doc_id, part, n, ids in zip(*(b[c].to_pylist() for c in ("group", "doc_id", "part", "n", "ids"))):
                if group and (own != at or tokens + n > 2 * group_tokens):  # the latter where one group has many repeated rows
                    yield from flush()
                    tokens = 0
                if own != at:
                    at, next_id = own, own << 33
                group.append((doc_id, part, ids))
                tokens += n
        if group:
            yield from flush()

    pieces = written(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, part int, n int, ids binary"), "pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = -(-total // group_tokens) or 1
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "part", "ids"), F.lit(groups)))
    return dealt.repartition("group").sortWithinPartitions("group", F.desc("n"), "doc_id", "part", "ids").mapInArrow(pack, SCHEMA)


DIGESTS = "pack_id long, doc_ids array<long>, parts array<int>, n_tokens int, cu_seqlens array<int>, ids_sha256 string, positions_sha256 string, max_position int"


def pack_digests(packs: DataFrame) -> DataFrame:
    """packs with ids and positions as SHA-256, and the largest position."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, positions = b["ids"].to_pylist(), b["positions"].to_pylist()
            sha = [[hashlib.sha256(x).hexdigest() for x in c] for c in (ids, positions)]
            top = [int(np.frombuffer(x, "<u4").max(initial=0)) for x in positions]
            yield pa.RecordBatch.from_arrays([b["pack_id"], b["doc_ids"], b["parts"], b["n_tokens"], b["cu_seqlens"], pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string()), pa.array(top, pa.int32())], ["pack_id", "doc_ids", "parts", "n_tokens", "cu_seqlens", "ids_sha256", "positions_sha256", "max_position"])

    return packs.mapInArrow(work, DIGESTS)
