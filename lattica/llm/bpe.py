"""Byte-level BPE encoding and decoding by a dynamic programme over prefixes.

Every prefix of a piece of text has one valid encoding, so the last token of that encoding is all that is stored for
it. The last token of a longer prefix is the one token that ends there and can follow the last token of the prefix
before it; two tokens can stand side by side if merging their joined bytes gives just these two. Appending bytes only
adds entries, and after an edit entries are worked out anew only until they agree with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces and pairs that a Python worker remembers at most.
MEMORY = 400_000
#: Token lengths in the order that they are tried in.
COMMON = (2, 3, 4, 1, 5, 6)


def ranks_of(rank_file: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # the tokenizers' engine takes \\s as the Unicode property, which leaves out 0x1C to 0x1F
        self.pattern = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))
        self.two_blanks = regex.compile("\\p{White_Space}{2}")
        self.ranks, self.most = ranks, max(map(len, ranks))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pieces = _Memory(lambda p: self.piece(p.encode()))
        self.runs = _Memory(lambda p: b"".join(map(self.pieces.__getitem__, self.pattern.findall(" " + p))))
        #: Tokens that merging never builds stand only for pieces that equal them.
        self.built = {t: r for t, r in ranks.items() if len(t) == 1 or self.split(r)}

    def merged(self, text: bytes, parts_left: int = 1) -> list[bytes]:
        """Plain merging of the adjacent pair of least rank, down to so many parts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > parts_left:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that were merged last in making this one; None for bytes and tokens that can't be made."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], 2)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens leaves them apart.

        Goes back in time from both tokens to their bytes: a is undone to its right half, or b to its left half,
        whichever was made later (of equal ones the right one, as merging goes from left to right). At each step the
        two parts at the border must not merge before one of them is taken up by its own token.
        """
        until_a = until_b = 1 << 60
        while True:
            crossing = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60)
            if crossing < until_a and (crossing <= until_b if until_b < 1 << 60 else crossing < 1 << 60):
                return False
            half_a, half_b = self.split(a), self.split(b)
            if half_a and (not half_b or a > b):
                until_a, a = a, half_a[1]
            elif half_b:
                until_b, b = b, half_b[0]
            else:
                return True

    def last_tokens(self, text: bytes, last: list[int], upto: int | None = None) -> None:
        """Extends last, the last token of every prefix of text (-1 for the empty one), by further prefixes.

        Just one token is valid at each, so lengths are tried in the order that mostly finds it soonest.
        """
        built, pairs, most = self.built.get, self.pairs, self.most
        if len(pairs) > MEMORY:
            pairs.clear()
        for end in range(len(last), (len(text) if upto is None else upto) + 1):
            for n in COMMON if end > 6 else range(end, 0, -1):
                start = end - n
                token = built(text[start:end])
                if token is None:
                    continue
                before = last[start]
                if before < 0:
                    break
                key = before << 32 | token
                known = pairs.get(key)
                if known is None:
                    known = pairs[key] = self.side_by_side(before, token)
                if known:
                    break
            else:
                for start in range(end - 7, max(0, end - most) - 1, -1):
                    token = built(text[start:end])
                    if token is not None and (last[start] < 0 or self.side_by_side(last[start], token)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def piece(self, text: bytes) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit numbers."""
        if text in self.ranks:
            return self.ranks[text].to_bytes(4, "little")
        last = [-1]
        self.last_tokens(text, last)
        return np.array(self.tokens(last), "<u4").tobytes()

    def tokens(self, last: list[int]) -> list[int]:
        """The tokens of the longest prefix, from the last tokens of all."""
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text. Where no blanks adjoin, each blank ' ' begins a match, so the parts between are looked up."""
        if self.two_blanks.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        if not rest:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        head = b"".join(map(self.pieces.__getitem__, self.pattern.findall(first)))
        return head + b"".join(map(self.runs.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memory(dict):
    """Values worked out when first asked for; forgotten all at once when there are MEMORY of them."""

    def __init__(self, work):
        self.work = work

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        self[key] = value = self.work(key)
        return value


class Piece:
    """The encoding of one piece of text that is appended to and edited; reworked: entries worked out so far."""

    def __init__(self, bpe: Bpe, text: bytes = b""):
        self.bpe, self.text, self.last, self.reworked = bpe, b"", [-1], 0
        self.append(text)

    def append(self, more: bytes) -> None:
        self.text += more
        self.bpe.last_tokens(self.text, self.last)
        self.reworked += len(more)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Puts new in place of bytes start to end. An entry depends on the entries up to the longest token before it;
        once so many agree with those of the old text, all later ones do."""
        old, shift = self.last, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        self.last, same = self.last[: start + 1], 0
        while len(self.last) <= len(self.text):
            at = len(self.last)
            if same >= self.bpe.most and at - shift > end + self.bpe.most:
                self.last += old[at - shift :]
                break
            self.bpe.last_tokens(self.text, self.last, at)
            self.reworked += 1
            same = same + 1 if at - shift > end and self.last[at] == old[at - shift] else 0

    def ids(self) -> list[int]:
        if self.text in self.bpe.ranks:
            return [self.bpe.ranks[self.text]]
        return self.bpe.tokens(self.last)


_made: dict[tuple[str, str], Bpe] = {}


def shared(rank_file: bytes, pattern: str) -> Bpe:
    """One encoder for each vocabulary in a Python worker, with what it has remembered."""
    key = hashlib.sha256(rank_file).hexdigest(), pattern
    if key not in _made:
        _made[key] = Bpe(ranks_of(rank_file), pattern)
    return _made[key]


def encoded(docs: DataFrame, rank_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """For each row: the kept columns, then ids (binary: little-endian unsigned 32-bit numbers).

    rank_path: a file on the driver; all its bytes are broadcast. Null text counts as empty and has no
    ids; texts of any length are encoded whole; rows that repeat stay; no rows give none. Columns not in keep (doc_id
    by default) are left out, so their names can't clash.
    """
    keep = keep or ["doc_id"]
    with open(rank_path, "rb") as f:
        ranks = f.read()
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(held.value, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids = [bpe.encode(t) if t else b"" for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(ids, pa.binary())], [*keep, "ids"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids binary")


def decoded(rows: DataFrame, rank_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """For each row that has ids: the kept columns, n_tokens, ids_sha256, decoded (binary: the text's bytes).

    Null ids give nulls; an id outside the vocabulary fails the job.
    """
    keep = keep or ["doc_id"]
    with open(rank_path, "rb") as f:
        ranks = f.read()
    held = rows.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(held.value, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids = part["ids"].to_pylist()
                n = [None if x is None else len(x) // 4 for x in ids]
                sha = [None if x is None else hashlib.sha256(x).hexdigest() for x in ids]
                text = [None if x is None else bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary())], [*keep, "n_tokens", "ids_sha256", "decoded"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "ids").mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded binary")
