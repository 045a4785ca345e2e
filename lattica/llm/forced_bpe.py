"""Byte-level BPE encoding and decoding with cuts that the vocabulary forces.

A pair of adjacent bytes that no token has inside can never be taken up by a merge, so a text may be cut there: what
stands on both sides is encoded by itself, and the ids are put one after another. Two kinds of cuts are made. In a whole
batch of texts at once, those forced cuts where white space follows something else, at which a match of the pattern begins
whatever stands around it; this gives words with the blanks before them, which repeat and are remembered. Inside
each match of the pattern in such a word, all forced cuts; the fragments are merged by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.textvec import buffers, slices

#: A Python worker forgets its words once there are so many, or of so many bytes: a text without blanks is one word.
MEMORY, MEMORY_BYTES = 300_000, 32 << 20
#: Fragments of more bytes are merged one by one, with a heap.
SHORT = 48
NEVER = 1 << 60
WHITE = "".join(regex.findall(r"\p{White_Space}", "".join(map(chr, range(0x3001)))))
#: The pattern of byte-level pre-tokenizers, with white space as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The characters that byte-level vocabularies write bytes 0 to 255 with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ForcedBpe:
    """An encoder made from a tokenizer file's JSON: byte-level BPE with the usual pattern and plain special tokens."""

    def __init__(self, file: bytes):
        d = json.loads(file)
        model, pre = d["model"], d["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("single_word", "lstrip", "rstrip") if any(t[k] for t in d["added_tokens"])]
        if d["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or odd:
            raise ValueError(f"not a plain byte-level BPE: {odd or 'normalizer or pre-tokenizer'}")
        self.file, self._library = file, None
        self.pattern = regex.compile(PATTERN)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = model["vocab"]
        as_bytes = lambda t: bytes(byte_of[c] for c in t)
        self.bytes_of = {i: as_bytes(t) for t, i in vocabulary.items()}
        self.byte_ids = np.array([vocabulary[c] for c in byte_letters()], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        #: Rank of two ids side by side, at the first times 2**32 plus the second; the id of both merged, by rank.
        self.rank_of = {vocabulary[a] << 32 | vocabulary[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.fromiter(self.rank_of, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: For bytes a and b, at 256 * a + b: whether no token has them side by side, so that a cut between them is certain.
        inside = np.zeros(65536, bool)
        for t in self.bytes_of.values():
            x = np.frombuffer(t, np.uint8).astype(np.uint16)
            inside[x[:-1] << 8 | x[1:]] = True
        self.forced = ~inside
        last, blanks = {w.encode()[-1] for w in WHITE}, "".join(w for w in WHITE if w < "\x80").encode()
        after, blank = np.array([b not in last for b in range(256)]), np.isin(np.arange(256), list(blanks))
        #: Forced cuts that begin a match of the pattern as well: white space after what isn't.
        self.certain = self.forced & np.repeat(after, 256) & np.tile(blank, 256)
        #: Words that begin with white space and end with something else.
        self.inner = re.compile(b"[" + re.escape(blanks) + b"].*[^" + re.escape(bytes(sorted(last))) + b"]", re.DOTALL)
        self.words: dict[bytes, bytes] = {}
        self.held = 0  # bytes of these words

    def matches(self, text: str) -> list[str]:
        """The pattern's matches. Characters younger than Python's tables are left to the library's own tables."""
        if text.isascii() or not any(c > "\u0557" and unicodedata.category(c) == "Cn" for c in text):
            return self.pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.file.decode()).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def merged(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids after all merges, and where each of the fragments that begin at `at` (with the end) begins then.

        In each round every fragment merges its pair of least rank, of equals the first; fragments without one are done.
        Fragments of over SHORT bytes are merged one by one.
        """
        n, size = len(at) - 1, np.diff(at)
        parts, of = [], []
        for f in np.flatnonzero(size > SHORT).tolist():
            parts.append(np.array(self.merged_long(ids[at[f] : at[f + 1]].tolist()), np.int32))
            of.append(np.full(len(parts[-1]), f))
        frag = np.repeat(np.arange(n), size)
        short = (size <= SHORT)[frag]
        ids, frag = ids[short], frag[short]
        rank = self.ranks(ids, frag, np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
            length = np.diff(np.concatenate((first, [len(ids)])))
            least = np.minimum.reduceat(rank, first)
            going = np.repeat(least < NEVER, length)
            parts.append(ids[~going])
            of.append(frag[~going])
            hit = np.flatnonzero((rank == np.repeat(least, length)) & going)
            if not len(hit):
                break
            hit = hit[np.concatenate(([True], frag[hit[1:]] != frag[hit[:-1]]))]
            ids[hit] = self.made[rank[hit]]
            going[hit + 1] = False
            new = np.cumsum(going) - 1
            ids, frag, rank, hit = ids[going], frag[going], rank[going], new[hit]
            near = np.concatenate((hit, hit[hit > 0] - 1))
            rank[near] = self.ranks(ids, frag, near)
        all_of = np.concatenate(of) if of else np.zeros(0, np.int64)
        order = np.argsort(all_of, kind="stable")
        out = np.concatenate(parts)[order] if parts else np.zeros(0, np.int32)
        return out, np.concatenate(([0], np.cumsum(np.bincount(all_of, minlength=n))))

    def ranks(self, ids: np.ndarray, frag: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the ids at some places with their right neighbours of the same fragment; NEVER where they don't merge."""
        right = np.minimum(at + 1, len(ids) - 1)
        pair = ids[at].astype(np.int64) << 32 | ids[right]
        i = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[i] == pair) & (frag[at] == frag[right]) & (at + 1 < len(ids)), self.pair_ranks[i], NEVER)

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a linked list and a heap of pairs, for fragments of any length."""
        n, rank_of = len(ids), self.rank_of
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank, i, pair) for i, pair in enumerate(a << 32 | b for a, b in zip(ids, ids[1:])) if (rank := rank_of.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ids[i] << 32 | ids[j] != pair:
                continue  # one of the two has been merged since
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for left, right in ((i, k), (before[i], i)):
                if left >= 0 and right >= 0 and (rank := rank_of.get(pair := ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (rank, left, pair))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids, as 32-bit numbers, of words: bytes that begin and end at certain cuts or a text's ends."""
        text = b"".join(words).decode()
        young = [] if text.isascii() else [c for c in set(text) if c > "\u0557" and unicodedata.category(c) == "Cn"]
        apart = regex.compile("[" + regex.escape("".join(young)) + "]") if young else None
        # words in a row are matched in one go, unless white space would run on from one to the next
        plain = [self.inner.fullmatch(w) is not None and not (apart and apart.search(w.decode())) for w in words]
        matches: list[str] = self.pattern.findall(b"".join(w for w, ok in zip(words, plain) if ok).decode())
        words = [w for w, ok in zip(words, plain) if ok] + (others := [w for w, ok in zip(words, plain) if not ok])
        for w in others:
            matches += self.matches(w.decode())
        data = np.frombuffer(b"".join(words), np.uint8)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))))
        x = data.astype(np.uint16)
        cut = np.append(self.forced[x[:-1] << 8 | x[1:]], True)
        cut = np.append(True, cut)
        cut[chars[starts]] = True
        at = np.flatnonzero(cut)
        ids, begin = self.merged(self.byte_ids[data], at)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        stops = (begin[np.searchsorted(at, ends)] * 4).tolist()
        raw = ids.astype("<i4").tobytes()
        self.held += len(data)
        self.words.update(zip(words, (raw[i:j] for i, j in zip([0, *stops], stops))))

    def encode_column(self, column: pa.Array) -> pa.Array:
        """A list of ids for each text; null counts as empty. Texts with special tokens are cut there first."""
        data, at = buffers(column)
        raw = data.tobytes()
        if len(data) > 1:
            x = data.astype(np.uint16)
            cuts = np.flatnonzero(self.certain[x[:-1] << 8 | x[1:]]) + 1
        else:
            cuts = np.zeros(0, np.int64)
        special: list[tuple[int, int, int]] = []
        if any(t.encode() in raw for t in self.special):
            special = self._specials_in(raw, at)
        known = {i: token for i, _, token in special}
        if special:
            s = np.array(special)
            within = np.searchsorted(s[:, 0], cuts, "right") - 1
            cuts = cuts[(within < 0) | (cuts >= s[np.maximum(within, 0), 1])]
            cuts = np.concatenate((cuts, s[:, 0], s[:, 1]))
        edges = np.unique(np.concatenate((cuts, at)))
        ends = edges.tolist()
        words = [b"" if i in known else raw[i:j] for i, j in zip(ends, ends[1:])] if known else [raw[i:j] for i, j in zip(ends, ends[1:])]
        if len(self.words) > MEMORY or self.held > MEMORY_BYTES:
            self.words, self.held = {}, 0
        new = [w for w in dict.fromkeys(words) if w and w not in self.words]
        if new:
            self.learn(new)
        pieces = [self.words[w] if w else np.int32(known[i]).tobytes() for i, w in zip(ends, words)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2
        total = np.concatenate(([0], np.cumsum(lengths)))
        offsets = total[np.searchsorted(edges, at)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(pieces), np.int32), pa.int32()))

    def _specials_in(self, raw: bytes, at: np.ndarray) -> list[tuple[int, int, int]]:
        """First byte, end and id of every special token in a row, in order."""
        out = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            done, place = 0, i
            text = raw[i:j].decode()
            for m in self.specials.finditer(text):
                place += len(text[done : m.start()].encode())
                size = len(m[0].encode())
                out.append((place, place + size, self.special[m[0]]))
                place, done = place + size, m.end()
        return out

    def decode(self, ids) -> str:
        """The text of ids; unknown ids are left out, bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode(errors="replace")


_made: dict[str, ForcedBpe] = {}


def shared(file: bytes) -> ForcedBpe:
    """One encoder for each tokenizer file in a Python worker, with what it has remembered."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _made:
        _made[key] = ForcedBpe(file)
    return _made[key]


def encoded(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None) -> DataFrame:
    """For each row: the kept columns (doc_id by default), then ids (array of int).

    tokenizer_path: a file on the driver; all its bytes (a few MB) are broadcast. Null text counts as empty and has no
    ids; texts of any length are encoded whole; rows that repeat stay; no rows give none. Special tokens in a text become their
    ids, as the tokenizers library does unless told otherwise. Columns not in keep are left out, so their names can't clash.
    """
    keep = keep or ["doc_id"]
    with open(tokenizer_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(held.value)
        for b in batches:
            _, at = buffers(b["text"])
            for i, j in slices(at):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), bpe.encode_column(part["text"])], [*keep, "ids"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids array<int>")


def decoded(rows: DataFrame, tokenizer_path: str, keep: list[str] | None = None) -> DataFrame:
    """For each row with ids: the kept columns (doc_id and ids by default), then decoded (string); null ids give null.

    Special tokens stay; ids outside the vocabulary are left out, as the tokenizers library does.
    """
    keep = keep or ["doc_id", "ids"]
    with open(tokenizer_path, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(held.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = part["ids"]
                values, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                text = [bpe.decode(values[s:e].tolist()) if ok else None for s, e, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(text, pa.string())], [*keep, "decoded"])

    kinds = dict(rows.dtypes)
    return rows.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", decoded string")


def decimal_sha256(ids: Column) -> Column:
    """Lowercase hex SHA-256 of ids written in decimal and joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
