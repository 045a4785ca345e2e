"""PNG images in binary columns: greyscale encoding and decoding with checksum tests, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(samples: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) array.

    Each row takes the filter, of none, left and up, whose bytes (as signed numbers) have the least sum of sizes.
    """
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    choices = np.stack((samples, left, up))
    best = np.abs(choices.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
    height, width = samples.shape
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = choices[best, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """The samples of filtered lines, of one byte a sample; each line begins with its filter, 0 to 4.

    Left and none are undone for all lines at once; a run of up-lines is one running sum.
    """
    kind, x = lines[:, 0], lines[:, 1:].copy()
    if (kind > 4).any():
        raise ValueError("unknown PNG filter")
    x[kind == 1] = np.cumsum(x[kind == 1], axis=1, dtype=np.uint8)
    i = 0
    for i in np.flatnonzero((kind >= 2) & np.concatenate(([True], kind[1:] != kind[:-1]))):
        j = i + 1
        while j < len(kind) and kind[j] == kind[i]:
            j += 1
        above = x[i - 1] if i else np.zeros(x.shape[1], np.uint8)
        if kind[i] == 2:
            x[i:j] = np.cumsum(np.concatenate((above[None], x[i:j])), axis=0, dtype=np.uint8)[1:]
            continue
        for row in range(i, j):
            line, a, c = x[row], 0, 0
            for k in range(len(line)):
                b = int(above[k])
                if kind[i] == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[k] = a = (int(line[k]) + guess) & 255
                c = b
            above = line
    return x


def decode(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlace; ValueError for a wrong checksum, length or kind."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, shape, ended = 8, [], None, False
    while at + 12 <= len(png) and not ended:
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body, check = png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(check) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise ValueError(f"PNG chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit greyscale without interlace is read")
            shape = height, width
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"PNG chunk {kind!r} isn't known")
        at += 12 + n
    if not ended or shape is None:
        raise ValueError("the PNG ends early")
    raw = zlib.decompress(b"".join(data))
    if len(raw) != shape[0] * (shape[1] + 1):
        raise ValueError("PNG data of the wrong length")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1))


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


@lru_cache(4096)
def _edges(n: int) -> np.ndarray:
    return np.arange(SIDE + 1) * n // SIDE


def _shrunk(x: np.ndarray) -> np.ndarray:
    """Means over SIDE ranges of rows; with fewer rows than that, each row is repeated."""
    edges = _edges(len(x))
    if len(x) < SIDE:
        return x[edges[:-1]]
    return np.add.reduceat(x, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(samples: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the image, shrunk to 32 x 32, are over their median.

    The median leaves out the mean's own frequency. Similar images have hashes that differ in few bits.
    """
    small = _shrunk(_shrunk(samples.astype(np.float64)).T).T
    low = np.round(_cosines() @ small @ _cosines().T, 6).ravel()
    return int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), "big")


def payload_of(text: bytes) -> np.ndarray:
    """The bytes, padded with 0 to a positive multiple of WIDTH, as rows of samples."""
    height = max(1, -(-len(text) // WIDTH))
    out = np.zeros(height * WIDTH, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(height, WIDTH)


def with_media(rows: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For each row: the kept columns, then n_bytes and media (the PNG of its text's UTF-8 bytes, 64 samples a line).

    Null text counts as empty and gives one line of zeros; a text of any length is one image; equal texts give equal
    bytes; rows that repeat stay, and no rows give none. Columns not in keep (doc_id by default) are left out, so
    their names can't clash.
    """
    keep = keep or ["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b[text].cast(pa.large_binary()).to_pylist()]
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                yield pa.RecordBatch.from_arrays([*(b[c].slice(i, len(part)) for c in keep), pa.array(map(len, part), pa.int64()), pa.array([encode(payload_of(x)) for x in part], pa.binary())], [*keep, "n_bytes", "media"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, text).mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_bytes long, media binary")


FACTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def media_facts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of rows that have media (PNG bytes), and what reading the stored bytes back gives:

    payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256 and feature (the
    cosine hash as 16 hex digits). Null media give nulls; damaged media fail the job.
    """

    def facts(png: bytes | None) -> tuple:
        if png is None:
            return (None,) * len(FACTS)
        samples = decode(png)
        raw = samples.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png), hashlib.sha256(png).hexdigest(), f"{cosine_hash(samples):016x}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [facts(x) for x in b["media"].to_pylist()]
            columns = list(zip(*found)) or [[]] * len(FACTS)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(list(c), t) for c, t in zip(columns, FACTS.values()))], [*keep, *FACTS])

    kinds = dict(rows.dtypes)
    names = {pa.int64(): "long", pa.string(): "string"}
    return rows.select(*keep, "media").mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + ", ".join(f"{c} {names[t]}" for c, t in FACTS.items()))
