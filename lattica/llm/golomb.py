"""Golomb-Rice coding of sorted distinct 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bits that decode() lists at once.
WINDOW = 1 << 18


def rice_bits(span: int, n: int) -> int:
    """The remainder bits that suit n numbers spread over a range."""
    return max(0, min(57, int(span // max(n, 1)).bit_length() - 1))


def encode(values: np.ndarray, start: int, bits: int) -> bytes:
    """values ascend and none is below start; each gap is a unary quotient ended by 1, then bits remainder bits."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=U(start))
    q, r = (gaps >> U(bits)).astype(np.int64), gaps & U((1 << bits) - 1)
    ends = np.cumsum(q + 1 + bits)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - bits - 1] = 1
    for k in range(bits):
        out[ends - 1 - k] = (r >> U(k)) & U(1)
    return np.packbits(out).tobytes()


def decode(blob: bytes, n: int, start: int, bits: int) -> np.ndarray:
    """The n numbers that encode() was given."""
    if not n:
        return np.zeros(0, U)
    raw = np.unpackbits(np.frombuffer(blob, np.uint8))
    stops, at = np.empty(n, np.int64), 0
    if bits:  # ones among remainder bits end no quotient: step from stop to stop
        i, wide = 0, WINDOW
        while i < n:
            own = np.flatnonzero(raw[at : at + wide])
            end = min(wide, len(raw) - at)
            follow = np.append(own, end)[np.searchsorted(own, np.arange(end))].tolist()
            p = 0
            while i < n and p < end and follow[p] < end:
                stops[i] = at + follow[p]
                p = follow[p] + 1 + bits
                i += 1
            at, wide = at + p, wide if p else 2 * wide
    else:
        stops[:] = np.flatnonzero(raw)[:n]
    begin = np.concatenate(([0], stops[:-1] + 1 + bits))
    gaps = (stops - begin).astype(U) << U(bits)
    for k in range(bits):
        gaps |= raw[stops + bits - k].astype(U) << U(k)
    return np.cumsum(gaps, dtype=U) + U(start)
