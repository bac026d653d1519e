"""Words of UTF-8 texts and their 64-bit hashes, by whole-array arithmetic."""

from __future__ import annotations

import numpy as np

from .common import WS_BYTES, lower_bytes

#: Bytes hashed at once; a longer text goes piece by piece, cut at white space.
PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_WS = np.zeros(256, bool)
_WS[list(WS_BYTES)] = True
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n."""
    if len(_pow[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        inv = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inv)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = x.copy()
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(m)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each range, equal for equal contents and lengths."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([True], _WS[buf], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends, range_hashes(buf.astype(np.uint64) + np.uint64(1), starts, ends)


def words(raw: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of a text, in bytes; hashes of the word with A to Z in lower case."""
    raw = lower_bytes(raw) if lower else raw
    buf = np.frombuffer(raw, np.uint8)
    if len(buf) <= PIECE:
        return _words(buf)
    found, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        while end < len(buf) and not _WS[buf[end]]:
            end += 1
        s, e, h = _words(buf[at:end])
        found.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def code_points_before(raw: bytes, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte offset."""
    if raw.isascii():
        return at
    buf = np.frombuffer(raw, np.uint8)
    n = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=n[1:])
    return n[at]
