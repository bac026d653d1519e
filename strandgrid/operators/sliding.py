"""Hamming distances of all windows of queries to all windows of texts, without a row for each window.

Along a diagonal of query and text, neighbouring windows share all bases but one. Bits of 64 diagonals lie in one number, and counts of equal bases
in one such number for each of their binary digits: blocks of four bases are counted, seven blocks summed, the block that leaves subtracted.
Any window has seven whole blocks; windows whose blocks have few enough misses are measured base by base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.dna import bases_of_texts, letters_of_codes

BLOCK = 4
#: Diagonals that are looked at together, a multiple of 64; windows of a piece of a query; bytes of texts (or one text).
DIAGONALS, PIECE, BYTES = 1 << 19, 256, 1 << 20
#: Windows that are measured at once.
MEASURED = 1 << 18
#: Bases of different queries that one task holds.
MOST_BASES = 1 << 24
_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _add(a: list[np.ndarray], b: list[np.ndarray], digits: int) -> list[np.ndarray]:
    """Sums of binary digits, least first, cut to so many digits."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i in range(digits):
        if i < len(b):
            x = a[i] ^ b[i]
            if carry is None:
                out.append(x)
                carry = a[i] & b[i]
            else:
                out.append(x ^ carry)
                if i + 1 < digits:
                    carry = np.bitwise_or(a[i] & b[i], np.bitwise_and(x, carry, out=x), out=x)
        elif i < len(a):
            out.append(a[i] ^ carry)
            if i + 1 < digits:
                carry = a[i] & carry
        else:
            out.append(carry)
            if i + 1 < digits:
                carry = np.zeros_like(carry)
    return out


def _subtract(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Differences of binary digits, none below 0."""
    out, borrow = [], None
    for i in range(len(a)):
        last = i + 1 == len(a)
        if i < len(b):
            x = a[i] ^ b[i]
            if borrow is None:
                out.append(x)
                borrow = b[i] & x
            else:
                out.append(x ^ borrow)
                if not last:
                    # where the digits differ the lower one decides, else what was borrowed
                    borrow = x & b[i] | borrow & ~x
        else:
            out.append(a[i] ^ borrow)
            if not last:
                borrow = borrow & out[-1]
    return out


def _least(digits: list[np.ndarray], least: int) -> np.ndarray:
    """Where numbers are at least so large (over 0)."""
    rest = least - 1
    out = None  # over rest: the highest digit in which they differ is the number's
    for i, x in enumerate(digits):
        if rest >> i & 1:
            out = np.zeros_like(x) if out is None else x & out
        else:
            out = x if out is None else x | out
    return out


def candidates(codes: np.ndarray, pieces: list[np.ndarray], k: int, misses: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, start in it, start in codes) of windows of k bases, among them all with so many misses at most. Pieces of at most PIECE + k - 1 bases."""
    blocks = (k - BLOCK + 1) // BLOCK
    digits = (blocks * BLOCK).bit_length()
    least = blocks * BLOCK - misses
    if blocks < 2 or least < 1:
        raise ValueError("windows too short for so many misses")
    longest = -(-max(len(p) for p in pieces) // 64) * 64
    padded = np.full(longest + -(-(len(codes) + longest) // 64) * 64 + 2 * 64, 4, np.uint8)
    padded[longest : longest + len(codes)] = codes
    sizes = np.array([len(p) for p in pieces])

    def windows(found: list[tuple], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = [len(x[2]) for x in found]
        piece, start = (np.repeat([x[i] for x in found], n) for i in (0, 1))
        at = np.concatenate([x[2] for x in found]) + first + start
        # no other blocks are the first whole ones of windows that begin up to so many bases before these
        for before in range(BLOCK):
            i, t = start - before, at - before
            ok = np.flatnonzero((i >= 0) & (i + k <= sizes[piece]) & (t >= 0) & (t + k <= len(codes)))
            yield piece[ok], i[ok], t[ok]

    # diagonal d has base i of a piece at padded[d + i]
    for lo in range(0, longest + len(codes), DIAGONALS):
        n = min(DIAGONALS, -(-(longest + len(codes) - lo) // 64) * 64)
        own = padded[lo : lo + n + longest + 64]
        own = np.append(own, np.full(n + longest + 64 - len(own), 4, np.uint8))
        equal = []
        for x in range(4):
            bits = np.packbits(own == x, bitorder="little").view(np.uint64)
            equal.append([bits[:-1], *[bits[:-1] >> np.uint64(s) | bits[1:] << np.uint64(64 - s) for s in range(1, 64)]])
        words = n // 64
        found, size = [], 0
        for number, piece in enumerate(pieces):
            held, total = [], None
            for j in range(len(piece) // BLOCK):
                four = [equal[piece[i]][i % 64][i // 64 : i // 64 + words] for i in range(BLOCK * j, BLOCK * j + BLOCK)]
                new = _add(_add(four[:1], four[1:2], 2), _add(four[2:3], four[3:4], 2), 3)
                total = _add(total, new, digits) if held else new
                held.append(new)
                if len(held) < blocks:
                    continue
                flags = _least(total, least)
                some = np.flatnonzero(flags)
                if len(some):
                    word, bit = np.nonzero(np.unpackbits(flags[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    found.append((number, BLOCK * (j + 1 - blocks), some[word] * 64 + bit))
                    size += len(word)
                    if size >= MEASURED:
                        yield from windows(found, lo - longest)
                        found, size = [], 0
                total = _subtract(total, held.pop(0))
        if found:
            yield from windows(found, lo - longest)


def _pieces(seqs: list[str], k: int) -> list[np.ndarray]:
    out = {}
    for s in seqs:
        for at in range(0, len(s) - k + 1, PIECE):
            out[s[at : at + PIECE + k - 1]] = None
    return [_CODE[np.frombuffer(s.encode(), np.uint8)] for s in out]


def _counts(windows: np.ndarray) -> np.ndarray:
    return np.stack([(windows == x).sum(1) for x in range(4)], axis=1).astype(float)


def hamming_search(docs: DataFrame, seqs: list[str], k: int, misses: int, radius: float, text: str = "text") -> DataFrame:
    """(query, hit, dist): the different windows of seqs (of A, C, G and T) and of the DNA of whole texts with so many misses at most, as shares of k,
    whose base counts have the centre of the hit's cell, of side 1, within radius."""
    spark = docs.sparkSession
    schema = "query string, hit string, dist double"
    pieces = _pieces(seqs, k)
    if not pieces:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(pieces)

    def near(codes: np.ndarray, at: np.ndarray, pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(k)
        begin = np.append(0, np.cumsum([len(p) for p in pieces]))
        bases = np.concatenate(pieces)
        for piece, i, t in candidates(codes, pieces, k, misses):
            for lo in range(0, len(t), MEASURED):
                start, p, s = t[lo : lo + MEASURED], piece[lo : lo + MEASURED], i[lo : lo + MEASURED]
                inside = np.flatnonzero(start + k <= at[np.searchsorted(at, start, "right")])
                start, p, s = start[inside], p[inside], s[inside]
                q, h = begin[p] + s, start
                n = np.zeros(len(h), np.int64)
                for x in range(k):
                    n += bases[q + x] != codes[h + x]
                ok = np.flatnonzero(n <= misses)
                q, h, n = bases[q[ok, None] + steps], codes[h[ok, None] + steps], n[ok]
                ok = np.flatnonzero(np.sqrt(((_counts(q) - _counts(h) - 0.5) ** 2).sum(1)) <= radius)
                if len(ok):
                    yield pa.record_batch([letters_of_codes(q[ok]), letters_of_codes(h[ok]), pa.array(n[ok] / k)], names=["query", "hit", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, "right")))
                some, at = b.slice(at, to - at), to
                codes, ends = bases_of_texts(some.column(0))
                if len(codes) >= k:
                    for found in near(codes, ends, pieces):
                        yield from pa.Table.from_batches([found]).group_by(found.schema.names).aggregate([]).to_batches()

    return docs.select(text).mapInArrow(run, schema).distinct()
