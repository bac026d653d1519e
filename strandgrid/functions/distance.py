"""Distances between sequences and between vectors. Built-in expressions, but for the two alignment scores at the end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .ramanujan import rft
from .sequence import bases, distinct_kmers, reverse_complement


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def hamming(a: Column | str, b: Column | str, normalize: bool = False) -> Column:
    """Places that differ, over the shorter of the two."""
    x, y = bases(a), bases(b)
    n = F.least(F.size(x), F.size(y))
    d = F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: (p != q).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v)
    return d / F.length(_c(a)) if normalize else d


def edits(a: Column | str, b: Column | str, normalize: bool = False) -> Column:
    """Levenshtein distance; normalized by the length of a."""
    d = F.levenshtein(_c(a), _c(b)).cast("long")
    return d / F.length(_c(a)) if normalize else d


def bounded_edits(a: Column | str, b: Column | str, bound: int) -> Column:
    """Levenshtein distance up to bound, null beyond."""
    d = F.levenshtein(_c(a), _c(b), bound).cast("long")
    return F.when(d >= 0, d)


def strand_edits(a: Column | str, b: Column | str) -> Column:
    """The smaller of the distances to b and to its reverse complement."""
    return F.least(edits(a, b), edits(a, reverse_complement(b)))


def jaccard_distance(a: Column | str, b: Column | str, k: int = 4) -> Column:
    """1 - shared / all of the sets of k-mers."""
    x, y = distinct_kmers(a, k), distinct_kmers(b, k)
    return F.lit(1.0) - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def containment(a: Column | str, b: Column | str, k: int) -> Column:
    """Share of the k-mers of a that b has."""
    x, y = distinct_kmers(a, k), distinct_kmers(b, k)
    return F.size(F.array_intersect(x, y)) / F.size(x)


def l1(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def rounded(x: Column, places: int = 6) -> Column:
    """x, 0 or more, to so many decimal places, halves up; in plain numbers where these have the room, else by ``round``."""
    unit = float(10**places)
    return F.when(x < 1e9, F.floor(x * unit + 0.5) / unit).otherwise(F.round(x, places))


def minkowski(a: Column | str, b: Column | str, p: float) -> Column:
    """p = 1, 2, inf or any other positive power."""
    if p == 1:
        return l1(a, b)
    if p == 2:
        return l2(a, b)
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))
    if p == float("inf"):
        return F.array_max(diffs)
    return F.pow(_sum(F.transform(diffs, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))


def rft_sum_euclid(a: Column | str, b: Column | str, k: int) -> Column:
    """L2 over periods, each a sum of absolute entries over the four bases; one strand."""

    def periods(s: Column | str) -> Column:
        v = F.transform(rft(s, k, both_strands=False), lambda x: F.abs(x))
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda q: _sum(F.slice(v, q * 4 + 1, F.lit(4))))

    return l2(periods(a), periods(b))


def rft_concat_manhattan(a: Column | str, b: Column | str, k: int) -> Column:
    """L1 over all absolute entries; one strand."""
    absolute = lambda s: F.transform(rft(s, k, both_strands=False), lambda x: F.abs(x))
    return l1(absolute(a), absolute(b))


#: Letters of the planes: a base's code in three bits.
_PLANES = ("01010", "00110", "00001")


def planes(seq: Column | str) -> Column:
    """Three whole numbers whose bits are the codes of up to 62 bases of A, C, G, T and N."""
    return F.struct(*[F.conv(F.concat(F.lit("0"), F.translate(_c(seq), "ACGTN", bits)), 2, 10).cast("long").alias(f"p{i}") for i, bits in enumerate(_PLANES)])


def hamming_of_planes(a: Column | str, b: Column | str) -> Column:
    """Hamming distance of two sequences of one length, by their planes, in compiled code."""
    x, y = _c(a), _c(b)
    differ = [x[f"p{i}"].bitwiseXOR(y[f"p{i}"]) for i in range(3)]
    return F.bit_count(differ[0].bitwiseOR(differ[1]).bitwiseOR(differ[2])).cast("long")


# -- one sequence against many ----------------------------------------------------------------


class Patterns:
    """Sequences of one length, 64 at most, as bit masks of where each of their letters is."""

    def __init__(self, rows: list[str]):
        self.n, self.k = len(rows), len(rows[0])
        self.kind = np.uint32 if self.k <= 32 else np.uint64
        codes = np.frombuffer("".join(rows).encode("ascii"), np.uint8).reshape(self.n, self.k)
        self.masks = {int(c): ((codes == c) << np.arange(self.k, dtype=self.kind)).sum(1, dtype=self.kind) for c in np.unique(codes)}
        self.none = np.zeros(self.n, self.kind)

    def edits(self, text: str) -> np.ndarray:
        """Levenshtein distance of text to each: bit vectors of a column of the matrix, all rows at once."""
        one = self.kind(1)
        pv, mv = ~self.none, self.none.copy()
        xv, xh, ph, mh = (np.empty_like(pv) for _ in range(4))
        for c in text.encode("utf-8", "replace") if text.isascii() else map(ord, text):
            eq = self.masks.get(c, self.none)
            np.bitwise_or(eq, mv, out=xv)
            np.bitwise_and(eq, pv, out=xh)
            xh += pv
            xh ^= pv
            xh |= eq
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            np.bitwise_and(pv, xh, out=mh)
            ph <<= one
            ph |= one
            mh <<= one
            np.bitwise_or(xv, ph, out=pv)
            np.invert(pv, out=pv)
            pv |= mh
            np.bitwise_and(ph, xv, out=mv)
        # down the last column from its first entry, the length of the text
        within = self.kind((1 << self.k) - 1)
        return len(text) + np.bitwise_count(pv & within).astype(np.int64) - np.bitwise_count(mv & within)

    def hamming(self, text: str) -> np.ndarray:
        """Places that differ from text, over the shorter of the two."""
        n = min(self.k, len(text))
        same = self.none.copy()
        for c in set(text[:n]):
            same |= self.masks.get(ord(c), self.none) & self.kind(sum(1 << i for i in range(n) if text[i] == c))
        return n - np.bitwise_count(same).astype(np.int64)


def plain_edits(a: str, b: str) -> int:
    """Levenshtein distance of any two texts, for those that aren't patterns."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def to_all(texts: list[str], rows: list[str], metric: str) -> np.ndarray:
    """(row, text): edits or hamming of each text to each row, of any lengths and letters."""
    out = np.empty((len(rows), len(texts)), np.int32)
    kinds: dict[int, list[int]] = {}
    for i, x in enumerate(rows):
        kinds.setdefault(len(x) if 0 < len(x) <= 64 and x.isascii() else 0, []).append(i)
    for k, at in kinds.items():
        some = [rows[i] for i in at]
        if k:
            p = Patterns(some)
            one = p.edits if metric == "edits" else p.hamming
            out[at] = np.stack([one(t) for t in texts], axis=1)
        elif metric == "edits":
            out[at] = [[plain_edits(t, x) for t in texts] for x in some]
        else:
            out[at] = [[sum(p != q for p, q in zip(t, x)) for t in texts] for x in some]  # noqa: B905
    return out


# -- alignment scores: dynamic programming over Arrow batches --------------------------------

MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2, -3, 5, 2


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("ascii", "replace"), np.uint8)


#: In one number: a unit of score outweighs any number of columns, each of which takes one away.
_UNIT = 1 << 24


def local_alignments(queries: list[str], targets: list[str], at_once: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair, and the columns (gaps included) of the shortest alignment that has it.

    Affine gaps: a gap of n bases costs open + (n - 1) extend; N scores 0 against all.
    Pairs of like size go together, filled up with bases that match nothing; anti-diagonals of
    all their matrices are whole-array steps, so that no cell waits for its neighbour.
    """
    out = np.zeros(len(queries), np.int64)
    size = [len(q) + len(t) for q, t in zip(queries, targets, strict=True)]
    order = sorted(range(len(queries)), key=size.__getitem__)
    low = np.int64(-(1 << 60))
    match, mismatch, neutral = (np.int64(x * _UNIT - 1) for x in (MATCH, MISMATCH, 0))
    first, more = GAP_OPEN * _UNIT + 1, GAP_EXTEND * _UNIT + 1
    for at in range(0, len(order), at_once):
        own = order[at : at + at_once]
        m, n = max(len(queries[i]) for i in own), max(len(targets[i]) for i in own)
        if not m or not n:
            continue
        q = np.stack([_codes(queries[i].ljust(m, "<")) for i in own])
        t = np.stack([_codes(targets[i].ljust(n, ">")) for i in own])[:, ::-1]
        h1 = np.zeros((len(own), m + 1), np.int64)  # the last diagonal by row, and the one before it
        h2, best = h1.copy(), np.zeros(len(own), np.int64)
        e1, f1 = np.full_like(h1, low), np.full_like(h1, low)
        for d in range(2, m + n + 1):
            i0, i1 = max(1, d - n), min(m, d - 1) + 1
            a, b = q[:, i0 - 1 : i1 - 1], t[:, n - d + i0 : n - d + i1]
            s = np.where(a == b, match, mismatch)
            s[(a == 78) | (b == 78)] = neutral
            e = np.maximum(e1[:, i0:i1] - more, h1[:, i0:i1] - first)
            f = np.maximum(f1[:, i0 - 1 : i1 - 1] - more, h1[:, i0 - 1 : i1 - 1] - first)
            h = np.maximum(np.maximum(h2[:, i0 - 1 : i1 - 1] + s, 0), np.maximum(e, f))
            np.maximum(best, h.max(axis=1), out=best)
            h2, h1 = h1, np.zeros_like(h1)
            h1[:, i0:i1] = h
            e1, f1 = np.full_like(h1, low), np.full_like(h1, low)
            e1[:, i0:i1], f1[:, i0:i1] = e, f
        out[own] = best
    score = -(-out // _UNIT)
    return score, score * _UNIT - out


def local_scores(queries: list[str], targets: list[str], at_once: int = 128) -> np.ndarray:
    """Best Smith-Waterman score of each pair."""
    return local_alignments(queries, targets, at_once)[0]


def global_cost(a: str, b: str, match: float = -1.0, mismatch: float = 0.5, gap: float = 0.6) -> float:
    """Least cost of a global alignment."""
    x, y = _codes(a), _codes(b)
    steps = np.arange(len(y) + 1) * gap
    row = steps.copy()
    for i, c in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i * gap
        new[1:] = np.minimum(row[:-1] + np.where(y == c, match, mismatch), row[1:] + gap)
        row = np.minimum.accumulate(new - steps) + steps  # gaps along the row
    return float(row[-1])


@F.pandas_udf(LongType())
def smith_waterman(query: pd.Series, target: pd.Series) -> pd.Series:
    known = (query.notna() & target.notna()).to_numpy()
    out = pd.Series([None] * len(query), dtype="Int64")
    out[known] = local_scores(query[known].to_list(), target[known].to_list())
    return out


@F.pandas_udf(StructType([StructField("score", LongType()), StructField("aln_len", LongType())]))
def smith_waterman_aligned(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Score, and columns of the alignment."""
    known = (query.notna() & target.notna()).to_numpy()
    out = pd.DataFrame({"score": pd.Series([None] * len(query), dtype="Int64"), "aln_len": pd.Series([None] * len(query), dtype="Int64")})
    found = local_alignments(query[known].to_list(), target[known].to_list())
    out.loc[known, "score"], out.loc[known, "aln_len"] = found
    return out


@F.pandas_udf(DoubleType())
def needleman_wunsch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([global_cost(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def percent_identity(score: Column | str, length: Column | str) -> Column:
    """Score as a share of the best one that so many bases can have."""
    return _c(score) / (F.lit(2.0) * _c(length)) * 100


def all_distances(a: Column | str, b: Column | str, k: int) -> Column:
    """Struct of five distances of two sequences of k bases."""
    return F.struct(hamming(a, b).alias("hamming"), needleman_wunsch(_c(a), _c(b)).alias("needle"), jaccard_distance(a, b).alias("subkmer"), rft_sum_euclid(a, b, k).alias("rft_sum_euclid"), rft_concat_manhattan(a, b, k).alias("rft_concat_manhattan"))
