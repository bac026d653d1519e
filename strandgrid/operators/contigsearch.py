"""The contig search contig by contig: projection, cells, sections, matches and alignments in one pass over the texts.

Only cells near a window of a query matter, and these are known from the queries, which are few: no other section is kept and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.distance import GAP_EXTEND, GAP_OPEN, MATCH, MISMATCH, local_scores
from ..functions.ramanujan import phi, sums
from ..sources.dna import bases_of_texts
from .grid import side32
from .matches import _places

#: Bytes of texts (or one text) that are looked at together; windows that are projected at once; alignments that are bounded, and made, at once.
BYTES, WINDOWS, BOUNDED, ALIGNED = 1 << 20, 1 << 14, 1 << 12, 1 << 11
#: Bases of targets that are held for these: without a cap a match may be a long chain.
BASES = 1 << 23
#: Windows of queries, and matches with a batch, that one task holds.
MOST_WINDOWS = 1 << 14
_FILTER = 1 << 22
_Q = 5


class Projection:
    """``pca.project`` of the windows of base codes, by tables: what a place and the one opposite to it on the other strand add depends on their two bases alone."""

    def __init__(self, model: dict, d: int):
        k = self.k = model["k"]
        center, scale, rotation = np.array(model["center"]), np.array(model["scale"]), np.array(model["rotation"])[:d]
        if not model.get("both_strands", True):
            raise ValueError("tables are for both strands")
        self.start = -(center / scale) @ rotation.T
        share = np.array(sums(k), float) / (np.array([phi(q) for q in range(1, k + 1)], float) * k)[:, None]
        # what base x at place p adds
        adds = np.einsum("qp,qxd->pxd", share, (rotation / scale).T.reshape(k, 4, d))
        one = {}
        for p in range((k + 1) // 2):
            o = k - 1 - p
            for x in range(4):
                for y in range(4) if o > p else (x,):
                    one[p, x, y] = sum(adds[p, b] for b in {x, 3 - y}) + (sum(adds[o, b] for b in {y, 3 - x}) if o > p else 0)
        self.tables = []
        places = list(range(k // 2))
        for at in range(0, len(places), 3):
            own = places[at : at + 3]
            rows = [sum(one[p, xy >> 2, xy & 3] for p, xy in zip(own, each, strict=True)) for each in product(range(16), repeat=len(own))]
            self.tables.append((own, np.array(rows)))
        self.middle = np.array([one[k // 2, x, x] for x in range(4)]) if k % 2 else None

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """(window, dimension) of all windows."""
        k, n = self.k, len(codes) - self.k + 1
        wide = codes.astype(np.uint16)
        pair = lambda p: wide[p : p + n] << np.uint16(2) | wide[k - 1 - p : k - 1 - p + n]
        out = np.tile(self.start, (n, 1)) if self.middle is None else (self.middle + self.start)[codes[k // 2 : k // 2 + n]]
        for places, rows in self.tables:
            at = pair(places[0])
            for p in places[1:]:
                at = at << np.uint16(4) | pair(p)
            out += rows.take(at, axis=0)
        return out


def _key(cells: np.ndarray) -> np.ndarray:
    """Cells of up to four numbers of 16 bits as one number each; those beyond have none of theirs in common with ``Near``."""
    out = np.zeros(len(cells), np.uint64)
    for i in range(cells.shape[1]):
        out = out << np.uint64(16) | np.clip(cells[:, i] + (1 << 15), 0, (1 << 16) - 1).astype(np.uint64)
    return out


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)


class Near:
    """Ranges of queries by the cells whose centre is within radius of one of their windows (query number, q_start, q_end, vector)."""

    def __init__(self, windows: list[tuple], radius: float, side: float, k: int):
        self.side = side32(side)
        query, start, end = (np.array([w[i] for w in windows], np.int64) for i in range(3))
        v = np.array([w[3] for w in windows], float)
        reach = ceil(radius / self.side) + 1
        steps = np.array(list(product(range(-reach, reach + 1), repeat=v.shape[1])))
        home = np.floor(v / self.side).astype(np.int64)
        if np.abs(home).max(initial=0) + reach >= 1 << 15:
            raise OverflowError("cells beyond 16 bits")
        own, keys = [], []
        for i in range(len(v)):
            cells = home[i] + steps
            total = np.zeros(len(cells))
            for x in range(v.shape[1]):
                total += (v[i, x] - (cells[:, x] * self.side + self.side / 2)) ** 2
            keys.append(_key(cells[np.sqrt(total) <= radius]))
            own.append(np.full(len(keys[-1]), i))
        own, keys = np.concatenate(own), np.concatenate(keys)
        order = np.lexsort((end[own], start[own], query[own], keys))
        own, keys = own[order], keys[order]
        # ranges of a query and a cell joined where one starts at most k after the end of the one before it
        new = np.ones(len(own), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (query[own[1:]] != query[own[:-1]]) | (start[own[1:]] > end[own[:-1]] + k)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1
        self.query, self.start, self.end = query[own[first]], start[own[first]], end[own[last]]
        self.keys, self.begin = np.unique(keys[first], return_index=True)
        self.count = np.diff(np.append(self.begin, len(first)))
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[_slot(self.keys)] = True


def matches_of(codes: np.ndarray, at: np.ndarray, project: Projection, near: Near, cap: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, query number, q_start, q_end, t_start, t_end): what ``search.contig_matches`` finds in texts that begin at ``at`` of the codes, with cap as there."""
    k = project.k
    found, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for lo in range(0, max(len(codes) - k + 1, 0), WINDOWS):
        v = project(codes[lo : lo + WINDOWS + k - 1])
        key = _key(np.floor(v / near.side).astype(np.int64))
        i = np.flatnonzero(near.maybe[_slot(key)])
        found.append(lo + i)
        keys.append(key[i])
    window, key = np.concatenate(found), np.concatenate(keys)
    number = np.minimum(np.searchsorted(near.keys, key), len(near.keys) - 1)
    text = np.searchsorted(at, window, "right") - 1
    ok = (near.keys[number] == key) & (window + k <= at[text + 1])
    window, number, text = window[ok], number[ok], text[ok]
    if not len(window):
        return (np.empty(0, np.int64),) * 6
    # sections: neighbouring windows of a text in one cell
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1] + 1) | (number[1:] != number[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    text, number = text[first], number[first]
    start, end = window[first] - at[text], window[last] - at[text] + k
    n = near.count[number]
    own = np.repeat(np.arange(len(n)), n)
    r = np.repeat(near.begin[number], n) + _places(n)
    rows = [text[own], near.query[r], near.start[r], near.end[r], start[own], end[own]]
    order = np.lexsort((rows[5], rows[3], rows[4], rows[2], rows[1], rows[0]))
    text, query, qs, qe, ts, te = (x[order] for x in rows)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (query[1:] != query[:-1])
    if cap:
        kept = _places(np.diff(np.append(np.flatnonzero(new), len(new)))) < cap
        text, query, qs, qe, ts, te, new = (x[kept] for x in (text, query, qs, qe, ts, te, new))
    new[1:] |= (qs[1:] > qe[:-1] + k) | (ts[1:] > te[:-1] + k)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(new)) - 1
    return text[a], query[a], qs[a], qe[b], ts[a], te[b]


def _needed(n: np.ndarray, identity: float) -> np.ndarray:
    """How many q-grams of n bases an alignment of so many per cent has at least: each of its errors takes at least 5 from twice n,
    and the bases that match lie in one run more than there are errors."""
    least = np.ceil(MATCH * n * identity / 100 - 1e-6).astype(np.int64)
    errors = np.maximum((MATCH * n - least) // 5, 0)
    return -(-(least + 3 * errors) // 2) - (_Q - 1) * (errors + 1)


def _grams(codes: np.ndarray) -> np.ndarray:
    n = max(len(codes) - _Q + 1, 0)
    out = np.zeros(n, np.int32)
    for i in range(_Q):
        out = out << 2 | codes[i : i + n]
    return out


def _together(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Parts of so many rows at most, of ``BASES`` at most if all were as long as the longest, one row at least."""
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, min(most, BASES // max(1, int(sizes[lo : lo + most].max()))))
        yield slice(lo, hi)
        lo = hi


def may_reach(query: np.ndarray, qs: np.ndarray, qe: np.ndarray, target: np.ndarray, ts: np.ndarray, te: np.ndarray, identity: float) -> np.ndarray:
    """Which of the pairs of ranges of two arrays of codes have the q-grams in common that an alignment of so many per cent has."""
    of_query, of_target = _grams(query), _grams(target)
    need = _needed(qe - qs, identity)
    out = np.ones(len(qs), bool)
    for some in _together(te - ts, BOUNDED):
        nt, nq = np.maximum(te[some] - ts[some] - _Q + 1, 0), np.maximum(qe[some] - qs[some] - _Q + 1, 0)
        has = np.zeros(len(nt) << 2 * _Q, bool)
        row = np.arange(len(nt), dtype=np.int64) << 2 * _Q
        has[np.repeat(row, nt) + of_target[np.repeat(ts[some], nt) + _places(nt)]] = True
        hits = has[np.repeat(row, nq) + of_query[np.repeat(qs[some], nq) + _places(nq)]]
        total = np.append(0, np.cumsum(hits))
        ends = np.cumsum(nq)
        out[some] = total[ends] - total[ends - nq] >= need[some]
    return out


def _best_scores(query: np.ndarray, qs: np.ndarray, qe: np.ndarray, target: np.ndarray, ts: np.ndarray, te: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman score of each pair of ranges, those of query of 8192 bases at most: anti-diagonals as in ``local_alignments``, in 8 or 16 bits, pairs side by side."""
    out = np.zeros(len(qs), np.int64)
    order = np.lexsort((te - ts, qe - qs))
    for some in _together((te - ts)[order], ALIGNED):
        own = order[some]
        lq, lt = (qe - qs)[own], (te - ts)[own]
        m, n = int(lq.max()), int(lt.max())
        if not m or not n:
            continue
        i, j = np.arange(m)[:, None], np.arange(n)[::-1, None]
        q = np.where(i < lq, query[np.minimum(qs[own] + i, len(query) - 1)], 4).astype(np.uint8)
        t = np.where(j < lt, target[np.minimum(ts[own] + j, len(target) - 1)], 5).astype(np.uint8)
        # no score is over twice the bases; what is below one gap's cost counts for nothing
        kind, low = (np.int8, -100) if MATCH * m < 124 else (np.int16, -(1 << 14))
        h, e, f = ([np.full((m + 1, len(own)), x, kind) for _ in range(y)] for x, y in ((0, 3), (low, 2), (low, 2)))
        s, x, best = np.empty((m, len(own)), kind), np.empty((m, len(own)), kind), np.zeros((m + 1, len(own)), kind)
        same = s.view(bool) if kind is np.int8 else s
        for d in range(2, m + n + 1):
            i0, i1 = max(1, d - n), min(m, d - 1) + 1
            h0, h1, h2 = h[d % 3], h[(d - 1) % 3], h[(d - 2) % 3]
            e0, e1, f0, f1 = e[d % 2], e[(d - 1) % 2], f[d % 2], f[(d - 1) % 2]
            here, there, w = slice(i0, i1), slice(i0 - 1, i1 - 1), i1 - i0
            np.equal(q[i0 - 1 : i1 - 1], t[n - d + i0 : n - d + i1], out=same[:w], casting="unsafe")
            s[:w] *= MATCH - MISMATCH
            s[:w] += MISMATCH
            s[:w] += h2[there]
            for new, old, place in ((e0, e1, here), (f0, f1, there)):
                np.subtract(h1[place], GAP_OPEN, out=x[:w])
                np.subtract(old[place], GAP_EXTEND, out=new[here])
                np.maximum(new[here], x[:w], out=new[here])
                np.maximum(s[:w], new[here], out=s[:w])
            np.maximum(s[:w], 0, out=h0[here])
            # what a later diagonal may read beyond this one's ends
            h0[:i0], e0[:i0], f0[:i0] = 0, low, low
            h0[i1 : i1 + 1], e0[i1 : i1 + 1], f0[i1 : i1 + 1] = 0, low, low
            np.maximum(best[here], h0[here], out=best[here])
        out[own] = best.max(axis=0)
    return out


#: The share of a query's range that is aligned first: with all else matched, few others can reach six in ten.
FIRST = 0.55


def near_enough(query: np.ndarray, qs: np.ndarray, qe: np.ndarray, target: np.ndarray, ts: np.ndarray, te: np.ndarray, identity: float) -> np.ndarray:
    """Which of the pairs of ranges may have an alignment of so many per cent: the best score of the first bases of the query, and a match for each other one, have to add up to it."""
    n = qe - qs
    cut = np.minimum(np.ceil(n * FIRST).astype(np.int64), 8192)
    least = np.ceil(MATCH * n * identity / 100 - 1e-6)
    return _best_scores(query, qs, qs + cut, target, ts, te) + MATCH * (n - cut) >= least


def contig_search(contigs: DataFrame, queries: list[tuple], windows: list[tuple], model: dict, d: int, radius: float, side: float, identity: float, query_type: str, cap: int | None = None, query: str = "query_id", contig: str = "contig_id", text: str = "text") -> DataFrame:
    """(query, contig, score, qstart, qend, tstart, tend): ``search.contig_search`` of queries (key, seq), of A, C, G and T, and their windows (key, q_start, q_end, vector)
    against the DNA of whole texts (contig, text). Keys differ."""
    names = [query, contig, "score", "qstart", "qend", "tstart", "tend"]
    schema = f"{query} {query_type}, {contig} {dict(contigs.dtypes)[contig]}, score double, qstart int, qend int, tstart int, tend int"
    spark = contigs.sparkSession
    if not windows:
        return spark.createDataFrame([], schema)
    k = model["k"]
    number = {x[0]: i for i, x in enumerate(queries)}
    near = Near([(number[w[0]], *w[1:]) for w in windows], radius, side, k)
    held = spark.sparkContext.broadcast(([x[0] for x in queries], [x[1] for x in queries], Projection(model, d), near))

    def hits(texts: pa.Array, seqs: list[str], project: Projection, near: Near) -> tuple[np.ndarray, ...]:
        codes, at = bases_of_texts(texts)
        own, q, qs, qe, ts, te = matches_of(codes, at, project, near, cap)
        sizes = np.array([len(s) for s in seqs])
        begin = np.cumsum(sizes) - sizes
        qs, qe, ts, te = np.maximum(qs - k, 0), np.minimum(qe + k, sizes[q]), np.maximum(ts - k, 0), te + k
        ok = np.flatnonzero((qe - qs >= k) & (te - ts >= k))
        own, q, qs, qe, ts, te = (x[ok] for x in (own, q, qs, qe, ts, te))
        clipped = np.minimum(te, at[own + 1] - at[own])
        bases = _BASE_OF_SEQ[np.frombuffer("".join(seqs).encode(), np.uint8)]
        for bound in (may_reach, near_enough):
            ok = np.flatnonzero(bound(bases, begin[q] + qs, begin[q] + qe, codes, at[own] + ts, at[own] + clipped, identity))
            own, q, qs, qe, ts, te, clipped = (x[ok] for x in (own, q, qs, qe, ts, te, clipped))
        letters = np.frombuffer(b"ACGT", np.uint8)[codes].tobytes()
        a = [seqs[x][s:e] for x, s, e in zip(q.tolist(), qs.tolist(), qe.tolist(), strict=True)]
        b = [letters[s:e].decode() for s, e in zip((at[own] + ts).tolist(), (at[own] + clipped).tolist(), strict=True)]
        score = local_scores(a, b) / (2.0 * (qe - qs)) * 100 if len(a) else np.empty(0)
        ok = np.flatnonzero(score >= identity)
        return tuple(x[ok] for x in (q, own, score, qs, qe, ts, te))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seqs, project, near = held.value
        keys = pa.array(keys)
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, "right")))
                some, at = b.slice(at, to - at), to
                q, own, score, *places = hits(some.column(1), seqs, project, near)
                if len(q):
                    yield pa.record_batch([keys.take(pa.array(q)), some.column(0).take(pa.array(own)), pa.array(score), *[pa.array(x.astype(np.int32)) for x in places]], names=names)

    return contigs.select(contig, text).mapInArrow(run, schema)


_BASE_OF_SEQ = np.zeros(256, np.uint8)
_BASE_OF_SEQ[np.frombuffer(b"ACGT", np.uint8)] = range(4)
