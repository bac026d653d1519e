"""The first matches of each query with each contig, found contig by contig: nothing is shuffled, whatever the number of sections.

Of the sections of a contig that lie in one cell only the first ``cap`` can be among the first ``cap`` matches of a query, as a range of
the query meets them in order; of the ranges of a query in one cell only the first ``cap``, as each has a match wherever one of them has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.dna import bases_of_texts

#: Pairs of a contig and a query that are looked at together; bytes of texts (or one text).
PAIRS, BYTES = 1 << 16, 1 << 21


def _places(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the runs of n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Ranges:
    """Ranges (query number, cell, q_start, q_end) of queries, in order of their starts, which differ in a query; the first cap of each cell."""

    def __init__(self, rows: list[tuple[int, int, int, int]], cap: int):
        seen: dict[tuple[int, int], int] = {}
        kept = []
        for q, cell, start, end in sorted(rows, key=lambda x: (x[0], x[2])):
            seen[q, cell] = seen.get((q, cell), 0) + 1
            if seen[q, cell] <= cap:
                kept.append((q, cell, start, end))
        self.query, cells, self.start, self.end = (np.array(x, np.int64) for x in zip(*kept, strict=True))
        self.cells, self.cell = np.unique(cells, return_inverse=True)
        self.queries, n = np.unique(self.query, return_counts=True)
        self.steps = np.full((len(n), int(n.max())), -1)
        self.steps[np.repeat(np.arange(len(n)), n), _places(n)] = np.arange(len(kept))


def sections_of_texts(texts: pa.Array, cells_of: Callable, k: int) -> tuple[np.ndarray, ...]:
    """(text, cell, start, end): runs of neighbouring windows in one cell, as ``intervals.sections`` gives them. cells_of(codes, k): the cell of each window."""
    codes, at = bases_of_texts(texts)
    n = np.maximum(np.diff(at) - k + 1, 0)
    if not n.any():
        return (np.empty(0, np.int64),) * 4
    own = np.repeat(np.arange(len(n)), n)
    pos = _places(n)
    cell = cells_of(codes, k)[np.repeat(at[:-1], n) + pos]
    first = np.flatnonzero((pos == 0) | np.append(True, cell[1:] != cell[:-1]))
    last = np.append(first[1:], len(pos)) - 1
    return own[first], cell[first], pos[first], pos[last] + k


def _found(ranges: Ranges, texts: pa.Array, cells_of: Callable, k: int, cap: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query number, text, q_start, q_end, t_start, t_end) of the condensed matches."""
    own, cell, start, end = sections_of_texts(texts, cells_of, k)
    kinds = len(ranges.cells)
    number = np.minimum(np.searchsorted(ranges.cells, cell), kinds - 1)
    group = own * kinds + number
    known = np.flatnonzero(ranges.cells[number] == cell)
    known = known[np.argsort(group[known], kind="stable")]
    group = group[known]
    n = np.bincount(group, minlength=len(texts) * kinds)
    kept = _places(n[n > 0]) < cap
    group, start, end = group[kept], start[known][kept], end[known][kept]
    n = np.minimum(n, cap)
    first = np.cumsum(n) - n
    apart = np.append(False, start[1:] > end[:-1] + k)  # from the section before it, in a group
    n = n.reshape(-1, kinds)
    some = np.flatnonzero(n.any(axis=1))
    queries, steps = ranges.steps.shape
    at_once = max(1, PAIRS // queries)
    for at in range(0, len(some), at_once):
        rows = some[at : at + at_once]
        left, here = np.full((len(rows), queries), cap), n[rows]
        taken, which = [], []
        for r in range(steps):
            asked = np.flatnonzero(ranges.steps[:, r] >= 0)
            take = np.zeros_like(left)
            take[:, asked] = np.minimum(here[:, ranges.cell[ranges.steps[asked, r]]], left[:, asked])
            if take.any():
                left -= take
                taken.append(take)
                which.append(r)
            if not left.any():
                break
        # segments: the sections that a pair takes for one range, in order of pairs, then ranges
        taken = np.stack(taken, axis=2)
        i, q, r = np.nonzero(taken)
        take = taken[i, q, r]
        own = ranges.steps[q, np.array(which)[r]]
        begin = first[rows[i] * kinds + ranges.cell[own]]
        final = begin + take - 1
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (q[1:] != q[:-1]) | (ranges.start[own[1:]] > ranges.end[own[:-1]] + k) | (start[begin[1:]] > end[final[:-1]] + k)
        ends = np.cumsum(take)
        section = np.arange(int(ends[-1])) + np.repeat(begin - (ends - take), take)
        breaks = apart[section]
        breaks[ends - take] = new
        a = np.flatnonzero(breaks)
        b = np.append(a[1:], len(section)) - 1
        x, y = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "right")
        yield ranges.query[own[x]], rows[i[x]], ranges.start[own[x]], ranges.end[own[y]], start[section[a]], end[section[b]]


def first_matches(contigs: DataFrame, ranges: list[tuple], cells_of: Callable, k: int, cap: int, query_type: str, query: str = "query_id", contig: str = "contig_id", text: str = "text") -> DataFrame:
    """(query, contig, q_start, q_end, t_start, t_end): ``intervals.condense`` of the first cap matches of each query with each contig (contig, text),
    where a match is a range (query, cell, q_start, q_end) with a section of its cell. Contigs differ in their key, ranges of a query in their start."""
    names = [query, contig, "q_start", "q_end", "t_start", "t_end"]
    kinds = dict(contigs.dtypes)
    schema = f"{query} {query_type}, {contig} {kinds[contig]}, q_start int, q_end int, t_start int, t_end int"
    if not ranges:
        return contigs.sparkSession.createDataFrame([], schema)
    keys = list({x[0]: None for x in ranges})
    number = {x: i for i, x in enumerate(keys)}
    held = contigs.sparkSession.sparkContext.broadcast((keys, Ranges([(number[x[0]], *x[1:]) for x in ranges], cap)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranges = held.value
        keys = pa.array(keys)
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, "right")))
                some, at = b.slice(at, to - at), to
                for q, own, *places in _found(ranges, some.column(1), cells_of, k, cap):
                    yield pa.record_batch([keys.take(pa.array(q)), some.column(0).take(pa.array(own)), *[pa.array(x.astype(np.int32)) for x in places]], names=names)

    return contigs.select(contig, text).mapInArrow(run, schema)
