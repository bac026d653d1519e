"""Substring dedup: paragraphs of a text are hashed and all but their earliest occurrence are removed.

Words are normalised (A to Z in lower case, white space as separator only). A text is divided where a line
begins, and before each word whose hash (with the next word's) is the smallest of the ``RADIUS`` words on either
side; a paragraph begins with each division and is at least two of them, and as many more as it takes to have ``MIN_WORDS``
words, so paragraphs overlap. As borders depend on the words around them alone, a passage has the same
paragraphs wherever it stands, inside a line or in short lines too. Only the end of a text has no paragraph where under ``MIN_WORDS`` words are left.

Digests (128 bits) found twice are grouped globally; the occurrence with the smallest (doc_id, row, offset) stays.
Only suspects of a twice-seen Bloom filter are shuffled. Text that a kept
occurrence covers is never removed from its document. Removed spans are given with their offsets
in the original text, in code points.

Defined cases: a null or empty text has no paragraph and stays as it is; rows that share a doc_id, or have
none, are documents of their own, a null doc_id before all others; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloomfilter import filter_bits, suspected, twice_seen
from .bytewords import code_points_before, mix, range_hashes, words
from .common import cut, join_counted, shielded

RADIUS = 3
MIN_WORDS = 20  # shorter runs of words come again in clean prose too
BITS_PER_UNIT = 8


def borders(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Words before which a text of word hashes h, in the lines given, is divided."""
    if not len(h):
        return np.empty(0, np.int64)
    v = mix(h + np.uint64(3) * np.append(h[1:], np.uint64(0)))
    own = np.ones(len(v), bool)
    for k in range(1, min(RADIUS, len(v) - 1) + 1):
        own[k:] &= v[k:] < v[:-k]
        own[:-k] &= v[:-k] <= v[k:]
    own[0] = True
    own[1:] |= line[1:] != line[:-1]
    return np.flatnonzero(own)


def paragraphs(raw: bytes) -> tuple[np.ndarray, ...]:
    """(start, end, digest, second digest) of each paragraph that may be removed; offsets in bytes."""
    start, end, h = words(raw)
    if len(h) < MIN_WORDS:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    at = borders(h, np.searchsorted(breaks, start))
    ends = np.append(at[1:], len(h))
    # the first division that ends after enough words, the next one at least
    last = np.maximum(np.searchsorted(ends, at + MIN_WORDS), np.arange(len(at)) + 1)
    if len(at) == 1:
        last[:] = 0
    s, e = at[last < len(ends)], ends[last[last < len(ends)]]
    return start[s], end[e - 1], range_hashes(h, s, e), range_hashes(mix(h ^ np.uint64(0x5851F42D4C957F2D)), s, e)


def _hashes(texts: list) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *[paragraphs((t or "").encode())[2] for t in texts]])


_OCC = "row long, key long, start int, end int, digest binary"


def _suspects(bloom, n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bloom.value, np.uint8)
        for b in batches:
            ids, keys, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary())
            for at in range(0, len(keys), 512):
                rows = []
                for row, key, t in zip(ids[at : at + 512].tolist(), keys[at : at + 512].tolist(), texts.slice(at, 512).to_pylist(), strict=True):
                    s, e, d1, d2 = paragraphs(t or b"")
                    if len(s):
                        hit = suspected(bits, d1, n_bits)
                        rows.append((np.full(int(hit.sum()), row), np.full(int(hit.sum()), key), s[hit], e[hit], d1[hit], d2[hit]))
                if rows:
                    row, key, s, e, d1, d2 = (np.concatenate(x) for x in zip(*rows, strict=True))
                    both = np.stack([d1, d2], axis=1).astype("<u8").tobytes()
                    digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(key), [None, pa.py_buffer(both)]).cast(pa.binary())
                    yield pa.record_batch([pa.array(row), pa.array(key), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), digest], names=["row", "key", "start", "end", "digest"])

    return run


def cut_spans(raw: bytes, found: list) -> list[tuple[int, int]]:
    """Byte spans to remove, given (start, end, digest, in the row that keeps it) of the repeated paragraphs of a text."""
    cover = np.zeros(len(raw) + 2, np.int32)
    keep = np.zeros(len(raw) + 2, np.int32)
    kept = set()
    for s, e, d, mine in sorted(found):
        first = mine and d not in kept
        if mine:
            kept.add(d)
        to = keep if first else cover
        to[s] += 1
        to[e] -= 1
    gone = (np.cumsum(cover) > 0) & (np.cumsum(keep) == 0)
    edge = np.diff(np.concatenate(([False], gone)).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _drop(columns: list[str]):
    own = [c for c in columns if c != "__found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column(columns.index("text")), b.column(columns.index("__found"))
            new, spans, n = [], [], []
            for at in range(0, len(texts), 512):
                for t, f in zip(texts.slice(at, 512).to_pylist(), found.slice(at, 512).to_pylist(), strict=True):
                    cuts = []
                    if f and t:
                        raw = t.encode()
                        cuts = cut_spans(raw, [(x["start"], x["end"], x["digest"], x["mine"]) for x in f])
                        if cuts:
                            flat = code_points_before(raw, np.array(cuts).ravel()).reshape(-1, 2)
                            kept, last = [], 0
                            for s, e in cuts:
                                kept.append(raw[last:s])
                                last = e
                            t = b"".join([*kept, raw[last:]]).decode()
                            cuts = flat.tolist()
                    new.append(t)
                    spans.append(cuts)
                    n.append(len(cuts))
            out = [pa.array(new, pa.string()) if c == "text" else b.column(columns.index(c)) for c in own]
            yield pa.record_batch([*out, pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[*own, "__spans"])

    return run


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without repeated paragraphs, plus __spans: the removed [start, end) of the original text, in code points."""
    spark = docs.sparkSession
    docs, named = shielded(docs)
    # rows have ids of their own, written once, as a doc_id may be null or that of several rows
    keyed = cut(docs.withColumns({"__key": F.coalesce("doc_id", F.lit(-(2**63))), "__row": F.monotonically_increasing_id()}))
    chars = keyed.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n_bits = filter_bits(chars // 40, BITS_PER_UNIT)  # a paragraph begins every seven words
    bloom = spark.sparkContext.broadcast(twice_seen(keyed.select("text"), n_bits, _hashes))
    occ = cut(keyed.select("__row", "__key", "text").mapInArrow(_suspects(bloom, n_bits), _OCC))
    repeated = occ.groupBy("digest").agg(F.min(F.struct("key", "row")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    found = join_counted(occ, cut(repeated), "digest", "n", F.xxhash64("row", "start").cast("string").cast("binary"))
    lists = found.groupBy(F.col("row").alias("__id")).agg(F.collect_list(F.struct("start", "end", "digest", (F.col("row") == F.col("keep.row")).alias("mine"))).alias("__found"))
    both = keyed.join(lists, F.col("__row") == F.col("__id"), "left").drop("__key", "__row", "__id")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return named(both.mapInArrow(_drop(both.columns), f"{out}, __spans array<array<bigint>>"))


def op3(docs: DataFrame) -> DataFrame:
    out = dedup_substrings(docs.select("doc_id", "text"))
    lengths = F.aggregate(F.transform("__spans", lambda x: F.get(x, 1) - F.get(x, 0)), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.array_join(F.transform("__spans", lambda x: F.concat_ws(":", F.get(x, 0).cast("string"), F.get(x, 1).cast("string"))), ",")
    return out.select("doc_id", F.size("__spans").cast("long").alias("n_dropped"), lengths.alias("n_dropped_chars"), spans.alias("dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def brute(rows: list[tuple]) -> dict:
    """Reference result for small lists of (doc_id, text): doc_id to the removed spans in code points."""
    seen: dict = {}
    count: dict = {}
    units = {i: list(zip(*(x.tolist() for x in paragraphs((t or "").encode())), strict=True)) for i, t in rows}
    for i in sorted(units):
        for s, e, d1, d2 in units[i]:
            seen.setdefault((d1, d2), (i, s))
            count[d1, d2] = count.get((d1, d2), 0) + 1
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone, kept = set(), set()
        for s, e, d1, d2 in units[i]:
            if count[d1, d2] > 1:
                (kept if seen[d1, d2] == (i, s) else gone).update(range(s, e))
        spans, left = [], sorted(gone - kept)
        for p in left:
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out[i] = [(len(raw[:s].decode()), len(raw[:e].decode())) for s, e in spans]
    return out
