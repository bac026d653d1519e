"""SimHash near-dedup by anchor-point covering.

The anchors are a covering code on 46 of the 64 bits: two perfect binary Golay
codes (23 bits, covering radius 3) side by side. The home anchor of a
fingerprint lies within 3 bits of it in each half; a second fingerprint within
t bits of the first lies within 3 + a and 3 + b bits of that anchor, a + b <= t.
So every fingerprint goes to each anchor whose two distances exceed 3 by no more
than t together (61 on average for t = 2), and fingerprints are compared at
each anchor, at least one of them at home. No linked pair is missed.

Equal fingerprints are one class before anything is compared. At an anchor
only a spanning forest of the links found is returned, not all pairs. An anchor with over
``CAP`` fingerprints is not compared there: its members go by their variants of at
most one flipped bit, as two fingerprints are within 2 bits exactly if they share
such a variant, and a variant has at most 65 different fingerprints.

Defined cases: a null or empty text, or one of white space alone, has the
fingerprint 0 and is linked like any other; texts of one or two words have one
shingle, all their words; repeated rows are linked to each other; a null doc_id never is a
component_id unless all doc_ids of the component are null; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_bytes, shielded
from .components import components, forest

SHINGLE = 3
BITS = 2
CAP = 4096
_STEP = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text in UTF-8."""
    words = lower_bytes(raw).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        h = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts[i : min(n, i + _STEP)], last[i : i + _STEP], strict=False)], "<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits in a long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


_GOLAY = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


class Code:
    """The Golay code: syndromes, and for each syndrome the error patterns by how far their weight exceeds 3."""

    def __init__(self, bits: int = BITS):
        rest = []
        for i in range(23):
            r = 1 << i
            while r.bit_length() > 11:
                r ^= _GOLAY << (r.bit_length() - 12)
            rest.append(r)
        low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for i in range(23):
            t, k = (low, i) if i < 12 else (high, i - 12)
            t[(np.arange(len(t)) >> k) & 1 == 1] ^= rest[i]
        self.low, self.high = low, high
        self.levels = []
        for weights in [range(4), *([3 + k] for k in range(1, bits + 1))]:
            found = [(sum(1 << i for i in c), 0) for w in weights for c in combinations(range(23), w)]
            e = np.array([x[0] for x in found], np.int64)
            s = self.syndrome(e)
            order = np.argsort(s, kind="stable")
            count = np.bincount(s, minlength=2048)
            self.levels.append((e[order], np.cumsum(count) - count, count))

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.low[v & 0xFFF] ^ self.high[(v >> 12) & 0x7FF]


_codes: dict[int, Code] = {}


def anchors(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) for every anchor that a fingerprint goes to."""
    code = _codes.setdefault(bits, Code(bits)) if bits not in _codes else _codes[bits]
    v1, v2 = (fps & 0x7FFFFF), (fps >> 23) & 0x7FFFFF
    s1, s2 = code.syndrome(v1), code.syndrome(v2)
    rows, found, home = [], [], []
    for k1 in range(bits + 1):
        for k2 in range(bits + 1 - k1):
            (e1, o1, c1), (e2, o2, c2) = code.levels[k1], code.levels[k2]
            n = c1[s1] * c2[s2]
            row = np.repeat(np.arange(len(fps)), n)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            m = c2[s2][row]
            a1 = v1[row] ^ e1[o1[s1[row]] + i // np.maximum(m, 1)]
            a2 = v2[row] ^ e2[o2[s2[row]] + i % np.maximum(m, 1)]
            rows.append(row)
            found.append(a1 | (a2 << 23))
            home.append(np.full(len(row), k1 + k2 == 0))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _replicate(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                x = fps[at : at + 4096]
                row, anchor, home = anchors(x, bits)
                yield pa.record_batch([pa.array(anchor), pa.array(x[row]), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def _compare(bits: int, cap: int):
    """Of rows in order of anchor: a forest of the links at each anchor (v not null), or the members of a full anchor (v null)."""

    def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = np.arange(len(anchor))
        s = 1
        while True:
            at = at[at + s < len(anchor)]
            at = at[anchor[at] == anchor[at + s]]
            if not len(at):
                break
            x, y = fp[at], fp[at + s]
            near = (home[at] | home[at + s]) & (np.bitwise_count((x ^ y).view(np.uint64)) <= bits)
            us.append(x[near])
            vs.append(y[near])
            s += 1
        return forest(np.concatenate(us), np.concatenate(vs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v"]
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        full = None  # the anchor whose members go on as they come

        def ready(a, f, h):
            """Compare whole anchors; members of an anchor with over cap rows go on."""
            _, start, count = np.unique(a, return_index=True, return_counts=True)
            big = np.repeat(count > cap, count)
            if big.any():
                yield pa.record_batch([pa.array(f[big]), pa.array([None] * int(big.sum()), pa.int64())], names=names)
                a, f, h = a[~big], f[~big], h[~big]
            u, v = links(a, f, h)
            if len(u):
                yield pa.record_batch([pa.array(u), pa.array(v)], names=names)

        for b in batches:
            a, f, h = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            if full is not None:
                same = a == full
                if same.any():
                    yield pa.record_batch([pa.array(f[same]), pa.array([None] * int(same.sum()), pa.int64())], names=names)
                a, f, h = a[~same], f[~same], h[~same]
                if not len(a):
                    continue
                full = None
            a, f, h = (np.concatenate(x) for x in zip(held, (a, f, h), strict=True))
            if not len(a):
                continue
            end = np.searchsorted(a, a[-1])  # the last anchor may go on
            yield from ready(a[:end], f[:end], h[:end])
            held = [a[end:], f[end:], h[end:]]
            if len(held[0]) > cap:
                full = held[0][0]
                yield pa.record_batch([pa.array(held[1]), pa.array([None] * len(held[1]), pa.int64())], names=names)
                held = [x[:0] for x in held]
        yield from ready(*held)

    return run


def links(fps: DataFrame, bits: int = BITS, cap: int = CAP) -> DataFrame:
    """Edges (u, v) that join exactly those fingerprints (fp: distinct longs) which links of at most ``bits`` differing bits join."""
    if bits != 2:
        raise ValueError("variants of one flipped bit stand for 2 differing bits")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = fps.select("fp").repartition(parts, "fp").mapInArrow(_replicate(bits), "anchor long, fp long, home boolean")
    found = cut(at.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_compare(bits, cap), "u long, v long").distinct())
    full = found.where("v IS NULL").select("u")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    variants = full.select(F.col("u"), F.explode(F.transform(flips, lambda e: F.col("u").bitwiseXOR(e))).alias("w"))
    least = variants.groupBy("w").agg(F.min("u").alias("v"), F.max("u").alias("last")).where("v < last").select("w", "v")
    return found.where("v IS NOT NULL").union(variants.join(least, "w").where("u <> v").select("u", "v"))


def near_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, cap: int = CAP) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    fps = cut(fingerprints(docs, shingle))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = components(links(classes, bits, cap)).toDF("__n", "label")
    known = classes.join(label, F.col("fp") == F.col("__n"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    of = known.join(least, "label").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of the smallest doc_id of each component, with their own columns. Rows that share that doc_id all stay, as do rows without a doc_id whose component has no other."""
    keep = members.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    safe, named = shielded(docs)
    return named(safe.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi"))


def near_dedup(docs: DataFrame, similar: bool = False, **how) -> DataFrame:
    """One row of each component of near_components. similar: documents are linked by their five-word shingles, 0.8 or more
    of which they share, instead of by a number of bits; fingerprints then give the first candidates (see similar.py)."""
    if similar:
        from .similar import near_dedup as by_similarity

        return by_similarity(docs, **how)
    return first_of_each(docs, near_components(docs, **how))


def op10(docs: DataFrame) -> DataFrame:
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute(rows: list[tuple]) -> dict:
    """Reference result of the contract for small lists of (doc_id, text)."""
    fp = {}
    for i, t in rows:
        words = lower_bytes((t or "").encode()).split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
        fp[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    label = {i: i for i in fp}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (f"{fp[i]:016x}", root(i)) for i in ids}
