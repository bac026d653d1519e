"""Near-dedup by similarity: documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.

This is the general interface of operator 10 (``simhash.near_dedup`` with a similarity). Fingerprints of these shingles that meet at an
anchor give the first candidates. Sixty-four bits can't bound the similarity, so all other links come by prefixes, exactly:
with the hashes of a set in order, two sets of similarity t or more share a hash among the
first n - ceil(t n) + 1 of each, and at the first one shared, at places i and j, i + j is at most n + m - 2 ceil(t (n + m) / (1 + t)).
Sets that meet so are candidates. A set's sketch holds the parity of its hashes modulo 4 n to 8 n, and two sketches differ in no
more bits than the sets do in shingles, so that most candidates fall before any text moves; the others are confirmed on the whole sets.

Equal sets are one class before anything is compared. Candidates come in rounds, so that large groups of
copies never give all their pairs: first fingerprints, and each class with the least one under the same hash; then, as long as any
candidates are left that no links join, those of each hash, or one spanning tree of them, nearest sketches first, where they are over
``MOST`` for each class there. A confirmed pair joins two components, a rejected one is not proposed again, and hashes without
candidates drop out, so rounds get smaller and end when there is nothing left to decide. The first of these rounds takes every
``EARLY``-th hash alone, as copies share most of theirs. A hash with over ``BLOCK`` classes is compared in blocks.

Defined cases: texts of one to four words have one shingle, all their words; texts without a word have the empty set, and are
linked to each other alone; repeated rows are linked; a null doc_id never is a component_id unless all doc_ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .bytewords import mix, range_hashes, words
from .common import cut, discard, join_counted
from .components import components

SHINGLE = 5
#: The least similarity, as a fraction.
UP, DOWN = 4, 5
_FLUSH = 1 << 16
#: Classes under one hash that a task compares with each other; of more, each pair of blocks is compared apart.
BLOCK = 4096
MOST, EARLY = 4, 8


def shingles(raw: bytes) -> np.ndarray:
    """The different shingles of a text in UTF-8, as hashes in order."""
    h = words(raw)[2]
    if not len(h):
        return h
    start = np.arange(max(1, len(h) - SHINGLE + 1))
    return np.unique(range_hashes(h, start, np.minimum(start + SHINGLE, len(h))))


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes()) - (1 << 63)


def alike(inter, n, m):
    """Whether sets of n and m shingles of which inter are shared are similar enough."""
    return (UP + DOWN) * inter >= UP * (n + m)


def most_apart(total):
    """How many shingles at most are in one alone of two sets, with so many in both counts, that are similar enough."""
    return total - 2 * (-(-UP * total // (UP + DOWN)))


def sketch(found: np.ndarray) -> bytes:
    bits = 1 << max(6, (4 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits that differ, the longer sketch folded to the length of the other; at most the shingles in one set alone."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number; of none, zero."""
    bits = np.unpackbits(found.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(found), bitorder="little").view("<i8")[0])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, fps = [], []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            found = shingles(t or b"")
            cls.append(class_of(found))
            fps.append(fingerprint(found))
        yield pa.record_batch([b.column(0), pa.array(cls, pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "cls", "fp"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, cls, i, n) of the prefix of each different set of a partition."""
    seen: set[int] = set()
    for b in batches:
        texts = b.column(0).cast(pa.binary())
        for at in range(0, len(texts), 256):
            rows = []
            for t in texts.slice(at, 256).to_pylist():
                found = shingles(t or b"")
                n = len(found)
                if n and (c := class_of(found)) not in seen:
                    seen.add(c)
                    k = n - (UP * n + DOWN - 1) // DOWN + 1
                    rows.append((found[:k], np.full(k, c), np.arange(k, dtype=np.int32), np.full(k, n, np.int32)))
            if rows:
                token, cls, i, n = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(cls), pa.array(i), pa.array(n)], names=["token", "cls", "i", "n"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, n, sketch, text) of the different sets of a partition."""
    seen: set[int] = set()
    for b in batches:
        texts = b.column(0).cast(pa.binary())
        for at in range(0, len(texts), 256):
            own = {}
            for t in texts.slice(at, 256).to_pylist():
                found = shingles(t or b"")
                if len(found) and (c := class_of(found)) not in seen:
                    seen.add(c)
                    own[c] = len(found), sketch(found), t
            if own:
                n, bits, text = zip(*own.values(), strict=True)
                yield pa.record_batch([pa.array(list(own), pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(text, pa.binary())], names=["cls", "n", "sketch", "text"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in order of their first one, no value of which is in two parts."""
    held = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(held[0]):
            continue
        end = np.searchsorted(held[0], held[0][-1])
        if end:
            yield [c[:end] for c in held]
            held = [c[end:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _possible(i, j, n, m):
    return (i + j <= most_apart(n + m)) & (DOWN * np.minimum(n, m) >= UP * np.maximum(n, m))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, in order of token and class, of tokens that two classes have, each class once, with the least class as lead. No token's rows are held."""
    names = ["token", "cls", "i", "n", "lead", "lead_i", "lead_n"]
    lead = last = waiting = None  # of the token that may go on: its first row, its last one, and whether the first is still held back
    for b in batches:
        cols = [b.column(c).to_numpy() for c in names[:4]]
        if lead is not None:
            cols = [np.concatenate(([x], c)) for x, c in zip(last, cols, strict=True)]
        token, cls = cols[0], cols[1]
        if not len(token):
            continue
        new = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))
        cols = [c[new] for c in cols]
        token = cols[0]
        start = np.append(True, token[1:] != token[:-1])
        first = np.flatnonzero(start)
        group = np.cumsum(start) - 1
        leads = [c[first].copy() for c in cols]
        size = np.bincount(group)
        more = size[group] > 1
        if lead is not None:
            for x, v in zip(leads, lead, strict=True):
                x[0] = v
            if not waiting:
                more[group == 0] = True
                more[0] = False  # given before
        end = bool(size[-1] > 1) or (len(size) == 1 and lead is not None and not waiting)
        lead, last, waiting = [c[-1] for c in leads], [c[-1] for c in cols], not end
        if more.any():
            yield pa.record_batch([pa.array(c[more]) for c in cols] + [pa.array(leads[k][group[more]]) for k in (1, 2, 3)], names=names)


def _folded(sketches: list, size: int) -> np.ndarray:
    """Sketches of so many 64-bit words, or of twice as many, which are folded, as rows."""
    out = np.zeros((len(sketches), size), np.uint64)
    for k, x in enumerate(sketches):
        w = np.frombuffer(x, np.uint64)
        out[k] = w if len(w) == size else w[:size] ^ w[size:]
    return out


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a partner under their part which places and sizes don't rule out: the others need no sketch."""
    names = ["part", "cls", "i", "n", "label", "side"]
    for part, cls, i, n, label, side in _groups(batches):
        keep = np.zeros(len(part), bool)
        x, s = np.arange(len(part)), 1
        while True:
            x = x[x + s < len(part)]
            x = x[part[x] == part[x + s]]
            if not len(x):
                break
            y = x + s
            near = (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] == 2)) & _possible(i[x], i[y], n[x], n[y])
            keep[x[near]] = keep[y[near]] = True
            s += 1
        if keep.any():
            yield pa.record_batch([pa.array(c[keep]) for c in (part, cls, i, n, label, side)], names=names)


def _tree(u: np.ndarray, v: np.ndarray, lu: np.ndarray, lv: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of edges that form a spanning forest of the labels, of the least total weight (Boruvka)."""
    names, at = np.unique(np.concatenate([lu, lv]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    order = np.lexsort((v, u, w))
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    of = np.arange(len(names))
    chosen: list[np.ndarray] = []
    while True:
        x, y = of[a], of[b]
        out = np.flatnonzero(x != y)
        if not len(out):
            return np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)
        best = np.full(len(names), len(u))
        np.minimum.at(best, x[out], rank[out])
        np.minimum.at(best, y[out], rank[out])
        e = order[np.unique(best[best < len(u)])]
        chosen.append(e)
        p, q = of[a[e]], of[b[e]]
        low = np.arange(len(names))
        while True:  # merge along the chosen edges
            m = np.minimum(low[p], low[q])
            new = low.copy()
            np.minimum.at(new, p, m)
            np.minimum.at(new, q, m)
            new = new[new]
            if (new == low).all():
                break
            low = new
        of = low[of]


def _key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u.view(np.uint64)) * np.uint64(3) + mix(v.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, u, v): for each part the pairs whose places, sizes and sketches rule nothing out and that were not rejected before, or of many a spanning forest over the labels."""
    for part, cls, i, n, label, side, bits, no in _groups(batches):
        size = np.array([len(x) // 8 for x in bits], np.int64)
        rejected = [np.empty(0, np.uint64), *[_key(np.full(len(x), c), np.asarray(x, np.int64)) for c, x in zip(cls, no, strict=True) if x is not None and len(x)]]
        rejected = np.unique(np.concatenate(rejected))
        # sizes of similar sets are within 5/4, so their sketches' are equal or one is twice the other
        words_of, place = {}, {}
        for k in np.unique(size).tolist():
            own = np.flatnonzero((size == k) | (size == 2 * k))
            place[k] = np.zeros(len(size), np.int64)
            place[k][own] = np.arange(len(own))
            words_of[k] = _folded(bits[own].tolist(), k)
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3  # places of both, bits apart
        _, of = np.unique(part, return_inverse=True)
        room, total = MOST * np.bincount(of), np.zeros(of.max() + 1, np.int64)
        count = 0

        def fold(held: list) -> list:
            """A forest for each part with more pairs than it has room for: labels under different parts are different."""
            full = (total > room)[of[held[0]]]
            a, b, w = (x[full] for x in held)
            la, lb = (mix(label[x].view(np.uint64) ^ mix(part[x].view(np.uint64))) for x in (a, b))
            keep = _tree(cls[a], cls[b], la, lb, w)
            return [np.concatenate([x[~full], x[full][keep]]) for x in held]

        x, s = np.arange(len(part)), 1
        while True:
            x = x[x + s < len(part)]
            x = x[part[x] == part[x + s]]
            if not len(x):
                break
            y = x + s
            near = (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] == 2)) & _possible(i[x], i[y], n[x], n[y])
            a, b = x[near], y[near]
            least = np.minimum(size[a], size[b])
            for k in np.unique(least).tolist():
                p, q = a[least == k], b[least == k]
                step = max(1, _FLUSH // k)
                far = np.concatenate([np.empty(0, np.int64), *[np.bitwise_count(words_of[k][place[k][p[z : z + step]]] ^ words_of[k][place[k][q[z : z + step]]]).sum(1, dtype=np.int64) for z in range(0, len(p), step)]])
                ok = far <= most_apart(n[p].astype(np.int64) + n[q])
                if len(rejected):
                    ok &= ~np.isin(_key(np.minimum(cls[p], cls[q]), np.maximum(cls[p], cls[q])), rejected)
                held = [np.concatenate(z) for z in zip(held, (p[ok], q[ok], far[ok]), strict=True)]
                np.add.at(total, of[p[ok]], 1)
                count += int(ok.sum())
            s += 1
            if count >= _FLUSH:
                held = fold(held)
                count = 0
        if len(held[0]):
            a, b, _ = fold(held)
            yield pa.record_batch([pa.array(part[a]), pa.array(np.minimum(cls[a], cls[b])), pa.array(np.maximum(cls[a], cls[b]))], names=["part", "u", "v"])


def _not_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) of (u, v, sum of their sizes, sketch of u, sketch of v) whose sketches are near enough."""
    for b in batches:
        most, x, y = most_apart(b.column(2).to_numpy()).tolist(), b.column(3).to_pylist(), b.column(4).to_pylist()
        near = pa.array([bits_apart(p, q) <= k for p, q, k in zip(x, y, most, strict=True)], pa.bool_())
        yield b.select(["u", "v"]).filter(near)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, alike) of (u, v, text of u, text of v)."""
    last, a = None, np.empty(0, np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            u, v, x, y = (c.to_pylist() for c in part.columns)
            found = []
            for k in range(len(u)):
                if u[k] != last:
                    last, a = u[k], shingles(x[k])
                b = shingles(y[k])
                found.append(bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.bool_())], names=["u", "v", "alike"])


def _of(whole: DataFrame, c: str, *names: str) -> DataFrame:
    return whole.select("cls", *names).toDF(c, *[f"__{c}{k}" for k in range(len(names))])


def _near(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs that their sketches don't rule out."""
    both = pairs.join(_of(whole, "v", "n", "sketch"), "v").join(_of(whole, "u", "n", "sketch"), "u")
    return cut(both.select("u", "v", (F.col("__u0") + F.col("__v0")).alias("n"), "__u1", "__v1").mapInArrow(_not_ruled_out, "u long, v long"))


def _judged(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(u, v, alike) of the written pairs, by the whole sets."""
    both = pairs.join(_of(whole, "v", "text"), "v").join(_of(whole, "u", "text"), "u").select("u", "v", "__u0", "__v0")
    return cut(both.mapInArrow(_confirm, "u long, v long, alike boolean"))


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(part, cls, i, n, label, side) of rows with the count m of their token: a token of one block is a part; of more, each pair of blocks is one, in which
    the two sides are compared (side 0 and 1), or a block with itself (side 2)."""
    n = F.ceil(F.col("m") / F.lit(block)).cast("int")
    rows = rows.withColumns({"__n": n, "__x": F.pmod(F.xxhash64("cls"), n).cast("int")})
    rows = rows.withColumn("__y", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    low, high = F.least("__x", "__y"), F.greatest("__x", "__y")
    part = F.when(F.col("__n") == 1, F.col("token")).otherwise(F.xxhash64("token", low, high))
    return rows.select("token", part.alias("part"), "cls", "i", "n", "label", F.when(F.col("__x") == F.col("__y"), 2).otherwise((F.col("__x") < F.col("__y")).cast("int")).alias("side"))


def links(texts: DataFrame, first: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) of classes that join exactly the texts which links of the least similarity join. first: candidates (u, v) found by other means."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = texts.select("text").mapInArrow(_prefixes, "token long, cls long, i int, n int")
    order = tokens.repartition(parts, "token").sortWithinPartitions("token", "cls")
    shared = cut(order.mapInArrow(_shared, "token long, cls long, i int, n int, lead long, lead_i int, lead_n int"))
    of = shared.select("cls")
    if first is not None:
        first = cut(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
        of = of.union(first.select("u")).union(first.select("v"))
    whole = cut(texts.select("text").mapInArrow(_whole, "cls long, n int, sketch binary, text binary").join(of.distinct(), "cls", "left_semi").dropDuplicates(["cls"]))
    least = F.ceil(F.lit(UP) * (F.col("n") + F.col("lead_n")) / F.lit(UP + DOWN))
    possible = (F.col("i") + F.col("lead_i") <= F.col("n") + F.col("lead_n") - 2 * least) & (DOWN * F.least("n", "lead_n") >= UP * F.greatest("n", "lead_n"))
    star = shared.where((F.col("cls") != F.col("lead")) & possible).select(F.col("lead").alias("u"), F.col("cls").alias("v"))
    judged = _judged(_near((star if first is None else star.union(first)).distinct(), whole), whole)
    found, rejected = judged.where("alike").select("u", "v"), judged.where("NOT alike").select("u", "v")
    everything = shared.select("token", "cls", "i", "n")
    rows, early, old = everything.where(F.pmod(F.col("token"), F.lit(EARLY)) == 0), True, []
    while True:
        label = cut(components(found)).toDF("__n", "__l")
        rows = rows.select("token", "cls", "i", "n").join(label, F.col("cls") == F.col("__n"), "left").select("token", "cls", "i", "n", F.coalesce("__l", "cls").alias("label"))
        labelled = cut(rows)
        mixed = cut(labelled.groupBy("token").agg(F.min("label").alias("__a"), F.max("label").alias("__b"), F.count("*").alias("m")).where("__a <> __b").select("token", "m"))
        rows = cut(join_counted(labelled, mixed, "token", "m", F.col("cls")).select("token", "cls", "i", "n", "label", "m"))
        discard(labelled, mixed, *old)
        dealt = _in_blocks(rows, block).select("part", "cls", "i", "n", "label", "side").repartition(parts, "part").sortWithinPartitions("part")
        hopeful = cut(dealt.mapInArrow(_hopeful, "part long, cls long, i int, n int, label long, side int"))
        no = rejected.groupBy(F.col("u").alias("cls")).agg(F.collect_list("v").alias("no"))
        own = whole.select("cls", "sketch").join(hopeful.select("cls").distinct(), "cls", "left_semi").join(no, "cls", "left")
        dealt = hopeful.join(own, "cls").select("part", "cls", "i", "n", "label", "side", "sketch", "no")
        apart = cut(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_apart, "part long, u long, v long"))
        proposed = cut(apart.select("u", "v").distinct())
        judged = _judged(proposed, whole)
        discard(proposed, hopeful)
        old = [rows, apart]
        if judged.isEmpty() and not early:
            discard(shared, *old)
            return found
        found, rejected = found.union(judged.where("alike").select("u", "v")), rejected.union(judged.where("NOT alike").select("u", "v"))
        if early:
            rows, early = everything, False
            continue
        # a hash without candidates now never has any
        live = _in_blocks(rows, block).select("token", "part").distinct().join(apart.select("part").distinct(), "part", "left_semi").select("token").distinct()
        rows = rows.join(live, "token", "left_semi")


def near_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, cls, component_id) of every document."""
    of = cut(docs.select("doc_id", "text").mapInArrow(_classes, "doc_id long, cls long, fp long"))
    classes = cut(of.groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")))
    # anchors bring near fingerprints together; equal ones are linked to the least class
    home = classes.groupBy("fp").agg(F.min("cls").alias("home"))
    near = simhash.links(home).join(home.toDF("u", "__u"), "u").join(home.toDF("v", "__v"), "v").select(F.col("__u").alias("u"), F.col("__v").alias("v"))
    same = classes.join(home, "fp").where("cls <> home").select(F.col("home").alias("u"), F.col("cls").alias("v"))
    label = components(links(docs, near.union(same), block)).toDF("__n", "label")
    known = classes.join(label, F.col("cls") == F.col("__n"), "left").select("cls", "first", F.coalesce("label", "cls").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    return of.join(known.join(least, "label").select("cls", "component_id"), "cls").select("doc_id", "cls", "component_id")


def near_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of the smallest doc_id of each component, with their own columns; see simhash.first_of_each."""
    return simhash.first_of_each(docs, near_components(docs, block))
