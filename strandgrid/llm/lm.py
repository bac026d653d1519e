"""Brown class-based bigram language model.

    P(w | v) = MIX * P(class(w) | class(v)) * P(w | class(w)) + (1 - MIX) * P(w)

Words are hashed to 64 bits. Classes come in two steps. Exchange clustering moves one unit after the other to
the class that raises the likelihood of the training bigrams most, until fewer than one in two hundred move: the ``UNITS`` most
frequent words are units of their own, all others are units by shape (length and last byte), so that the matrix of unit
bigrams has (UNITS + SHAPES + 1)^2 counts at most. Then every other word of the table of frequent words is moved, on the executors, from its
shape to the class under which all its bigrams of the training set are most likely; a word beyond the table stays with its shape. The
counts of all words, and of the bigrams of the final classes, cover the whole training set.

Emissions and P(w) add one half to each count and keep a slot for an unseen word, in
each class and over all. As log10(c + 0.5) is a common factor of both parts of the mixture, a
text's score is a sum over tokens of that, and of a part that needs no count. Counts of frequent words (as
many as fit ``TABLE_WORDS``, by a threshold found from a histogram of counts) go to all tasks; the
other tokens meet their counts in a join on the word, after being summed for each text.

Defined cases: a null or empty text is one end token; rows that share a doc_id, or have none, are scored one by one;
without training text all counts are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, words
from .common import cut

UNITS, CLASSES = 4096, 64
TABLE_WORDS = 1 << 20
MIX = 0.9
LENGTHS, ENDS = 12, 24
SHAPES = LENGTHS * ENDS
#: The end token, which also stands before a text's first word.
END = np.uint64(0x5E4D_0000_0000_0001)
_FLUSH = 1 << 21
#: Texts are joined until they have so many bytes, for arrays that stay in a processor's cache.
RUN_BYTES = 1 << 16


def text_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of each token of a text, the end token last."""
    start, end, h = words(raw)
    buf = np.frombuffer(raw, np.uint8)
    last = buf[end - 1].astype(np.uint64) if len(end) else np.empty(0, np.uint64)
    return np.append(h, END), np.append(_shapes(start, end, last), SHAPES)


def _shapes(start: np.ndarray, end: np.ndarray, last: np.ndarray) -> np.ndarray:
    return np.minimum(end - start, LENGTHS) - 1 + LENGTHS * (mix(last | np.uint64(32)) % np.uint64(ENDS)).astype(np.int64)


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of texts, short ones joined and hashed together: (number of the first text, hash and shape of the tokens of some
    texts one after the other, places behind their end tokens). The token before a text's first is an end token here too, but for the first text's."""
    held: list[bytes] = []
    first = size = 0
    for at, t in enumerate(column.cast(pa.binary()).to_pylist()):
        held.append(t or b"")
        size += len(held[-1]) + 1
        if size >= RUN_BYTES:
            yield first, *_run(held)
            held, first, size = [], at + 1, 0
    if held:
        yield first, *_run(held)


def _run(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = b"\n".join(texts)
    start, end, h = words(raw)
    last = np.frombuffer(raw, np.uint8)[end - 1].astype(np.uint64) if len(end) else np.empty(0, np.uint64)
    borders = np.cumsum([len(t) + 1 for t in texts])
    ends = np.searchsorted(start, borders) + np.arange(1, len(texts) + 1)
    n = len(h) + len(texts)
    word = np.ones(n, bool)
    word[ends - 1] = False
    hs, shape = np.full(n, END), np.full(n, SHAPES, np.int64)
    hs[word], shape[word] = h, _shapes(start, end, last)
    return hs, shape, ends


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, shape, n) of the tokens of a partition, flushed now and then."""
    hs: list[np.ndarray] = []
    ss: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, s = np.concatenate(hs), np.concatenate(ss)
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        hs.clear()
        ss.clear()
        return pa.record_batch([pa.array(u.view(np.int64)), pa.array(s[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "shape", "n"])

    for b in batches:
        for _, h, s, _ in runs(b.column(0)):
            hs.append(h)
            ss.append(s)
            size += len(h)
            if size >= _FLUSH:
                yield flush()
                size = 0
    if hs:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, shape, n): every different token of the texts with its count."""
    return texts.select("text").mapInArrow(_counts, "h long, shape int, n long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


def units_of(h: np.ndarray, shape: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Unit of each token: 0 to len(hot) - 1 by hash, then by shape; the end token's is the last."""
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    own = hot[at] == h if len(hot) else np.zeros(len(h), bool)
    return np.where(own, at, len(hot) + shape)


def _unit_bigrams(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held.value
        m = len(hot) + SHAPES + 1
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            return pa.record_batch([pa.array(u), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for b in batches:
            for _, h, shape, _ in runs(b.column(0)):
                u = units_of(h, shape, hot)
                parts.append(np.append(m - 1, u[:-1]) * m + u)
                size += len(u)
                if size >= 2 * _FLUSH:
                    yield flush()
                    size = 0
        if parts:
            yield flush()

    return run


def by_class(pairs: np.ndarray, cls: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (unit, class after it) and of (unit, class before it)."""
    right = np.stack([pairs[:, cls == c].sum(1, dtype=np.float64) for c in range(k)], axis=1)
    return right, np.stack([pairs[cls == c].sum(0, dtype=np.float64) for c in range(k)], axis=1)


def exchange(pairs: np.ndarray, n_classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """Class of each unit by exchange clustering of a square matrix of bigram counts; the last unit, the end token, has the last class to itself.

    The likelihood is sum f(N(a, b)) - sum f(N(a)) over left classes - sum f(N(b)) over right ones, f(x) = x ln x. It rises with each move; sweeps: an earlier end, for tests.
    """
    m, k = len(pairs), n_classes
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    freq = pairs.sum(0) + pairs.sum(1)
    cls = np.full(m, k - 1)
    order = np.argsort(-freq[: m - 1], kind="stable")
    cls[order] = np.arange(m - 1) % (k - 1)
    right, left = (np.ascontiguousarray(x.T) for x in by_class(pairs, cls, k))  # a class's counts lie side by side, as moves change them
    n = np.stack([right[:, cls == c].sum(1) for c in range(k)])
    fn = f(n)  # kept up to date: a unit's move changes two rows and two columns
    diag = np.diagonal(pairs).astype(np.float64)
    done = 0
    while done != sweeps:
        done += 1
        moved = 0
        for w in order[freq[order] > 0]:
            a = cls[w]
            r, lf, s = right[:, w].copy(), left[:, w].copy(), diag[w]
            r[a] -= s  # without the unit's pairs with itself
            lf[a] -= s
            n[a] -= r
            n[:, a] -= lf
            n[a, a] -= s
            fn[a], fn[:, a] = f(n[a]), f(n[:, a])
            # the gain of adding it to each class, beside what doesn't depend on the class; only classes that it meets count
            i, j = np.flatnonzero(r), np.flatnonzero(lf)
            gain = (f(n[:, i] + r[i]) - fn[:, i]).sum(1) + (f(n[j] + lf[j, None]) - fn[j]).sum(0)
            d = np.diagonal(n)
            gain += f(d + r + lf + s) - f(d + r) - f(d + lf) + np.diagonal(fn)
            out, into = n.sum(1), n.sum(0)
            gain -= f(out + r.sum() + s) - f(out) + f(into + lf.sum() + s) - f(into)
            # rows and columns also gain what the unit has with its own new class
            gain[k - 1] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-6:
                b = a
            n[b] += r
            n[:, b] += lf
            n[b, b] += s
            fn[b], fn[:, b] = f(n[b]), f(n[:, b])
            if b != a:
                cls[w] = b
                before = pairs[:, w].copy()
                right[a] -= before
                right[b] += before
                left[a] -= pairs[w]
                left[b] += pairs[w]
                moved += 1
        if moved * 200 < m:
            break
    return cls


def _find(words_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in a sorted table, and whether they are there."""
    if not len(words_):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(words_, h), len(words_) - 1)
    return at, words_[at] == h


def _around(held):
    """(h, key, n) of the words of the table that aren't units: how often a class comes after (key: the class) and before (key: the class plus their number).

    held: the units' hashes and classes, the table's hashes and the classes of its words by unit, the number of classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, cls, table, of_table, k = held.value
        rest = ~_find(hot, table)[1] & (table != END)
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            return pa.record_batch([pa.array(table[u // (2 * k)].view(np.int64)), pa.array((u % (2 * k)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "key", "n"])

        for b in batches:
            for _, h, shape, _ in runs(b.column(0)):
                at, own = _find(table, h)
                c = np.empty(len(h), np.int64)
                c[own] = of_table[at[own]]
                c[~own] = cls[units_of(h[~own], shape[~own], hot)]
                own &= rest[at] if len(table) else False
                i = np.flatnonzero(own)
                if len(i):
                    before = np.append(c[-1], c[:-1])
                    parts += [at[i] * (2 * k) + c[i + 1], at[i] * (2 * k) + k + before[i]]  # the end token isn't in the table's rest: i + 1 is a token
                    size += 2 * len(i)
                if size >= 2 * _FLUSH:
                    yield flush()
                    size = 0
        if parts:
            yield flush()

    return run


def likelihoods(table: np.ndarray) -> np.ndarray:
    """(2 k, k): the log-probability, of a word in each class, that a class comes after it (first k rows) or before it."""
    k = len(table)
    after = np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * k))
    before = np.log((table + 0.5) / (table.sum(0, keepdims=True) + 0.5 * k))
    return np.concatenate([after.T, before])


def _assign(weights: np.ndarray):
    """Of rows in order of h: the class, but for the end token's, under which a word's bigrams are most likely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def best(h: np.ndarray, gain: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(h), pa.array(gain[:, :-1].argmax(1).astype(np.int32))], names=["h", "cls"])

        for b in batches:
            h, key, n = (c.to_numpy() for c in b.columns)
            if not len(h):
                continue
            names, first = np.unique(h, return_index=True)
            gain = np.add.reduceat(weights[key] * n[:, None], first, axis=0)
            if last is not None:
                if names[0] == last:
                    gain[0] += total
                else:
                    yield best(np.array([last]), total[None, :])
            if len(names) > 1:
                yield best(names[:-1], gain[:-1])
            last, total = names[-1], gain[-1]
        if last is not None:
            yield best(np.array([last]), total[None, :])

    return run


@dataclass
class Model:
    """What goes to all tasks. words, counts, cls: the frequent words in order of hash; by_shape: classes of the others."""

    words: np.ndarray
    counts: np.ndarray
    cls: np.ndarray
    by_shape: np.ndarray  # the last one is the end token's
    step: np.ndarray  # MIX * P(class after | class) / (emission denominator of the class after)
    rest: float  # (1 - MIX) / denominator of P(w)
    total: int
    distinct: int
    least: int  # words seen this often or more are in the table

    def classes_of(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at, own = _find(self.words, h)
        return np.where(own, self.cls[at], self.by_shape[shape]) if len(self.words) else self.by_shape[shape]


def _class_bigrams(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        k = len(model.step)
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for _, h, shape, _ in runs(b.column(0)):
                c = model.classes_of(h, shape).astype(np.int64)
                total += np.bincount(np.append(c[-1], c[:-1]) * k + c, minlength=k * k)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["pair", "n"])

    return run


def fit(train: DataFrame, counts: DataFrame, n_units: int = UNITS, n_classes: int = CLASSES, table_words: int = TABLE_WORDS) -> Model:
    """A model of the texts of train, whose word_counts have been written."""
    spark = train.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    levels = counts.groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("level")).collect()
    least, room = 1 << 62, table_words
    for r in levels:
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    frequent = counts.where(F.col("n") >= least).select("h", "n", "shape").toArrow()
    h, n, shape = frequent.column("h").to_numpy().view(np.uint64), frequent.column("n").to_numpy(), frequent.column("shape").to_numpy()
    order = np.argsort(h)
    h, n, shape = h[order], n[order], shape[order]
    top = [r["h"] for r in counts.where(F.col("h") != F.lit(int(END.view(np.int64)))).orderBy(F.desc("n"), "h").limit(n_units).select("h").collect()]
    hot = np.sort(np.array(top, np.int64).view(np.uint64))
    m = len(hot) + SHAPES + 1
    held = spark.sparkContext.broadcast(hot)
    found = train.select("text").mapInArrow(_unit_bigrams(held), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(m * m)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    del found
    pairs = pairs.reshape(m, m)
    units = exchange(pairs, n_classes)
    right, _ = by_class(pairs, units, n_classes)
    del pairs
    table = np.stack([right[units == c].sum(0) for c in range(n_classes)])
    by_shape = units[len(hot) :].astype(np.int16)
    # the other frequent words, each to the class of its own bigrams
    known = spark.sparkContext.broadcast((hot, units.astype(np.int16), h, units[units_of(h, shape, hot)].astype(np.int16), n_classes))
    rows = train.select("text").mapInArrow(_around(known), "h long, key int, n long").repartition(parts, "h").sortWithinPartitions("h")
    moved = rows.mapInArrow(_assign(likelihoods(table)), "h long, cls int").toArrow()
    cls = np.full(len(h), by_shape[-1], np.int16)
    at, own = _find(hot, h)
    cls[own] = units[at[own]]
    cls[np.searchsorted(h, moved.column("h").to_numpy().view(np.uint64))] = moved.column("cls").to_numpy()
    model = Model(h, n.astype(np.int64), cls, by_shape, table, 0.0, total, distinct, least)
    # tokens and different words of each final class, and their bigrams
    table = np.zeros(n_classes * n_classes)
    for r in train.select("text").mapInArrow(_class_bigrams(spark.sparkContext.broadcast(model)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r["pair"]] = r["n"]
    table = table.reshape(n_classes, n_classes)
    types = np.bincount(cls, minlength=n_classes).astype(np.float64)
    for r in counts.where(F.col("n") < least).groupBy("shape").agg(F.count("*").alias("words")).collect():
        types[by_shape[r["shape"]]] += r["words"]
    after = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * n_classes)
    model.step = MIX * after / (table.sum(0) + 0.5 * (types + 1))
    model.rest = (1 - MIX) / (total + 0.5 * (distinct + 1))
    return model


_ROWS = "uid long, doc_id long, h long, n long, n_tokens long, n_known long, base double, score double"


def _score(held):
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with n null for each text, and a row for each of its words that the table lacks."""
        model: Model = held.value
        denominator = np.log10(model.total + 0.5 * (model.distinct + 1))
        end_class = model.by_shape[-1]
        log_step = np.log10(model.step + model.rest)
        for b in batches:
            uids, ids = b.column(0).to_numpy(), b.column(1)
            heads, tails = [], []
            for first, h, shape, ends in runs(b.column(2)):
                starts = np.append(0, ends[:-1])
                lengths = ends - starts
                at, known = _find(model.words, h)
                cls = model.by_shape[shape]
                cls[known] = model.cls[at[known]]
                logs = np.zeros(len(h))
                logs[known] = np.log10(model.counts[at[known]] + 0.5)
                # each text has its end token, so no sum is over nothing
                logs = np.add.reduceat(logs, starts)
                fixed = np.add.reduceat(log_step[np.append(end_class, cls[:-1]), cls], starts)
                uid = uids[first : first + len(ends)]
                heads.append((uid, lengths, np.add.reduceat(known, starts, dtype=np.int64), logs - lengths * denominator, logs + fixed))
                if not known.all():
                    text = np.repeat(uid, lengths)[~known]
                    rare = h[~known].view(np.int64)
                    order = np.lexsort((rare, text))
                    text, rare = text[order], rare[order]
                    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (rare[1:] != rare[:-1])))
                    tails.append((text[new], rare[new], np.diff(np.append(new, len(rare)))))
            if heads:
                uid, *sums = (np.concatenate(x) for x in zip(*heads, strict=True))
                empty = pa.nulls(len(uid), pa.int64())
                yield pa.record_batch([pa.array(uid), ids, empty, empty, *[pa.array(x) for x in sums]], names=names)
            if tails:
                uid, h, n = (np.concatenate(x) for x in zip(*tails, strict=True))
                yield pa.record_batch([pa.array(uid), pa.nulls(len(uid), pa.int64()), pa.array(h), pa.array(n), *[pa.nulls(len(uid), t) for t in [pa.int64()] * 2 + [pa.float64()] * 2]], names=names)

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(uid, doc_id, n_tokens, n_known, base_score, score) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(_score(held), _ROWS)
    # a text's own row meets no word: its key is spread, and marked
    rows = rows.withColumns({"__k": F.coalesce("h", F.xxhash64("uid")), "__word": F.col("h").isNotNull()})
    rare = counts.where(F.col("n") < model.least).select(F.col("h").alias("__k"), F.lit(True).alias("__word"), F.col("n").alias("c"))
    found = rows.join(rare, ["__k", "__word"], "left")
    log = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    zero = F.lit(0.0)
    return found.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", log, zero)).alias("base_score"), F.sum(F.coalesce("score", log, zero)).alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def op5(docs: DataFrame) -> DataFrame:
    train = docs.where(~held_out(F.col("doc_id")))
    counts = cut(word_counts(train))
    model = fit(train, counts)
    out = score(docs, model, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
