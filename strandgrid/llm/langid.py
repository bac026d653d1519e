"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text forwards and backwards, labels every
position with a distribution over languages, and the mean of these is the
document's. It is trained with numpy by backpropagation through time on
a bounded sample (``PER_LANG`` texts for each language, chosen by a hash, of which windows of ``TRAIN_STEPS`` bytes are
drawn), with a loss at every position. Whole texts are labelled, in stretches of ``STRETCH`` bytes; both recurrences begin
``LEAD`` bytes before the positions that a stretch counts, so that each position has its surroundings, across borders too.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled
document to learn from every text is ``und``; ties go to the language that sorts first; an empty
table gives an empty result; lang, source and doc_id aren't read in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN = 16
PER_LANG = 512
TRAIN_STEPS, BATCH, UPDATES, RATE = 64, 128, 360, 0.01
STRETCH, LEAD, STRETCHES = 512, 32, 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights by name; the first axis of w, u and b is the direction (forwards, backwards)."""

    def __init__(self, n_langs: int, hidden: int = HIDDEN, seed: int = 7):
        g = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (g.standard_normal(s) * k).astype(np.float32)
        self.w = {"w": f(2, 256, 3 * hidden, k=0.3), "u": f(2, hidden, 3 * hidden, k=hidden**-0.5), "b": np.zeros((2, 1, 3 * hidden), np.float32), "o": f(2, hidden, n_langs, k=hidden**-0.5), "c": np.zeros(n_langs, np.float32)}
        self.hidden = hidden

    def states(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (direction, step, row, unit) at each position of the rows x (row, step) of bytes; positions out of mask hold no state."""
        n, steps = x.shape
        k = self.hidden
        w, u = self.w["w"] + self.w["b"], self.w["u"]
        out = np.empty((2, steps, n, k), np.float32)
        xt, mt = np.ascontiguousarray(x.T), mask.T.astype(np.float32)[:, :, None]
        whole = mask.all(axis=0)
        if keep is None:
            return self._states(w, u, xt, mt, whole, out)
        for d in (0, 1):
            h = np.zeros((n, k), np.float32)
            wd, ud = np.ascontiguousarray(w[d]), u[d]
            a, hu = np.empty((n, 3 * k), np.float32), np.empty((n, 3 * k), np.float32)
            gates = np.empty((n, 2 * k), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                wd.take(xt[t], axis=0, out=a, mode="clip")
                np.matmul(h, ud, out=hu)
                np.add(a[:, : 2 * k], hu[:, : 2 * k], out=gates)
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                z, r = gates[:, :k], gates[:, k:]
                m = np.tanh(a[:, 2 * k :] + r * hu[:, 2 * k :])
                new = m + z * (h - m)
                if not whole[t]:
                    new *= mt[t]
                keep.append((d, t, h, z.copy(), r.copy(), m, hu[:, 2 * k :].copy()))
                out[d, t] = new
                h = new
        return out

    def _states(self, w: np.ndarray, u: np.ndarray, xt: np.ndarray, mt: np.ndarray, whole: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The same without what training keeps: each gate in an array of its own, with weights halved beforehand, as a sigmoid is 0.5 + 0.5 tanh(x / 2)."""
        _, steps, n, k = out.shape
        half = np.array([0.5, 0.5, 1.0], np.float32)[:, None, None]
        a, g, diff = np.empty((3, n, k), np.float32), np.empty((3, n, k), np.float32), np.empty((n, k), np.float32)
        z, r, m = g
        for d in (0, 1):
            h = np.zeros((n, k), np.float32)
            table = np.ascontiguousarray(w[d].reshape(256, 3, k).transpose(1, 0, 2)) * half
            ud = np.ascontiguousarray(u[d].reshape(k, 3, k).transpose(1, 0, 2)) * np.float32(0.5)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                for gate in range(3):
                    table[gate].take(xt[t], axis=0, out=a[gate], mode="clip")
                    np.matmul(h, ud[gate], out=g[gate])
                g[:2] += a[:2]
                np.tanh(g[:2], out=g[:2])
                g[:2] += 1.0
                m *= r
                m += a[2]
                np.tanh(m, out=m)
                np.subtract(h, m, out=diff)
                diff *= 0.5
                diff *= z
                h = out[d, t]
                np.add(m, diff, out=h)
                if not whole[t]:
                    h *= mt[t]
        return out

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Distributions (step, row, language)."""
        v = states[0] @ self.w["o"][0]
        v += states[1] @ self.w["o"][1]
        v += self.w["c"]
        most = v[:, :, 0].copy()  # languages are few: whole arrays one after the other
        for i in range(1, v.shape[2]):
            np.maximum(most, v[:, :, i], out=most)
        v -= most[:, :, None]
        np.exp(v, out=v)
        total = v[:, :, 0].copy()
        for i in range(1, v.shape[2]):
            total += v[:, :, i]
        v /= total[:, :, None]
        return v

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Backpropagation through time of the mean loss over all positions."""
        keep: list = []
        s = self.states(x, mask, keep)
        p = self.positions(s)
        mt = mask.T[:, :, None].astype(np.float32)
        total = float(mt.sum())
        loss = -float((np.log(np.take_along_axis(p, y[None, :, None], 2) + 1e-9) * mt).sum()) / total
        dv = p.copy()
        dv[:, np.arange(len(y)), y] -= 1
        dv *= mt / total
        k = self.hidden
        g = {n: np.zeros_like(v) for n, v in self.w.items()}
        g["c"] = dv.sum((0, 1))
        for d in (0, 1):
            g["o"][d] = np.tensordot(s[d], dv, ([0, 1], [0, 1]))
        ds = [dv @ self.w["o"][d].T for d in (0, 1)]
        steps = x.shape[1]
        for d in (0, 1):
            dh = np.zeros((len(x), k), np.float32)
            da = np.empty((steps, len(x), 3 * k), np.float32)
            for _, t, h, z, r, m, hm in reversed([q for q in keep if q[0] == d]):
                dh = (dh + ds[d][t]) * mt[t]
                dm = dh * (1 - z) * (1 - m * m)
                dz = dh * (h - m) * z * (1 - z)
                dr = dm * hm * r * (1 - r)
                dhu = np.concatenate([dz, dr, dm * r], axis=1)
                da[t] = np.concatenate([dz, dr, dm], axis=1)
                g["u"][d] += h.T @ dhu
                dh = dh * z + dhu @ self.w["u"][d].T
            flat, at = da.reshape(-1, 3 * k), x.T.ravel()
            order = np.argsort(at, kind="stable")
            names, first = np.unique(at[order], return_index=True)
            g["w"][d][names] = np.add.reduceat(flat[order], first, axis=0)
            g["b"][d] = flat.sum(0, keepdims=True)
        return g, loss


def windows(texts: list[bytes], steps: int, g: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A random window of each text: bytes (row, step) and where there are any."""
    x, mask = np.zeros((len(texts), steps), np.int64), np.zeros((len(texts), steps), bool)
    for i, t in enumerate(texts):
        at = int(g.integers(0, max(1, len(t) - steps + 1)))
        part = np.frombuffer(t[at : at + steps], np.uint8)
        x[i, : len(part)], mask[i, : len(part)] = part, True
    return x, mask


def train(texts: list[bytes], labels: list[int], n_langs: int, updates: int = UPDATES, seed: int = 7) -> Network:
    """Adam on random windows, the languages equally often."""
    net, g = Network(n_langs, seed=seed), np.random.default_rng(seed)
    y = np.array(labels)
    of = [np.flatnonzero(y == k) for k in range(n_langs)]
    m1 = {n: np.zeros_like(v) for n, v in net.w.items()}
    m2 = {n: np.zeros_like(v) for n, v in net.w.items()}
    for step in range(1, updates + 1):
        pick = np.array([g.choice(of[k]) for k in g.integers(0, n_langs, BATCH)])
        x, mask = windows([texts[i] for i in pick], TRAIN_STEPS, g)
        grad, _ = net.gradients(x, mask, y[pick])
        norm = float(np.sqrt(sum((v * v).sum() for v in grad.values())))
        rate = RATE * min(1.0, 3 * (1 - step / (updates + 1)))
        for n, v in grad.items():
            v *= min(1.0, 1.0 / (norm + 1e-9))
            m1[n] += 0.1 * (v - m1[n])
            m2[n] += 0.01 * (v * v - m2[n])
            net.w[n] -= (rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def document_probabilities(net: Network, texts: list[bytes], n_langs: int) -> np.ndarray:
    """Mean distribution over all positions of each text; zeros for an empty one."""
    total = np.zeros((len(texts), n_langs))
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // STRETCH)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = np.maximum(k * STRETCH - LEAD, 0)  # of the bytes read; those counted are from k * STRETCH on
    own = k * STRETCH - first
    counted = np.minimum(STRETCH, size[doc] - k * STRETCH)
    length = np.minimum(own + counted + LEAD, size[doc] - first)
    order = np.argsort(-length, kind="stable")  # the short ones together
    for at in range(0, len(order), STRETCHES):
        rows = order[at : at + STRETCHES]
        i = np.arange(int(length[rows].max()))
        mask = i < length[rows][:, None]
        x = buf[np.minimum((base[doc] + first)[rows][:, None] + i, len(buf) - 1)].astype(np.int64)
        p = net.positions(net.states(x, mask))
        p *= ((i >= own[rows][:, None]) & (i < (own + counted)[rows][:, None])).T[:, :, None]
        np.add.at(total, doc[rows], p.sum(0, dtype=np.float64))
    return total / np.maximum(size, 1)[:, None]


def plain_probabilities(net: Network, text: bytes) -> np.ndarray:
    """The same for one text, step by step from the definition, for tests."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    k, w = net.hidden, {n: v.astype(np.float64) for n, v in net.w.items()}
    total = np.zeros(len(w["c"]))
    for at in range(0, len(text), STRETCH):
        part = text[max(0, at - LEAD) : at + STRETCH + LEAD]
        found = []
        for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
            h, states = np.zeros(k), {}
            for t in order:
                a = w["w"][d][part[t]] + w["b"][d][0]
                u = h @ w["u"][d]
                z, r = sigmoid(a[:k] + u[:k]), sigmoid(a[k : 2 * k] + u[k : 2 * k])
                m = np.tanh(a[2 * k :] + r * u[2 * k :])
                h = states[t] = m + z * (h - m)
            found.append(states)
        for t in range(at, min(at + STRETCH, len(text))):
            q = t - max(0, at - LEAD)
            v = np.exp(found[0][q] @ w["o"][0] + found[1][q] @ w["o"][1] + w["c"])
            total += v / v.sum()
    return total / max(1, len(text))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, langs = model.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                part = texts[at : at + 512]
                has = [t is not None and any(map(str.isalpha, t)) for t in part]
                lang, score = ["und"] * len(part), [0.0] * len(part)
                if langs and any(has):
                    at_ = [i for i, x in enumerate(has) if x]
                    p = document_probabilities(net, [part[i].encode() for i in at_], len(langs))
                    for i, row in zip(at_, p, strict=True):
                        best = int(row.argmax())
                        lang[i], score[i] = langs[best], float(min(1.0, max(0.0, row[best])))
                yield pa.record_batch([b.column(0).slice(at, 512), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def sample(docs: DataFrame, may_learn: Column, per_lang: int = PER_LANG) -> list:
    """At most per_lang rows (lang, h, text) for each language; of a text, a stretch of 512 characters at a place given by a hash.

    A language's rows are kept by a hash of doc_id and text, at a rate that leaves about twice as many as are wanted; only these are shuffled, copies once.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "doc_id", "text")
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not langs:
        return []
    steps = 1 << 30
    rate = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], min(steps, 2 * per_lang * steps // r["n"] + 1))])
    part = F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - 511)).cast("int") + 1, F.lit(512))
    kept = rows.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(steps)) < F.element_at(rate, F.col("lang")))
    once = kept.groupBy("lang", "h").agg(F.min(part).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return once.withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "h", "text").collect()


def fit(docs: DataFrame, may_learn: Column, **how) -> tuple[Network | None, list[str]]:
    rows = sorted(sample(docs, may_learn, **how), key=lambda r: (r["lang"], r["h"], r["text"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None, []
    return train([r["text"].encode() for r in rows], [langs.index(r["lang"]) for r in rows], len(langs)), langs


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(held), "doc_id long, lang_pred string, score double")


def op7(docs: DataFrame) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    return predict(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
