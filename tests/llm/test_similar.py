"""Near copies by shared five-word shingles, against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from strandgrid.llm import similar


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    """doc_id to the smallest doc_id of its component."""
    label = {i: i for i, _ in rows}
    sets = [(i, grams(t)) for i, t in sorted(rows)]

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a == b or a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in label}


def varied(seed=5):
    """Texts of 1 to 300 words, each followed by copies with 0 to 8 words replaced, and chains of changes."""
    g = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one two three")]
    for _ in range(40):
        words = [g.choice(vocabulary) for _ in range(g.choice([1, 4, 5, 9, 60, 300]))]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = words if g.random() < 0.5 else list(words)
            for _ in range(g.randint(0, 8)):
                words[g.randrange(len(words))] = g.choice(vocabulary)
    return rows


@pytest.mark.parametrize("block", [similar.BLOCK, 3])
def test_components_are_those_of_all_pairs(spark, block):
    rows = varied()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in similar.near_components(docs, block).collect()} == plain(rows)


def test_many_copies_that_are_not_all_linked(spark, monkeypatch):
    """Copies of one text with two groups of changes each: some pairs are links, most are not."""
    monkeypatch.setattr(similar, "MOST", 0)  # trees from the start
    g = random.Random(11)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(80):
        copy = list(words)
        for k in g.sample(range(0, 120, 5), 3):
            copy[k] = f"x{g.randrange(3)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in similar.near_components(docs).collect()} == plain(rows)


def test_shared_rows_do_not_depend_on_batches():
    g = np.random.default_rng(2)
    rows = sorted({(int(t), int(c)) for t, c in g.integers(0, 30, (300, 2))} | {(99, 5)})
    rows = [r for r in rows for _ in range(int(g.integers(1, 3)))]
    table = pa.table({"token": pa.array([r[0] for r in rows]), "cls": pa.array([r[1] for r in rows]), "i": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([9] * len(rows), pa.int32())})
    held = {t: sorted({c for u, c in rows if u == t}) for t, _ in rows}
    want = [(t, c, c, 9, held[t][0], held[t][0], 9) for t in sorted(held) for c in held[t] if len(held[t]) > 1]
    for size in (1, 2, 7, 1000):
        got = pa.Table.from_batches(list(similar._shared(iter(table.to_batches(max_chunksize=size)))))
        assert list(zip(*(c.to_pylist() for c in got.columns), strict=True)) == want


def test_the_stage_drops_copies_with_many_bits_between_them(spark):
    g = random.Random(8)
    words = [f"w{g.randrange(5000)}" for _ in range(200)]
    near, far = list(words), list(words)
    for k in (30, 90, 150):
        near[k] = "other"
    for k in range(5, 200, 20):
        far[k] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    assert plain(rows) == {1: 1, 2: 1, 3: 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {1, 3}


def test_sketches_rule_out_no_similar_pair():
    sets = [similar.shingles((t or "").encode()) for _, t in varied(6)]
    sets = [x for x in sets if len(x)]
    for k, a in enumerate(sets):
        for b in sets[k:]:
            inter = len(set(a.tolist()) & set(b.tolist()))
            apart = similar.bits_apart(similar.sketch(a), similar.sketch(b))
            assert apart <= len(a) + len(b) - 2 * inter
            assert not similar.alike(inter, len(a), len(b)) or apart <= similar.most_apart(len(a) + len(b))
