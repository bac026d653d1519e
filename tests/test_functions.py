import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandgrid.functions import distance, ramanujan, sequence

DNA = st.text("ACGT", min_size=1, max_size=40)


def rows(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, seq string")


def test_codes_round_trip(spark):
    g = random.Random(1)
    seqs = ["".join(g.choice("ACGTN") for _ in range(g.randint(20, 39))) for _ in range(10)] + ["ATCG" * 128, ""]
    out = rows(spark, *seqs).select("seq", sequence.decode(sequence.encode("seq")).alias("back")).collect()
    assert all(r["seq"] == r["back"] for r in out)


def test_strict_and_lenient_codes(spark):
    with pytest.raises(Exception, match="not a base"):
        rows(spark, "ACgT").select(sequence.encode("seq")).collect()
    assert rows(spark, "AC\nGxT").select(sequence.encode_lenient("seq").alias("c")).first()["c"] == [0, 1, 2, 4, 3]


def test_windows_are_those_of_slices(spark):
    g = random.Random(2)
    seqs = ["".join(g.choice("ACGT") for _ in range(n)) for n in (0, 3, 30, 31, 127, 128, 129, 300, 9000, 20000)]
    for k, gap, drop in ((31, 1, False), (31, 7, True), (5, 100, False), (200, 3, False)):
        got = {(r["id"], r["pos"]): r["kmer"] for r in sequence.explode_kmers(rows(spark, *seqs), k, gap, drop_last=drop).collect()}
        want = {(i, p): s[p : p + k] for i, s in enumerate(seqs) for p in range(0, len(s) - k + (0 if drop else 1), gap)}
        assert got == want
    short = rows(spark, *seqs[:6])
    assert {(r["id"], r["w"]["pos"]) for r in short.select("id", F.explode(sequence.kmers("seq", 31)).alias("w")).collect()} == {(i, p) for i, s in enumerate(seqs[:6]) for p in range(len(s) - 30)}


def test_fnv_and_fast_modulo(spark):
    def fnv(codes):
        h = 0x811C9DC5
        for c in codes:
            h = ((h ^ c) * 0x01000193) % 2**32
        return h

    r = rows(spark, "ACGTACG").select(sequence.fnv1a(sequence.encode("seq")).alias("h"), sequence.fnv1a(sequence.encode("seq"), [6, 5, 4, 3, 2, 1, 0]).alias("b")).first()
    codes = [0, 1, 2, 3, 0, 1, 2]
    assert (r["h"], r["b"]) == (fnv(codes), fnv(codes[::-1]))
    assert rows(spark, "A").select(sequence.fast_modulo(F.lit(2**32 - 1).cast("long"), 64).alias("m")).first()["m"] == 63


def test_ramanujan_sums_are_the_complex_ones():
    from math import gcd

    for q in range(1, 25):
        for j in range(1, 25):
            direct = sum(np.exp(2j * np.pi * a * j / q) for a in range(1, q + 1) if gcd(a, q) == 1)
            assert abs(direct - ramanujan.ramanujan_sum(q, j)) < 1e-9


def test_transform_ignores_strand(spark):
    g = random.Random(3)
    seqs = ["".join(g.choice("ACGT") for _ in range(31)) for _ in range(5)]
    df = rows(spark, *seqs).withColumn("rc", sequence.reverse_complement("seq"))
    udf = ramanujan.rft_udf(31)
    for r in df.select(udf("seq").alias("a"), udf("rc").alias("b"), ramanujan.rft("seq", 31).alias("c")).collect():
        assert np.allclose(r["a"], r["b"]) and np.array_equal(r["a"], r["c"])


def test_known_distances(spark):
    k = "ATCGATCGATCGATCGATCGATCGATCGATC"
    mis, gap = "T" + k[1:], k[1:] + "G"
    df = spark.createDataFrame([(k, mis), (k, gap), (mis, gap)], "a string, b string")
    assert [r["d"] for r in df.select(distance.edits("a", "b").alias("d")).collect()][0] == 1
    assert [r["d"] for r in df.select(distance.hamming("a", "b").alias("d")).collect()][0] == 1
    assert [r["d"] for r in df.select(distance.bounded_edits("a", "b", 1).alias("d")).collect()] == [1, None, None]


def plain_local(q, t):
    h = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    e = [[-(10**9)] * (len(t) + 1) for _ in range(len(q) + 1)]
    f = [r[:] for r in e]
    best = 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            e[i][j] = max(e[i][j - 1] - 2, h[i][j - 1] - 5)
            f[i][j] = max(f[i - 1][j] - 2, h[i - 1][j] - 5)
            s = 0 if "N" in (q[i - 1], t[j - 1]) else 2 if q[i - 1] == t[j - 1] else -3
            h[i][j] = max(0, h[i - 1][j - 1] + s, e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTN", max_size=25), st.text("ACGT", max_size=25)), min_size=1, max_size=8))
def test_local_scores(pairs):
    got = distance.local_scores([a for a, _ in pairs], [b for _, b in pairs], at_once=3)
    assert got.tolist() == [plain_local(a, b) for a, b in pairs]


def plain_alignment(q, t):
    """(score, columns) of the shortest of the best local alignments, by pairs compared in order."""
    low, add = (-10**9, 0), lambda x, s: (x[0] + s, x[1] - 1)
    h = [[(0, 0)] * (len(t) + 1) for _ in range(len(q) + 1)]
    e, f = ([[low] * (len(t) + 1) for _ in range(len(q) + 1)] for _ in range(2))
    best = (0, 0)
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            e[i][j] = max(add(e[i][j - 1], -2), add(h[i][j - 1], -5))
            f[i][j] = max(add(f[i - 1][j], -2), add(h[i - 1][j], -5))
            s = 0 if "N" in (q[i - 1], t[j - 1]) else 2 if q[i - 1] == t[j - 1] else -3
            h[i][j] = max((0, 0), add(h[i - 1][j - 1], s), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best[0], -best[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTN", max_size=25), st.text("ACGT", max_size=25)), min_size=1, max_size=8))
def test_local_alignments(pairs):
    score, columns = distance.local_alignments([a for a, _ in pairs], [b for _, b in pairs], at_once=3)
    assert list(zip(score.tolist(), columns.tolist(), strict=True)) == [plain_alignment(a, b) for a, b in pairs]


def test_columns_count_gaps():
    core = "ACGTTGCAACGGTTAACCGTACGATCGATTGCA"
    score, columns = distance.local_alignments(["TTT" + core[:16] + "GG" + core[16:]], ["CC" + core])
    assert columns.tolist() == [len(core) + 2] and score.tolist() == [2 * len(core) - 7]


@settings(max_examples=40, deadline=None)
@given(DNA, DNA)
def test_global_cost(a, b):
    m = [[j * 0.6 for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        r = [i * 0.6]
        for j, y in enumerate(b, 1):
            r.append(min(m[-1][j - 1] + (-1.0 if x == y else 0.5), m[-1][j] + 0.6, r[-1] + 0.6))
        m.append(r)
    assert abs(distance.global_cost(a, b) - m[-1][-1]) < 1e-6


def test_mutants_keep_their_length(spark):
    s = "ACGT" * 50
    out = rows(spark, *[s] * 20).select(sequence.mutate("seq", "id", 0.1).alias("m")).collect()
    assert all(len(r["m"]) == len(s) for r in out) and len({r["m"] for r in out}) > 10
    assert rows(spark, s).select(sequence.mutate("seq", "id", 0.0).alias("m")).first()["m"] == s
