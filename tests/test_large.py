"""What larger tables brought to light: queries against their SQL, or a plain version, on tables made for the case."""

import os

import oracle
import pytest

from strandgrid.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables: documents and benchmark given by their texts, embeddings by (label, vector)."""

    def make(documents=(), benchmark=(), embeddings=()):
        rows = {
            "documents": ([(i, t, "en", "made", len(t)) for i, t in enumerate(documents)], "doc_id long, text string, lang string, source string, n_chars long"),
            "benchmark": ([(i, t) for i, t in enumerate(benchmark)], "item_id long, text string"),
            "embeddings": ([(i, x, v) for i, (x, v) in enumerate(embeddings)], "vec_id long, label int, embedding array<float>"),
        }
        for name in oracle.TABLES:
            data, schema = rows.get(name, ([], "x int"))
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return make


def check(spark, name, sf):
    return oracle.compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], sf)


def test_slop_windows_backwards(spark, tables):
    """A later match of the query that lies earlier in the contig ends the run before its start."""
    first, second = "acggtacatttgacgtcagtacaaaggctatcc", "ttgcagcatcgactacgacttacgagcagggat"
    sf = tables(documents=[second + "aaccatgga" * 12 + first], benchmark=[first + "gat" + second])
    assert check(spark, "slop_windows", sf)
    assert any(r["tend"] < r["tstart"] and r["tseq"] for r in catalog.queries()["slop_windows"](spark, sf).collect())


def test_language_states_without_training():
    """The lean pass of prediction gives the states that training keeps, bit for bit."""
    import numpy as np

    from strandgrid.llm.langid import Network

    net, g = Network(3), np.random.default_rng(1)
    x = g.integers(0, 256, (20, 70))
    mask = np.arange(70) < g.integers(0, 71, 20)[:, None]
    assert np.array_equal(net.states(x, mask), net.states(x, mask, []))


@pytest.mark.parametrize("d", [1, 2, 5])
def test_block_join(spark, d):
    """Products of matrices find the pairs that the grid finds; rows without key, number or like length are in none."""
    import numpy as np

    from strandgrid.operators import joins

    v = np.random.default_rng(d).normal(0, 3, (400, d)).tolist()
    odd = [(None, v[0]), (900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, v[0] + [1.0]), (905, v[0] + [1.0]), (906, [1e200] * d), (907, [1e200] * d), (7, v[7])]
    rows = spark.createDataFrame([*enumerate(v), *odd], "id long, v array<double>")
    got = {tuple(r) for r in joins.block_self_join(rows, 0.7, "id", most=150).collect()}
    want = {tuple(r) for r in joins.ball_self_join(rows.where("id not in (900, 901, 902, 903, 906, 907)"), 0.7, "id", dims=1).collect()}
    assert got == want | {(906, 907, 0.0)} and (904, 905, 0.0) in got and len(got) >= 4


def test_one_text_against_many():
    """Bit vectors and masks against the plain definitions, for all lengths and letters."""
    import numpy as np

    from strandgrid.functions import distance

    g = np.random.default_rng(3)
    some = ["".join(g.choice(list("ACGTN"), n)) for n in [0, 1, 5, 31, 31, 32, 32, 33, 63, 64, 64, 65, 80] * 3] + ["é" * 7, "acgt"]
    edits, hamming = distance.to_all(some, some, "edits"), distance.to_all(some, some, "hamming")
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            assert edits[i, j] == distance.plain_edits(a, b), (a, b)
            assert hamming[i, j] == sum(x != y for x, y in zip(a, b)), (a, b)  # noqa: B905


def test_planes(spark):
    from pyspark.sql import functions as F

    from strandgrid.functions import distance

    rows = spark.createDataFrame([("ACGTN" * 12, "NACGT" * 12), ("", ""), ("A" * 62, "N" * 62), ("T", "T")], "a string, b string")
    rows = rows.select(distance.hamming("a", "b").alias("x"), distance.hamming_of_planes(distance.planes("a"), distance.planes("b")).alias("y"))
    assert [r["x"] for r in rows.collect()] == [r["y"] for r in rows.collect()] == [60, 0, 62, 0]
    assert rows.where(F.col("x") != F.col("y")).count() == 0


def test_probe_calibration_is_plain(spark, sf):
    """The kernel's distances against those of built-in expressions."""
    from pyspark.sql import functions as F

    from strandgrid.functions import distance, ramanujan

    got = catalog.queries()["probe_calibration"](spark, sf).where("crc32(k1) % 40 = 0")
    r = ramanujan.rft_udf(64)
    want = got.select("k1", "k2").withColumn("a", r("k1")).withColumn("b", r("k2"))
    want = want.select("k1", "k2", distance.strand_edits("k1", "k2").alias("lev"), F.round(distance.l1("a", "b"), 9).alias("ram"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.schema.simpleString() == want.schema.simpleString()


def test_rotation_dists_of_odd_vectors(spark, tables):
    """Large, small and tied values, and copies, as in the SQL; no row for each pair goes through a loop."""
    v = [[0.5 * i] * 64 for i in range(6)] + [[1e-7] * 64, [2.5e-6, *[0.0] * 63], [1e12] * 64, [0.0] * 64, [0.0] * 64]
    sf = tables(embeddings=[(i % 2, x) for i, x in enumerate(v)])
    assert check(spark, "rotation_dists", sf) == 25


def test_qgrams_shared(spark):
    """Counts of batches against the join, for repeated windows, short rows and few queries at once."""
    import numpy as np

    from strandgrid.operators import bloom

    g = np.random.default_rng(2)
    some = sorted({"".join(g.choice(list("ACGTN"), int(n), p=[0.4, 0.4, 0.1, 0.05, 0.05])) for n in g.integers(1, 40, 300)})
    q, m = spark.createDataFrame([(x,) for x in some[::3]], "query string"), spark.createDataFrame([(x,) for x in some], "kmer string")
    for least in (1, 5):
        got = bloom.qgrams_shared(q, m, 3, least)
        want = bloom.qgram_counts(q, m, 3).where(f"n >= {least}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_implicit_matrix_against_grid(spark):
    """The pairs of the grid, and of equal vectors at radius 0."""
    import numpy as np
    from pyspark.sql import functions as F

    from strandgrid.operators import joins
    from strandgrid.plans import search

    g = np.random.default_rng(6)
    rows = spark.createDataFrame([("".join(g.choice(list("ACGT"), 32)), g.integers(-3, 4, 4).astype(float).tolist()) for _ in range(300)], "kmer string, v array<double>")
    for radius in (0.0, 1.5):
        got = {tuple(r) for r in search.implicit_matrix(rows, radius).select("k1", "k2").collect()}
        want = {tuple(r) for r in joins.ball_self_join(rows, radius, "kmer").select("kmer_1", "kmer_2").collect()}
        assert got == want and got
    pairs = search.implicit_matrix(rows, 1.5)
    assert pairs.where(F.col("dist") != F.levenshtein("k1", "k2")).count() == 0


def test_first_matches_of_many_sections(spark, tables):
    """Contigs with far more sections in a cell than the cap, short ones, and repeated keys; no section is shuffled."""
    import random

    g = random.Random(7)
    texts = ["".join(g.choice("acgt") for _ in range(n)) for n in (4000, 31, 30, 700, 90, 5000)] + ["", "t" * 300 + "a" * 300, "Aé c.G\n" * 60]
    asked = ["".join(g.choice("acgt") for _ in range(n)) for n in (900, 40, 61, 200)] + ["t" * 90 + "a" * 500 + "t" * 90, texts[0][100:400]]
    sf = tables(documents=texts, benchmark=asked)
    assert check(spark, "contig_matches", sf)
    run = catalog.queries()["contig_matches"]
    plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    again = docs.collect() + docs.limit(1).collect() + [(None, texts[3], "en", "made", 700), (None, texts[4], "en", "made", 90)]
    twice = f"{sf}/twice"
    os.makedirs(twice)
    for name in oracle.TABLES:
        if name != "documents":
            os.symlink(f"{sf}/{name}.parquet", f"{twice}/{name}.parquet")
    spark.createDataFrame(again, docs.schema).coalesce(1).write.parquet(f"{twice}/documents.parquet")
    assert run(spark, twice).where("contig_id IS NULL").count() > 0
    assert run(spark, twice).where("contig_id > 0").exceptAll(run(spark, sf)).count() == 0


def test_vector_distances_of_many_queries(spark, tables, monkeypatch):
    """More queries than are sent to all tasks at once: part by part, without a product of partitions, which goes by the disk."""
    import numpy as np

    from strandgrid.operators import joins

    g = np.random.default_rng(3)
    sf = tables(embeddings=[(i % 3, g.random(64).astype("float32").tolist()) for i in range(60)])
    monkeypatch.setattr(joins.small, "__defaults__", (7,))
    monkeypatch.setattr(joins.in_parts, "__defaults__", (7,))
    assert check(spark, "vector_distances", sf) == 20 * 60
    df = catalog.queries()["vector_distances"](spark, sf)
    assert df.count() == 20 * 60 and "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_contig_search_of_many_matches(spark, tables, monkeypatch):
    """A place that comes after any number of other matches of its query with the contig is found, whatever is aligned at once, by the joins as well."""
    import random

    from strandgrid.operators import contigsearch

    g = random.Random(9)
    some = lambda n: "".join(g.choice("abcd") for _ in range(n))
    asked = [some(150) for _ in range(3)]
    before = "".join(asked[0][:31] + some(80) for _ in range(40))
    sf = tables(documents=[before + some(600) + asked[0][60:], "".join(asked)], benchmark=asked)
    run = lambda: sorted(map(tuple, catalog.queries()["contig_search"](spark, sf).collect()))
    got = run()
    assert any(r[:2] == (0, 0) and len(before) + 500 < r[5] for r in got)
    monkeypatch.setattr(contigsearch, "MOST_WINDOWS", 0)
    assert run() == got


def test_grid_search_hamming_of_all_windows(spark, tables, monkeypatch):
    """Windows at any place of a query and of a contig, over the borders of pieces and of diagonals, repeats and short texts; and by the joins."""
    import random

    from strandgrid.operators import sliding

    g = random.Random(4)
    some = lambda n: "".join(g.choice("abcd") for _ in range(n))
    asked = [some(n) for n in (31, 30, 150, 333, 70)] + ["ab" * 40, ""]
    noisy = lambda s: "".join(g.choice("abcd") if g.random() < 0.3 else x for x in s)
    texts = [some(57) + noisy(asked[3]) + some(13) + noisy(asked[2]), asked[0], noisy(asked[3])[:200], "a" * 90, "", "ab" * 45, asked[2][:30], "É" + asked[4][30:] + asked[0]]
    sf = tables(documents=texts, benchmark=asked)
    for piece, diagonals, measured in ((256, 1 << 18, 1 << 18), (7, 128, 100)):
        for name, x in (("PIECE", piece), ("DIAGONALS", diagonals), ("MEASURED", measured)):
            monkeypatch.setattr(sliding, name, x)
        assert check(spark, "grid_search_hamming", sf) > 300
    monkeypatch.setattr(sliding, "MOST_BASES", 0)
    assert check(spark, "grid_search_hamming", sf) > 300


def test_probe_calibration_of_all_windows(spark, tables):
    """Each different window of 64 bases of each contig meets each probe once."""
    import random

    g = random.Random(6)
    some = lambda n: "".join(g.choice("acgt") for _ in range(n))
    texts = [some(n) for n in (300, 64, 63)] + ["ac" * 60, ""]
    asked = [some(130), some(70), some(40)]
    sf = tables(documents=texts, benchmark=asked)
    to_dna = str.maketrans("acgt", "AGGT")  # c and g are both a third letter of four
    k1 = {t[i : i + 64].translate(to_dna) for t in texts for i in range(len(t) - 63)}
    k2 = {t[i : i + 64].translate(to_dna) for t in asked for i in range(0, len(t) - 63, 64)}
    got = [tuple(r) for r in catalog.queries()["probe_calibration"](spark, sf).select("k1", "k2").collect()]
    assert len(got) == len(set(got)) == len(k1) * len(k2) and set(got) == {(a, b) for a in k1 for b in k2}


def test_implicit_matrix_of_many_parts(spark, sf, monkeypatch):
    """The same pairs whatever the number of parts, and no shuffle of all vectors for each of them."""
    import re

    from strandgrid.operators import joins

    run = catalog.queries()["implicit_matrix"]
    want = sorted(map(tuple, run(spark, sf).collect()))
    monkeypatch.setattr(joins.block_self_join, "__defaults__", ("v", 1000, *joins.block_self_join.__defaults__[2:]))
    df = run(spark, sf)
    parts = re.findall(r"MapInArrow run.*?InMemoryTableScan", df._jdf.queryExecution().executedPlan().toString(), re.S)
    assert len(parts) > 2 and not any("Exchange" in x for x in parts)
    assert want and sorted(map(tuple, df.collect())) == want
