import os

import pytest
from pyspark.sql import functions as F

from strandgrid import cli
from strandgrid.functions.sequence import base_counts, explode_kmers
from strandgrid.operators import grid
from strandgrid.sources import dna, index
from strandgrid.streaming import server

RECORDS = {"one x": "ACGT" * 8, "two": "ACGTTGCA" * 7 + "ACGTAC", "three|y": "TTGACC" * 15 + "ACGT"}


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    p = tmp_path_factory.mktemp("fa") / "small.fa"
    p.write_text("".join(f">{h}\n" + "\n".join(s[i : i + 20] for i in range(0, len(s), 20)) + "\n" for h, s in RECORDS.items()))
    return str(p)


def test_fasta(spark, fasta):
    rows = dna.read_fasta(spark, fasta)
    assert {r["header"]: r["seq"] for r in rows.collect()} == RECORDS
    assert {r["contig_name"] for r in rows.collect()} == {f"small.fa___{h}" for h in RECORDS}
    assert dna.fasta_kmers(rows, 31).count() == 2 + 32 + 64
    assert dna.fasta_kmers(rows, 31, num=5).count() == 5
    lst = os.path.join(os.path.dirname(fasta), "list.txt")
    with open(lst, "w") as f:
        f.write(fasta + "\n\n")
    assert dna.read_fasta_list(spark, lst).count() == 3
    assert dna.sample_kmers(dna.fasta_kmers(rows, 31), 7).count() == 7


def test_windows_with_n(spark):
    rows = spark.createDataFrame([("c", "ACGTNACGT")], "contig_name string, seq string")
    assert {r["pos"] for r in dna.fasta_kmers(rows, 3).collect()} == {0, 1, 5, 6}
    assert {r["pos"] for r in dna.fasta_kmers(rows, 3, stop_at_n=True).collect()} == {0, 1}


def test_tables(spark, tmp_path):
    (tmp_path / "k.csv").write_text("ACGT,first\nTTTT,second one, more\nGGGG\n")
    assert [tuple(r) for r in dna.read_kmer_table(spark, str(tmp_path / "k.csv")).collect()] == [("ACGT", "first"), ("TTTT", "second one, more"), ("GGGG", None)]
    assert dna.read_kmer_table(spark, str(tmp_path / "k.csv"), start=1, num=1).first()["kmer"] == "TTTT"
    (tmp_path / "q.txt").write_text("ACGT,x\nTTTT\ty\n\n")
    assert [r["query"] for r in dna.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["ACGT", "TTTT"]
    (tmp_path / "s.txt").write_text(">h\nACGTNACG\n")
    assert [r["kmer"] for r in dna.read_sequence_lines(spark, str(tmp_path / "s.txt"), 3).collect()] == ["ACG", "CGT"]


def test_index(spark, tmp_path):
    df = spark.createDataFrame([("ACGT",), ("AAAA",), ("CCCC",)], "kmer string").withColumn("v", base_counts("kmer"))
    c = grid.cover(df, 1.0)
    index.write_table(c, str(tmp_path), "kmers", 4)
    stored = index.read_table(spark, str(tmp_path), "kmers")
    one = c.where("kmer = 'AAAA'").select("cell")
    assert [r["kmer"] for r in index.lookup_cells(stored, one, 4).collect()] == ["AAAA"]
    with pytest.raises(ValueError):
        index.write_table(c, str(tmp_path), "other")
    made = []
    for _ in range(2):
        index.build(spark, str(tmp_path / "t"), lambda: made.append(1) or df)
    assert made == [1]
    index.write_model(spark, {"k": 4, "center": [0.5]}, str(tmp_path / "m"))
    assert index.read_model(spark, str(tmp_path / "m")) == {"k": 4, "center": [0.5]}


def test_requests(spark, tmp_path):
    k = ["ACGTACGTAC", "ACGTACGTAA", "GGGGGGGGGG"]
    covered = grid.cover(spark.createDataFrame([(s,) for s in k], "kmer string").withColumn("v", base_counts("kmer")), 1.0)
    vector = lambda df, c: df.withColumn("v", base_counts(c))
    lines = ['{"id": "a", "type": "handshake"}', '{"id": "b", "query": "ACGTACGTAC", "outer_radius": 3.0, "inner_radius": 0.1}', '{"id": "c", "query": "GGGGGGGGGG", "search_mode": "coarse", "outer_radius": 0.0}', "nonsense"]
    got = server.answer(server.parse(spark.createDataFrame([(x,) for x in lines], "value string")), covered, vector, 1.0, 4, 10).collect()
    assert {(r["id"], r["hit"]) for r in got} == {("a", None), ("b", k[0]), ("b", k[1]), ("c", k[2])}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.txt").write_text("\n".join(lines))
    seen = []
    q = server.serve(spark.readStream.text(str(tmp_path / "in")), covered, vector, 1.0, 4, 10, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 4


def test_command_line(spark, fasta, tmp_path):
    run = lambda *a: cli.main([str(x) for x in a])
    rot, idx = tmp_path / "rot", tmp_path / "idx"
    run("build", "rotation", fasta, "--fasta", "--k", 31, "--out", rot)
    run("build", "kmer", fasta, "--fasta", "--rotation", rot, "--index", idx, "--side", 0.5, "--d", 4)
    run("build", "blooms", "--index", idx)
    run("stats", "index", "--what", "cover-stats", "--index", idx, "--out", tmp_path / "stats")
    assert spark.read.csv(str(tmp_path / "stats"), header=True).first()["kmers"] == "98"
    q = RECORDS["two"][:31]
    run("search", "seq", q, "--index", idx, "--out", tmp_path / "hits", "--inner", 0)
    assert {r["value"] for r in spark.read.text(str(tmp_path / "hits")).collect()} == {f"{q} {q}"}
    run("build", "regrid", idx, "--index", tmp_path / "re", "--side", 2.0)
    run("build", "merge", idx, idx, "--index", tmp_path / "both")
    assert spark.read.parquet(str(tmp_path / "both" / "kmers")).count() == 196
    run("build", "contig", fasta, "--rotation", rot, "--index", tmp_path / "con", "--d", 4)
    run("search", "contig", fasta, "--index", tmp_path / "con", "--radius", 0, "--out", tmp_path / "ch")
    assert spark.read.csv(str(tmp_path / "ch"), sep="\t").count() >= 1
    run("dists", "lev", fasta, "--k", 31, "--gap", 10, "--out", tmp_path / "d")
    assert spark.read.csv(str(tmp_path / "d"), header=True).select(F.col("lev").cast("int")).first()[0] >= 0
    (tmp_path / "req").mkdir()
    (tmp_path / "req" / "a.json").write_text('{"id": "a", "query": "%s", "outer_radius": 0.0, "inner_radius": 0.0}\n' % q)
    run("search", "serve", tmp_path / "req", "--index", idx, "--out", tmp_path / "answers", "--once")
    assert {(r["id"], r["hit"]) for r in spark.read.json(str(tmp_path / "answers")).collect()} == {("a", q)}
    run("stats", "probe", fasta, fasta, "--k", 20, "--gap", 5, "--out", tmp_path / "p")
    assert spark.read.csv(str(tmp_path / "p"), header=True).where("lev = 0").count() > 0
    with pytest.raises(SystemExit):
        run("stats", "nothing")


def test_kmers_of_texts(spark):
    from strandgrid.sources.dna import contigs_of, kmers_of_texts

    texts = ["Lorem ipsum dolor sit amet, consectetur " * 9, "ÄöKK É" * 20, "", None, "abc", "z" * 31, "a1b2\n" * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for k, gap in ((31, 100), (5, 1), (7, 3)):
        want = {r["kmer"] for r in explode_kmers(contigs_of(docs, "doc_id"), k, gap).select("kmer").collect()}
        got = [r["kmer"] for r in kmers_of_texts(docs, k, gap).collect()]
        assert want and sorted(got) == sorted(want)
