"""The pipeline against a plain one, stage by stage."""

import collections

import corpus_pipeline
import test_similar

from strandgrid.llm import linededup, pii, quality
from strandgrid.llm.common import cut


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = cut(stages["quality_rules"](spark, docs, sf))
    assert kept.columns == columns and set(texts(kept)) == {r["doc_id"] for r in quality.op4(docs).where("kept").collect()}
    lines = cut(stages["line_dedup"](spark, kept, sf))
    before, after = texts(kept), texts(lines)
    want = linededup.brute(list(before.items()))
    assert lines.columns == columns and set(before) == set(after)
    assert all(len(before[i].split("\n")) - want[i][1] == (len(after[i].split("\n")) if want[i][0] > want[i][1] else 0) for i in before)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = cut(stages["simhash_near_dedup"](spark, lines, sf))
    groups = test_similar.plain(list(after.items()))
    assert near.columns == columns and texts(near) == {i: after[i] for i in after if groups[i] == i}
    clean = cut(stages["pii"](spark, near, sf))
    assert texts(clean) == {i: pii.redact(t, pii.find(t)) for i, t in texts(near).items()}
    packed = stages["best_fit_packing"](spark, clean, sf).collect()
    assert {r["doc_id"] for r in packed} == set(texts(clean))
    whole = corpus_pipeline.run(spark, sf).collect()
    row = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert collections.Counter(map(row, whole)) == collections.Counter(map(row, packed))


def test_odd_and_empty(spark, odd, none, tmp_path):
    for name, df in (("odd", odd), ("none", none)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.count() == 0 if name == "none" else out.count() > 0
