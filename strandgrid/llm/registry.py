"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import fingerprints, langid, linededup, lm, packing, pii, quality, sentencepiece_scan, simhash, substring
from .common import table


def _docs(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_document_fingerprints": _docs(fingerprints.op1),
        "op2_sentencepiece": _docs(sentencepiece_scan.op2),
        "op3_substring_dedup": _docs(substring.op3),
        "op4_quality_rules": _docs(quality.op4),
        "op5_lm_scoring": _docs(lm.op5),
        "op6_line_dedup": _docs(linededup.op6),
        "op7_language_id": _docs(langid.op7),
        "op8_pii": _docs(pii.op8),
        "op9_best_fit_packing": _docs(packing.op9),
        "op10_simhash_near_dedup": _docs(simhash.op10),
    }


def oracle_sql() -> dict:
    from .oracles import ORACLES

    return dict(ORACLES)
