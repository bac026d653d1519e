"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again for the next one. All stages but the last
return the columns of docs; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgrid.llm import linededup, packing, pii, quality, simhash
from strandgrid.llm.common import cut, table


def _columns_of(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, the length counted again where there is a text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule. A null or empty text has too few words and goes; repeated rows are judged one by one."""
    return quality.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds. A text whose lines all go is empty; a null one stays null; rows of one doc_id count as one document, as do those without."""
    return _columns_of(docs, linededup.dedup_lines(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of five-word shingles shared), that of the smallest doc_id. Texts without a word are copies of each other; rows that share the kept doc_id all stay."""
    return simhash.near_dedup(docs, similar=True)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. A null or empty text stays as it is."""
    return _columns_of(docs, pii.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences. A null or empty text is a piece of one token; an empty table gives no row."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", redact_pii),
    ("best_fit_packing", best_fit_packing),
]

#: The last stage's tokens aren't SQL's to make; tests/llm holds the pipeline against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = cut(docs)
    return docs
