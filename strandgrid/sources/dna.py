"""Readers of sequences: FASTA, k-mer tables, query files, distance tables, and text mapped to DNA.

All formats are read by Spark's own readers, a FASTA file record by record, so that files of any
store and size are split among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import clean, explode_kmers

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def dna_of_text(text: Column | str) -> Column:
    """Map Latin letters of either case to bases in turn (a, e, i, ...: A; b, f, ...: C; and so on); drop all else."""
    t = F.col(text) if isinstance(text, str) else text
    return F.translate(F.lower(F.regexp_replace(t, "[^A-Za-z]", "")), _LETTERS, ("ACGT" * 7)[:26])


#: Base code (A, C, G and T from 0 to 3) of each byte of a text that is a Latin letter, 4 for all else.
_BASE_OF = np.full(256, 4, np.uint8)
for _case in "aA":
    _BASE_OF[ord(_case) : ord(_case) + 26] = np.arange(26) % 4


def bases_of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``dna_of_text`` of a whole Arrow array of texts (null: empty): base codes of all, one text after the other, and where each begins and the last ends."""
    texts = pc.fill_null(texts, "")
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    codes = _BASE_OF[np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]] if raw is not None else np.empty(0, np.uint8)
    kept = codes < 4
    return codes[kept], np.append(0, np.cumsum(kept))[ends - ends[0]]


def letters_of_codes(codes: np.ndarray) -> pa.Array:
    """Texts of rows of base codes."""
    n, k = codes.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(np.frombuffer(b"ACGT", np.uint8)[codes])))


def kmers_of_texts(docs: DataFrame, k: int, gap: int, text: str = "text") -> DataFrame:
    """(kmer): different windows of k bases, every gap bases, of the DNA of whole texts, as ``explode_kmers`` of ``contigs_of`` gives them; by whole Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, at = bases_of_texts(b.column(0))
            n = np.maximum((np.diff(at) - k) // gap + 1, 0)
            starts = np.repeat(at[:-1] - gap * (np.cumsum(n) - n), n) + gap * np.arange(int(n.sum()))
            for first in range(0, len(starts), 1 << 16):
                some = starts[first : first + (1 << 16)]
                yield pa.record_batch([letters_of_codes(codes[some[:, None] + np.arange(k)]).unique()], names=["kmer"])

    return docs.select(text).mapInArrow(run, "kmer string").distinct()


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(filename, header, contig_name, seq) of each record, in upper case letters as they are.

    Records begin at ``>``; the header ends with its line; line breaks in the body are dropped and
    anything but A, C, G and T is N. contig_name is ``filename___header``.
    """
    raw = spark.read.option("lineSep", "\n>").text(list(paths)).select("value", F.col("_metadata.file_name").alias("filename"))
    # the first record of a file keeps its own mark
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(record, "\n", 1), "\r$", "")
    body = F.when(F.instr(record, "\n") > 0, F.substring(record, F.instr(record, "\n") + 1, F.length(record))).otherwise(F.lit(""))
    out = raw.select("filename", head.alias("header"), F.concat_ws("___", "filename", head).alias("contig_name"), clean(F.translate(body, "acgt", "ACGT")).alias("seq"))
    return out.where((F.col("header") != "") | (F.col("seq") != ""))


def read_fasta_list(spark: SparkSession, path: str) -> DataFrame:
    """Records of all FASTA files named in a text file, one path a line. The list itself is small: one line for each file."""
    names = [r["value"].strip() for r in spark.read.text(path).collect()]
    return read_fasta(spark, *[n for n in names if n])


def fasta_kmers(records: DataFrame, k: int, gap: int = 1, stop_at_n: bool = False, num: int = 0) -> DataFrame:
    """(contig_name, pos, kmer) of all windows without N; stop_at_n: a record ends at its first window whose last base is N. num: at most so many, 0 for all."""
    seq = F.substring_index("seq", "N", 1) if stop_at_n else F.col("seq")
    rows = explode_kmers(records.select("contig_name", seq.alias("seq")), k, gap).where(~F.col("kmer").contains("N"))
    return rows.limit(num) if num else rows


def sample_kmers(kmer_rows: DataFrame, n: int, share: float = 1.0, seed: int = 0, column: str = "kmer") -> DataFrame:
    """n different k-mers, or fewer: each kept with a probability by a hash of itself and the seed, then the n with the smallest hash."""
    h = F.xxhash64(column, F.lit(seed))
    rows = kmer_rows.select(column).distinct()
    if share < 1:
        rows = rows.where(F.pmod(h, F.lit(1_000_000)) < int(share * 1_000_000))
    return rows.orderBy(h, column).limit(n)


def read_kmer_table(spark: SparkSession, path: str, sep: str = ",", start: int = 0, num: int = 0) -> DataFrame:
    """(kmer, annotation) of a delimited table without header. start and num: rows to skip and to keep, by file order."""
    rows = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith(">"))
    part = F.split("value", "\\Q" + sep + "\\E", 2)
    rows = rows.select(F.get(part, 0).alias("kmer"), F.get(part, 1).alias("annotation"))
    if start:
        rows = rows.offset(start)
    return rows.limit(num) if num else rows


def read_sequence_lines(spark: SparkSession, path: str, k: int, num: int = 0) -> DataFrame:
    """(pos, kmer): all windows of the lines of a table that aren't headers, up to a window that doesn't end in A, C, G or T."""
    rows = spark.read.text(path).where(~F.col("value").startswith(">"))
    seq = F.regexp_extract("value", "^[ACGT]*", 0)
    rows = explode_kmers(rows.select(seq.alias("seq")), k)
    return rows.limit(num) if num else rows


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) of a file: what stands before the first comma, then before the first tab."""
    return spark.read.text(path).select(F.substring_index(F.substring_index("value", ",", 1), "\t", 1).alias("query")).where("query <> ''")


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """A distance table with header: index, k1, k2 and any further columns."""
    return spark.read.csv(path, header=True)


def contigs_of(docs: DataFrame, name: str, text: str = "text", out: str = "contig_id", least: int = 1) -> DataFrame:
    """(out, seq): DNA of whole texts with at least so many bases."""
    return docs.select(F.col(name).alias(out), dna_of_text(text).alias("seq")).where(F.length("seq") >= least)
