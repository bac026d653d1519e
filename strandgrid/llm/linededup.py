"""Line dedup with two Bloom filters.

1. Every partition hashes the keys of its lines and reports the bits it has set
   once and twice (a key counts once for each document). Bits are merged by
   block: set by two partitions, or twice by one, means twice-seen.
2. The twice-seen filter, of a fixed greatest size, goes to all tasks. Only lines
   whose bits are all in it, the suspected repeats, are shuffled: a digest of
   the key and the doc_id.
3. Digests found in at least two documents are confirmed exactly; the smallest
   doc_id holding one keeps its lines, the others lose theirs.

The filter grows with the number of lines up to a greatest size; beyond, more lines
are suspected and shuffled, and the result stays the same (see bloomfilter.py).

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` code points stay; rows of the same doc_id count as one document (a null
doc_id is a document of its own that comes before all others); a null doc_id's rows
are treated as one document too; an empty table gives an empty result; further
columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloomfilter import filter_bits, suspected, twice_seen
from .common import WS_BYTES, cut, join_counted, lower_bytes, shielded

MIN_CHARS = 10
BITS_PER_LINE = 32


def line_key(line: bytes) -> bytes:
    return lower_bytes(line.strip(WS_BYTES))


def n_code_points(raw: bytes) -> int:
    return len(raw.decode("utf-8", "surrogatepass")) if not raw.isascii() else len(raw)


def eligible_keys(text: str | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(place, key) of the lines that can be removed."""
    out = []
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        key = line_key(line)
        if len(key) >= min_chars and n_code_points(key) >= min_chars:
            out.append((i, key))
    return out


def key_hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _hashes(min_chars: int):
    """Of texts: the hashes of their keys, each once for each text."""
    return lambda texts: key_hashes([k for t in texts for k in {k for _, k in eligible_keys(t, min_chars)}])


def _suspects(bloom, n_bits: int, min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bloom.value, np.uint8)
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {k for _, k in eligible_keys(text, min_chars)}
                keys += own
                ids += [i] * len(own)
            if not keys:
                continue
            hit = suspected(bits, key_hashes(keys), n_bits)
            yield pa.record_batch([pa.array([i for i, x in zip(ids, hit, strict=True) if x], pa.int64()), pa.array([xxhash.xxh3_128_digest(k) for k, x in zip(keys, hit, strict=True) if x], pa.binary())], schema=schema)

    return run


def _drop(columns: list[str], min_chars: int):
    """Remove the lines whose digests the column __drop names; adds __n_lines and __n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(columns.index("text")).to_pylist(), b.column(columns.index("__drop")).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                gone = set()
                if drop:
                    drop = set(drop)
                    gone = {i for i, k in eligible_keys(text, min_chars) if xxhash.xxh3_128_digest(k) in drop}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            own = [pa.array(texts, pa.string()) if c == "text" else b.column(i) for i, c in enumerate(columns) if c != "__drop"]
            yield pa.record_batch([*own, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*[c for c in columns if c != "__drop"], "__n_lines", "__n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs (doc_id, text, ...) without repeated lines, plus __n_lines and __n_dropped; the text is null where it was null and lost nothing."""
    spark = docs.sparkSession
    docs, named = shielded(docs)
    n_lines = docs.select(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    n_bits = filter_bits(n_lines, BITS_PER_LINE)
    bloom = spark.sparkContext.broadcast(twice_seen(docs.select("text"), n_bits, _hashes(min_chars)))
    suspects = cut(docs.select("doc_id", "text").mapInArrow(_suspects(bloom, n_bits, min_chars), "doc_id long, digest binary"))
    first = suspects.groupBy("digest").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nameless"), F.count("*").alias("holders"))
    repeated = first.where((F.col("keep") < F.col("last")) | (F.col("nameless") & F.col("keep").isNotNull())).select("digest", F.when(~F.col("nameless"), F.col("keep")).alias("keep"), "holders")
    spread = F.xxhash64("doc_id").cast("string").cast("binary")
    lost = join_counted(suspects, cut(repeated), "digest", "holders", spread).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    drops = lost.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("digest").alias("__drop")).withColumn("__named", F.lit(True))
    # rows without a doc_id lose nothing: a hash of their text deals them out
    found = docs.withColumns({"__at": F.coalesce("doc_id", F.xxhash64("text")), "__has": F.col("doc_id").isNotNull()})
    found = found.join(drops, (F.col("__at") == F.col("__id")) & (F.col("__has") == F.col("__named")), "left").drop("__id", "__named", "__at", "__has")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return named(found.mapInArrow(_drop(found.columns, min_chars), f"{out}, __n_lines long, __n_dropped long"))


def op6(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def brute(rows: list[tuple]) -> dict:
    """Reference result of the contract for small lists of (doc_id, text)."""
    holders: dict[bytes, set] = {}
    for i, t in rows:
        for _, k in eligible_keys(t, MIN_CHARS):
            holders.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        gone = {p for p, k in eligible_keys(t, MIN_CHARS) if len(holders[k]) > 1 and i != min(holders[k])}
        lines = (t or "").split("\n")
        out[i] = (len(lines), len(gone), hashlib.sha256("\n".join(x for p, x in enumerate(lines) if p not in gone).encode()).hexdigest())
    return out
