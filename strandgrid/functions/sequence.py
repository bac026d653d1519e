"""Column functions on DNA sequences: codes, strands, windows, hashes.

Sequences are strings over A, C, G, T and N. Everything here is a built-in
expression and runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base codes 0 to 4, by place.
ALPHABET = "ACGTN"
FNV_OFFSET, FNV_PRIME, MASK32 = 0x811C9DC5, 0x01000193, 0xFFFFFFFF


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bases(seq: Column | str) -> Column:
    """Array of the characters of a sequence; an empty one for an empty sequence."""
    seq = _c(seq)
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def encode(seq: Column | str) -> Column:
    """Base codes of a sequence; any character outside the alphabet, lower case too, is an error."""
    return F.transform(bases(seq), lambda b: F.when(F.instr(F.lit(ALPHABET), b) > 0, F.instr(F.lit(ALPHABET), b) - 1).otherwise(F.raise_error(F.concat(F.lit("not a base: "), b)).cast("int")))


def clean(raw: Column | str) -> Column:
    """A sequence as a lenient reader sees it: line breaks dropped, all but A, C, G and T is N."""
    return F.regexp_replace(F.regexp_replace(_c(raw), "[\r\n]", ""), "[^ACGT]", "N")


def encode_lenient(raw: Column | str) -> Column:
    return encode(clean(raw))


def decode(codes: Column | str) -> Column:
    return F.array_join(F.transform(_c(codes), lambda i: F.substring(F.lit(ALPHABET), i.cast("int") + 1, F.lit(1))), "")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGT", "TGCA"))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(_c(kmer), reverse_complement(kmer))


def window_starts(seq: Column | str, k: int, gap: int = 1, drop_last: bool = False) -> Column:
    """0-based starts of windows of k bases, every gap bases. drop_last: starts stay below length - k, so a last whole window is left out."""
    last = F.length(_c(seq)) - k - (1 if drop_last else 0)
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(gap))).otherwise(F.array().cast("array<int>"))


#: A place in a string is found by counting from its start, so long sequences go in pieces of pieces.
PIECE, BLOCK = 8192, 128


def with_blocks(rows: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """rows without seq, a row for each block: __n (length of the sequence), __at, __part (its windows of k bases begin in the block)."""
    if k - 1 > PIECE:
        raise ValueError(f"windows have at most {PIECE + 1} bases")
    keep = [c for c in rows.columns if c != seq]
    pieces = rows.withColumn("__n", F.length(seq)).withColumn("__p", F.regexp_extract_all(F.col(seq), F.lit("(?s).{1,%d}" % PIECE), F.lit(0)))
    one = pieces.select(*keep, "__n", F.posexplode(F.transform("__p", lambda p, j: F.concat(p, F.substring(F.coalesce(F.get("__p", j + 1), F.lit("")), 1, k - 1)))).alias("__j", "__t"))
    starts = F.sequence(F.lit(0), F.least(F.col("__n") - F.col("__j") * PIECE, F.lit(PIECE)) - 1, F.lit(BLOCK))
    small = F.explode(F.transform(starts, lambda b: F.struct((F.col("__j") * PIECE + b).alias("at"), F.substring("__t", b + 1, F.lit(BLOCK + k - 1)).alias("part")))).alias("__b")
    return one.select(*keep, "__n", small).select(*keep, "__n", F.col("__b.at").alias("__at"), F.col("__b.part").alias("__part"))


def explode_kmers(rows: DataFrame, k: int, gap: int = 1, seq: str = "seq", drop_last: bool = False) -> DataFrame:
    """rows without seq, a row for each window: pos (0-based, every gap bases) and kmer. Sequences may be of any length."""
    cut = with_blocks(rows, k, seq)
    keep = [c for c in cut.columns if c not in ("__n", "__at", "__part")]
    first = F.ceil(F.col("__at") / gap).cast("int") * gap
    last = F.least(F.col("__at") + BLOCK - 1, F.col("__n") - k - (1 if drop_last else 0))
    here = F.when(first <= last, F.sequence(first, last, F.lit(gap))).otherwise(F.array().cast("array<int>"))
    w = F.explode(F.transform(here, lambda p: F.struct(p.alias("pos"), F.substring("__part", p - F.col("__at") + 1, F.lit(k)).alias("kmer")))).alias("__w")
    return cut.select(*keep, w).select(*keep, "__w.pos", "__w.kmer")


def kmers(seq: Column | str, k: int, gap: int = 1, drop_last: bool = False) -> Column:
    """Array of (pos, kmer), for short sequences; see ``explode_kmers``."""
    s = _c(seq)
    return F.transform(window_starts(s, k, gap, drop_last), lambda i: F.struct(i.alias("pos"), F.substring(s, i + 1, F.lit(k)).alias("kmer")))


def distinct_kmers(seq: Column | str, k: int) -> Column:
    """The different substrings of k bases."""
    s = _c(seq)
    return F.array_distinct(F.transform(window_starts(s, k), lambda i: F.substring(s, i + 1, F.lit(k))))


def fnv1a(codes: Column | str, order: list[int] | None = None) -> Column:
    """32-bit FNV-1a of base codes, visited in the given order of places."""
    codes = _c(codes)
    seen = codes if order is None else F.array(*[F.get(codes, F.lit(i)) for i in order])
    return F.aggregate(seen, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b.cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK32).cast("long")))


def fnv1a_kmer(kmer: Column | str, order: list[int] | int) -> Column:
    """The same of a k-mer itself, as straight-line code: order has the places to visit, or is k."""
    s, h = _c(kmer), F.lit(FNV_OFFSET).cast("long")
    for i in range(order) if isinstance(order, int) else order:
        code = (F.instr(F.lit(ALPHABET), F.substring(s, F.lit(i + 1), F.lit(1))) - 1).cast("long")
        h = (h.bitwiseXOR(code) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK32).cast("long"))
    return h


def fast_modulo(value: Column | str, n: int) -> Column:
    """Map a 32-bit value to 0..n-1 by multiplication: (value * n) >> 32."""
    return F.shiftright(_c(value) * F.lit(n).cast("long"), 32)


def base_counts(seq: Column | str) -> Column:
    """Array of four doubles: how often A, C, G and T occur. A vector that is the same for all orders of the bases."""
    s = _c(seq)
    return F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))).cast("double") for b in "ACGT"])


def random_kmer(seq: Column | str, key: Column | str, k: int) -> Column:
    """A window of k bases at a place fixed by a hash of key; null for a shorter sequence."""
    s, key = _c(seq), _c(key)
    n = F.length(s) - k + 1
    return F.when(n > 0, F.substring(s, F.pmod(F.xxhash64(key), F.greatest(n, F.lit(1))).cast("int") + 1, F.lit(k)))


def mutate(seq: Column | str, key: Column | str, rate: float, indel_share: float = 0.1) -> Column:
    """A copy with random substitutions, insertions and deletions, fixed by a hash of key; as long as the original, filled up with N."""
    s, key = _c(seq), _c(key)
    unit = lambda i, salt: F.pmod(F.xxhash64(key, i, F.lit(salt)), F.lit(1 << 24)).cast("double") / float(1 << 24)
    other = lambda b, i: F.substring(F.lit("ACGTACGT"), F.greatest(F.instr(F.lit("ACGT"), b), F.lit(1)) + 1 + F.floor(unit(i, 3) * 3).cast("int"), F.lit(1))
    random_base = lambda i: F.substring(F.lit("ACGT"), 1 + F.floor(unit(i, 4) * 4).cast("int"), F.lit(1))

    def one(b: Column, i: Column) -> Column:
        change = F.when(unit(i, 2) >= indel_share, other(b, i)).when(unit(i, 5) < 0.5, F.lit("")).otherwise(F.concat(b, random_base(i)))
        return F.when(unit(i, 1) < rate, change).otherwise(b)

    return F.rpad(F.array_join(F.transform(bases(s), one), ""), F.length(s), "N")
