"""Document fingerprints by consistent weighted sampling, with built-in functions alone.

A text is the set of its words, each weighted by how often it occurs. Sample k of a
word w with weight S draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of (w, k):

    t = floor(ln S / r + b),   ln a = ln c - r (t - b + 1)

and the word with the smallest a, together with its t, is element k of the signature.
Two texts agree in an element with the probability sum(min) / sum(max) of their
weights, the generalised Jaccard similarity. Gamma variates are looked up in quantile tables
that a one-row query computes by Newton's method; ln a and the identity of (w, t) share a
long, so that one ``min`` for each k finds the element inside a hash aggregate.

Defined cases: a null or empty text, or one without words, has a signature of zeros, equal
to that of any other such text; a null doc_id comes before all others; rows that share a doc_id
are ordered by a hash of their text; the next document of the last one is the first one (of a
single row, itself); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, words_of

SAMPLES = 64
SEED = 20240229
C_BITS, R_BITS, ID_BITS = 16, 14, 26


def quantiles(spark) -> DataFrame:
    """One row: ln c at 2^C_BITS and r at 2^R_BITS even steps of the Gamma(2, 1) distribution 1 - (1 + x) exp(-x)."""

    def table(bits: int) -> str:
        n = 1 << bits
        step = "x - (1 - (1 + x) * exp(-x) - (i + 0.5D) / {n}D) / (x * exp(-x))".format(n=n)
        return f"transform(sequence(0, {n - 1}), i -> aggregate(sequence(1, 48), 1D, (x, j) -> {step}))"

    return spark.range(1).selectExpr(f"transform({table(C_BITS)}, x -> ln(x)) AS ln_c", f"{table(R_BITS)} AS r")


def _odd(k: int) -> int:
    x = (SEED + k * 0x9E3779B97F4A7C15) & (2**64 - 1)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * m) & (2**64 - 1)
    return (x ^ (x >> 31)) - 2**63


def element(term: Column, ln_weight: Column, k: int, ln_c: Column, r_table: Column) -> Column:
    """A long: ln a above, the identity of (term, t) in the lowest ID_BITS bits."""
    h = F.xxhash64(term.bitwiseXOR(F.lit(_odd(k))))
    bits = lambda at, n: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    c = F.get(ln_c, bits(0, C_BITS).cast("int"))
    r = F.get(r_table, bits(C_BITS, R_BITS).cast("int"))
    b = (bits(C_BITS + R_BITS, 24).cast("double") + F.lit(0.5)) * F.lit(2.0**-24)
    t = F.floor(ln_weight / r + b)
    ln_a = c - r * (t.cast("double") - b + F.lit(1.0))
    who = F.shiftrightunsigned(h, 64 - ID_BITS).bitwiseXOR(t * F.lit(40503)).bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long"))
    return F.shiftleft(((ln_a + F.lit(64.0)) * F.lit(2.0**30)).cast("long"), ID_BITS).bitwiseOR(who)


def with_terms(df: DataFrame, text: str, at: str = "__terms") -> DataFrame:
    """Add the array of (h, n): hash of each different word, and how often it occurs."""
    df = df.withColumn("__h", F.sort_array(F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))))
    h = F.col("__h")
    last = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == F.size(h) - 1) | (F.get(h, i) != F.get(h, i + 1)))
    df = df.withColumn("__last", F.when(F.size(h) > 0, last).otherwise(F.array().cast("array<int>")))
    e = F.col("__last")
    return df.withColumn(at, F.transform(e, lambda i, j: F.struct(F.get(h, i).alias("h"), (i - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("n")))).drop("__h", "__last")


def signatures(df: DataFrame, text: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, signature): one row for each different value of the keys, which must name a row; text must not be null. No text leaves its task before it is a signature."""
    tables = quantiles(df.sparkSession)
    ln_c, r = tables.select("ln_c").scalar(), tables.select("r").scalar()
    terms = with_terms(df.select(*keys, text), text).select(*keys, F.explode_outer("__terms").alias("__t"))
    # the tables as columns of one step: referred to once, they are in the task's code once
    terms = terms.select(*keys, F.col("__t.h").alias("__h"), F.ln(F.col("__t.n").cast("double")).alias("__w"), ln_c.alias("__c"), r.alias("__r"))
    found = terms.groupBy(*keys).agg(*[F.min(element(F.col("__h"), F.col("__w"), k, F.col("__c"), F.col("__r"))).alias(f"__{k}") for k in range(samples)])
    low = lambda k: F.coalesce(F.col(f"__{k}").bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long")), F.lit(0)).cast("int")
    return found.select(*keys, F.array(*[low(k) for k in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal elements: an estimate of the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 7, "0"))), "")


_FIRST = -(2**63)


def cuts_of(quantiles: list[int]) -> list[tuple[int, int]]:
    """First (key, hash) of all ranges but the lowest, in order: a key that several quantiles name is itself divided, by the hash of its texts."""
    out = []
    for key in sorted(set(quantiles)):
        r = bisect_right(quantiles, key) - bisect_left(quantiles, key)
        out += [(key, _FIRST + (j << 64) // r) for j in range(r)]
    return out


def range_of(key: Column, h: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the cuts are at or before (key, h), by halving."""
    if not cuts:
        return F.lit(0)
    keys, hashes = (F.lit([c[k] for c in cuts]).cast("array<bigint>") for k in (0, 1))
    steps = [1 << j for j in range(len(cuts).bit_length() - 1, -1, -1)]

    def step(at: Column, n: Column) -> Column:
        i = at + n - 1
        ck, ch = F.get(keys, i), F.get(hashes, i)
        return F.when(F.coalesce((ck < key) | ((ck == key) & (ch <= h)), F.lit(False)), at + n).otherwise(at)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), step)


def in_order(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """(__bucket, __rank, __copy, doc_id, text, __next): each text with the next document's, by ascending doc_id.

    Documents are dealt to ranges of (doc_id, hash of the text) between quantiles, so that no task holds all, nor all rows of a
    frequent doc_id or of none; the first document of each range is copied to the range before it (__copy = 1).
    """
    spark = docs.sparkSession
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce("doc_id", F.lit(_FIRST)).alias("__key"))
    rows = rows.withColumn("__hash", F.xxhash64("text"))
    quantiles = rows.select(F.percentile_approx("__key", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] or []
    rows = rows.withColumn("__bucket", range_of(F.col("__key"), F.col("__hash"), cuts_of(sorted(quantiles))))
    firsts = sorted((r["b"], r["m"]["__key"], r["m"]["__hash"]) for r in rows.groupBy(F.col("__bucket").alias("b")).agg(F.min(F.struct("__key", "__hash")).alias("m")).collect())
    if not firsts:
        return rows.select("__bucket", F.lit(0).alias("__rank"), F.lit(0).alias("__copy"), "doc_id", "text", F.col("text").alias("__next"))
    to = [(firsts[i - 1][0], k, h) for i, (_, k, h) in enumerate(firsts)]  # the first of all goes behind the last
    values = ", ".join(f"({b}, '{k}', '{h}')" for b, k, h in to)
    small = spark.sql(f"SELECT CAST(col1 AS INT) AS __bucket, CAST(col2 AS BIGINT) AS __key, CAST(col3 AS BIGINT) AS __hash FROM VALUES {values}")
    copies = rows.drop("__bucket").join(F.broadcast(small), ["__key", "__hash"])
    both = rows.withColumn("__copy", F.lit(0)).unionByName(copies.withColumn("__copy", F.lit(1)))
    w = Window.partitionBy("__bucket").orderBy("__copy", "__key", "__hash")
    return both.select("__bucket", F.row_number().over(w).alias("__rank"), "__copy", "doc_id", "text", F.coalesce(F.lead("text").over(w), F.lit("")).alias("__next"))


def op1(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    rows = in_order(docs)
    n = F.length("text")
    m = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring("__next", F.lit(1), m))
    rows = rows.withColumn("__edited", edited)
    rows = rows.withColumns({"__n": n.cast("long"), "__sha": F.sha2("__edited", 256)})
    # kind 0: the text, 1: the edited text; the rows of a range stay in its task
    both = rows.select("__bucket", "__rank", "__copy", "doc_id", "__n", "__sha", F.posexplode(F.array("text", "__edited")).alias("__kind", "__text"))
    signed = signatures(both, "__text", ["__bucket", "__rank", "__copy", "doc_id", "__n", "__sha", "__kind"], samples)
    w = Window.partitionBy("__bucket").orderBy("__rank", "__kind")
    s = F.col("signature")
    found = signed.withColumns({"__e": F.lead(s, 1).over(w), "__f": F.lead(s, 2).over(w)}).where("__kind = 0 AND __copy = 0")
    return found.select("doc_id", F.col("__n").alias("n_chars"), F.col("__sha").alias("edited_sha256"), as_text(s).alias("fingerprint"), as_text(F.col("__e")).alias("edited_fingerprint"), likeness(s, F.col("__e")).alias("near_edited"), likeness(s, F.col("__f")).alias("near_next"))
