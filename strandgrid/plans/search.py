"""The searches: k-mers, contigs, brute force, and distance matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import bounded_edits, edits, hamming, hamming_of_planes, percent_identity, planes, smith_waterman, smith_waterman_aligned, strand_edits, to_all
from ..functions.ramanujan import transform_many
from ..functions.sequence import canonical, explode_kmers
from ..operators import kmersets
from ..operators.bloom import qgram_filter, qgram_threshold
from ..operators.grid import cells as cells_of
from ..operators.grid import slack
from ..operators.intervals import condense, merge_ranges, sequence_range, slop
from ..operators.joins import SMALL_ROWS, ball_join, ball_self_join, block_self_join, small

QGRAM = 7


def coarse(queries: DataFrame, covered: DataFrame, radius: float, side: float, d: int, eps: float = 1.01, v: str = "v", dims: int = 2) -> DataFrame:
    """Queries x cells whose centre is within radius + eps * the grid's slack. Cells are few beside points."""
    return ball_join(queries, cells_of(covered, side).select("cell", "centre"), radius + eps * slack(d, side), v, "centre", dims)


def kmer_search(queries: DataFrame, covered: DataFrame, radius: float, side: float, d: int, inner_radius: float = 0.2, misses: int | None = None, metric: str = "needle", eps: float = 1.01, k: int = 31, raw: bool = False, dims: int = 2) -> DataFrame:
    """(query, hit, dist): coarse search of cells, q-gram filter, distance.

    queries: (query, v); covered: (kmer, v, cell). metric: needle or hamming, both as shares
    of k (raw: as counts), or none: all that passes the filter. misses: edits that the filter allows.
    """
    near = coarse(queries, covered, radius, side, d, eps, dims=dims).select("query", "cell")
    if misses is None:
        misses = ceil(inner_radius if raw else inner_radius * k)
    if metric == "hamming" and k <= 62:
        # most pairs go by their distance, in compiled code, before anything else is looked at
        sides = near.withColumn("__q", planes("query")), covered.select("cell", F.col("kmer").alias("hit"), planes("kmer").alias("__h"))
        dist = hamming_of_planes("__q", "__h")
        dist = (dist if raw else dist / F.lit(k)).cast("double")
        found = sides[0].join(sides[1], "cell").where(dist <= inner_radius).select("query", "hit", dist.alias("dist"))
        return qgram_filter(found, "query", "hit", QGRAM, qgram_threshold(k, QGRAM, misses))
    pairs = near.join(covered.select("cell", F.col("kmer").alias("hit")), "cell").select("query", "hit")
    passed = qgram_filter(pairs, "query", "hit", QGRAM, qgram_threshold(k, QGRAM, misses))
    if metric == "none":
        return passed.withColumn("dist", F.lit(None).cast("double"))
    if metric == "needle":
        bound = floor((inner_radius if raw else inner_radius * k) + 1e-9)
        dist = bounded_edits("query", "hit", bound).cast("double") / F.lit(1.0 if raw else float(k))
    else:
        dist = hamming("query", "hit", not raw).cast("double")
    return passed.withColumn("dist", dist).where(F.col("dist") <= inner_radius)


#: Rows, and queries, that are compared at once.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 1 << 12, 1 << 9


def _compared(held, kernel: Callable, at_once: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = held.value
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                rows = part.column(0).to_pylist()
                for first in range(0, len(texts), QUERIES_AT_ONCE):
                    own = texts[first : first + QUERIES_AT_ONCE]
                    found = kernel(own, rows)
                    ends = pa.array(np.arange(0, len(rows) * len(own) + 1, len(own), dtype=np.int32))
                    yield pa.record_batch([part.column(0), pa.array(np.full(len(rows), first, np.int32)), *[pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in found]], names=names)

    return run


def against_all(queries: DataFrame, members: DataFrame, kernel: Callable, kinds: dict[str, str], query: str = "query", member: str = "kmer", at_once: int = ROWS_AT_ONCE) -> DataFrame | None:
    """Columns of the queries, the member, and the columns of kinds (name to type: int or double) for every query and every member; None for over ``SMALL_ROWS`` queries.

    kernel(texts of queries, members) gives an array (member, query) for each of these columns. Queries go to all tasks; a member leaves
    its task as one row with an array for each column.
    """
    rows = queries.limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        return None
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [r for r in rows if r[query] is not None]
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__i int, " + ", ".join(f"`{c}` {t}" for c, t in queries.dtypes))
    held = spark.sparkContext.broadcast([r[query] for r in rows])
    names = ["__m", "__first", *kinds]
    schema = "__m string, __first int, " + ", ".join(f"{c} array<{t}>" for c, t in kinds.items())
    found = members.select(member).where(F.col(member).isNotNull()).repartition(n).mapInArrow(_compared(held, kernel, at_once, names), schema)
    each = F.posexplode(F.arrays_zip(*kinds)).alias("__at", "__x") if len(kinds) > 1 else F.posexplode(next(iter(kinds))).alias("__at", next(iter(kinds)))
    found = found.select("__m", "__first", each)
    values = [F.col(f"__x.{c}").alias(c) for c in kinds] if len(kinds) > 1 else [F.col(c) for c in kinds]
    found = found.select(F.col("__m").alias(member), (F.col("__first") + F.col("__at")).alias("__i"), *values)
    return found.join(F.broadcast(numbered), "__i").drop("__i")


def linear_search(queries: DataFrame, members: DataFrame, metric: str = "needle") -> DataFrame:
    """Columns of queries (query and others), kmer, dist: every query against every row. The queries are a stated set, small beside the rows, which stay where they are."""
    plain = {"needle": edits, "hamming": hamming}[metric]
    kind = {"needle": "edits", "hamming": "hamming"}[metric]
    found = against_all(queries, members, lambda texts, rows: [to_all(texts, rows, kind)], {"dist": "int"})
    if found is not None:
        return found.withColumn("dist", F.col("dist").cast("long"))
    return members.select("kmer").join(queries).withColumn("dist", plain("query", "kmer"))


def strands_and_transforms(k: int) -> Callable:
    """A kernel of ``against_all`` for k-mers of A, C, G, T and N: edits to the nearer strand of the query, L1 distance of the transforms."""

    def run(texts: list[str], rows: list[str]) -> list[np.ndarray]:
        other = str.maketrans("ACGT", "TGCA")
        lev = np.minimum(to_all(texts, rows, "edits"), to_all([t.translate(other)[::-1] for t in texts], rows, "edits"))
        # sums term by term, in the order of the plain definition, so that none rounds otherwise; tiles of so many pairs as a processor's cache holds
        a, b = transform_many(rows, k).T.copy(), transform_many(texts, k).T.copy()
        ram, size = np.zeros((len(rows), len(texts))), max(1, (1 << 14) // len(texts))
        diff = np.empty((min(size, len(rows)), len(texts)))
        for at in range(0, len(rows), size):
            total = ram[at : at + size]
            own = diff[: len(total)]
            for x, y in zip(a[:, at : at + size], b, strict=True):
                np.subtract(x[:, None], y, out=own)
                np.abs(own, out=own)
                total += own
        return [lev, ram]

    return run


def query_windows(queries: DataFrame, k: int, query: str = "query_id", seq: str = "seq") -> DataFrame:
    """(query, q_start, q_end, kmer): windows every k // 2 bases, (length - k + 1) // (k // 2) of them."""
    gap = k // 2
    rows = explode_kmers(queries.select(query, F.length(seq).alias("n"), seq), k, gap, seq)
    rows = rows.where(F.col("pos") / gap < F.floor((F.col("n") - k + 1) / gap))
    return rows.select(query, F.col("pos").alias("q_start"), (F.col("pos") + k).alias("q_end"), "kmer")


def contig_matches(windows: DataFrame, cells: DataFrame, sections: DataFrame, radius: float, k: int, cap: int | None = 20, v: str = "v", dims: int = 2, query: str = "query_id", contig: str = "contig_id") -> DataFrame:
    """(query, contig, q_start, q_end, t_start, t_end): coarse search of windows (query, q_start, q_end, v), ranges merged for each cell, joined to the
    cells' sections (contig, cell, start_coord, end_coord), the first cap of each pair condensed."""
    near = ball_join(windows, cells.select("cell", "centre"), radius, v, "centre", dims).select(query, "cell", "q_start", "q_end")
    ranges = merge_ranges(near, [query, "cell"], k)
    rows = ranges.join(sections, "cell").select(query, contig, "q_start", "q_end", F.col("start_coord").alias("t_start"), F.col("end_coord").alias("t_end"))
    return condense(rows, [query, contig], k, cap)


def fine_search(matches: DataFrame, queries: DataFrame, sequences: DataFrame, k: int, identity: float, query: str = "query_id", contig: str = "contig_id") -> DataFrame:
    """(query, contig, score, qstart, qend, tstart, tend, qseq, tseq): alignment of each match made k longer on either side; score in per cent."""
    rows = matches.join(queries.select(query, F.col("seq").alias("__q")), query)
    qs, qe = slop("q_start", "q_end", k, F.length("__q"))
    ts, te = slop("t_start", "t_end", k)
    rows = rows.select(query, contig, "__q", qs.alias("qstart"), qe.alias("qend"), ts.alias("tstart"), te.alias("tend"))
    rows = rows.where(((F.col("qend") - F.col("qstart")) >= k) & ((F.col("tend") - F.col("tstart")) >= k))
    rows = rows.join(sequences.select(contig, F.col("seq").alias("__t")), contig)
    rows = rows.withColumn("qseq", sequence_range("__q", "qstart", "qend")).withColumn("tseq", sequence_range("__t", "tstart", "tend")).drop("__q", "__t")
    rows = rows.withColumn("score", percent_identity(smith_waterman("qseq", "tseq"), F.col("qend") - F.col("qstart")))
    return rows.where(F.col("score") >= identity).select(query, contig, "score", "qstart", "qend", "tstart", "tend", "qseq", "tseq")


def contig_search(queries: DataFrame, windows: DataFrame, cells: DataFrame, sections: DataFrame, sequences: DataFrame, coarse_radius: float, side: float, d: int, k: int, identity: float = 50.0, cap: int | None = None, **how) -> DataFrame:
    """Coarse search, merge, alignment of all matches (cap: of the first so many of each pair); identity in per cent."""
    matches = contig_matches(windows, cells, sections, coarse_radius + slack(d, side), k, cap, **how)
    return fine_search(matches, queries, sequences, k, identity)


def ssw_search(queries: DataFrame, targets: DataFrame, identity: float, least: int = 256) -> DataFrame:
    """(query_id, target_id, score, aln_len): Smith-Waterman of a stated set of queries against all targets. aln_len: the columns of the
    alignment, gaps included; score: in per cent of the best that so many bases can have. Both must be met."""
    queries = queries.select("query_id", F.col("seq").alias("__q"))
    rows = targets.select("target_id", F.col("seq").alias("__t")).join(small(queries))
    # each column of an alignment has a base of one of the two
    rows = rows.where(F.length("__q") + F.length("__t") >= least)
    rows = rows.withColumn("__a", smith_waterman_aligned("__q", "__t"))
    rows = rows.select("query_id", "target_id", percent_identity(F.col("__a.score"), F.col("__a.aln_len")).alias("score"), F.col("__a.aln_len").alias("aln_len"))
    return rows.where((F.col("aln_len") >= least) & (F.col("score") >= identity))


def canonical_kmers(contigs: DataFrame, k: int, gap: int, seq: str = "seq") -> DataFrame:
    """(kmer): different canonical k-mers of windows every gap bases; a last window that ends with its sequence is left out."""
    if gap == 1 and kmersets.LEAST_K <= k <= kmersets.MOST_K:
        return kmersets.canonical_distinct(contigs, k, seq)
    return explode_kmers(contigs.select(seq), k, gap, seq, drop_last=True).select(canonical("kmer").alias("kmer")).distinct()


def lev_matrix(kmer_rows: DataFrame, kmer: str = "kmer") -> DataFrame:
    """(k1, k2, lev): all pairs k1 < k2. The result itself grows with the square: for small sets."""
    a, b = kmer_rows.select(F.col(kmer).alias("k1")), kmer_rows.select(F.col(kmer).alias("k2"))
    return a.join(b, F.col("k1") < F.col("k2")).withColumn("lev", edits("k1", "k2"))


def lev_within(kmer_rows: DataFrame, k: int, bound: int, kmer: str = "kmer") -> DataFrame:
    """(k1, k2, lev): the pairs k1 < k2 within bound edits, none missed and not all compared.

    Of bound + 1 segments of a k-mer one is unchanged in any k-mer within bound edits, shifted by
    at most bound: the pairs that share such a segment meet in a join on it.
    """
    parts = bound + 1
    size = k // parts
    if size < 1:
        raise ValueError("more edits than segments of a base")
    a = kmer_rows.select(F.col(kmer).alias("k1"), F.explode(F.array(*[F.struct(F.lit(i * size).alias("at"), F.substring(kmer, i * size + 1, size).alias("part")) for i in range(parts)])).alias("s")).select("k1", "s.at", "s.part")
    shifts = [F.struct(F.lit(i * size).alias("at"), F.substring(kmer, i * size + m + 1, size).alias("part")) for i in range(parts) for m in range(-bound, bound + 1) if 0 <= i * size + m <= k - size]
    b = kmer_rows.select(F.col(kmer).alias("k2"), F.explode(F.array(*shifts)).alias("s")).select("k2", "s.at", "s.part")
    pairs = a.join(b, ["at", "part"]).where("k1 <> k2").select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct()
    return pairs.withColumn("lev", bounded_edits("k1", "k2", bound)).where(F.col("lev").isNotNull())


def implicit_matrix(points: DataFrame, radius: float, dims: int = 2, dealt: bool = False) -> DataFrame:
    """(k1, k2, dist): edit distances of the pairs of k-mers (kmer, v) whose vectors are within radius; dims: of the cells at radius 0, where equal vectors meet.
    dealt: as in ``block_self_join``."""
    near = block_self_join(points, radius, "kmer", "v", dealt=dealt) if radius > 0 else ball_self_join(points, radius, "kmer", "v", dims)
    return near.select(F.col("kmer_1").alias("k1"), F.col("kmer_2").alias("k2"), edits("kmer_1", "kmer_2").alias("dist"))


def calibration(kmer_rows: DataFrame, vector: Column, kmer: str = "kmer") -> DataFrame:
    """(k1, k2, f_lev, rc_lev, lev, ram): all pairs of a small set, with both strands' distances and the L1 distance of their vectors."""
    from ..functions.distance import l1
    from ..functions.sequence import reverse_complement

    rows = kmer_rows.select(F.col(kmer), vector.alias("__v"))
    a, b = rows.toDF("k1", "__a"), rows.toDF("k2", "__b")
    pairs = a.join(b, F.col("k1") < F.col("k2"))
    return pairs.select("k1", "k2", edits("k1", "k2").alias("f_lev"), edits("k1", reverse_complement("k2")).alias("rc_lev"), strand_edits("k1", "k2").alias("lev"), l1("__a", "__b").alias("ram"))


def distance_table(queries: DataFrame, targets: DataFrame, sub_ks: tuple[int, ...], vectors: dict[str, tuple[str, str]] = {}) -> DataFrame:  # noqa: B006
    """(query, target, needle, subk_*, *_euc, *_manhattan): a stated set of queries against all targets; vectors: name to (column of the query, of the target)."""
    from ..functions.distance import containment, l1, l2

    rows = targets.join(small(queries))
    extra = [f(q, t).alias(f"{n}_{kind}") for n, (q, t) in vectors.items() for kind, f in (("euc", l2), ("manhattan", l1))]
    return rows.select("query", "target", edits("query", "target").alias("needle"), *[containment("query", "target", q).alias(f"subk_{q}") for q in sub_ks], *extra)
