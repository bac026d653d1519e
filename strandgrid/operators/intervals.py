"""Interval operators: gaps and islands over ordered positions.

Each one starts a new interval where the row before it is too far, numbers the intervals by a running sum,
and aggregates. The end of an interval is that of its last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import BLOCK, with_blocks


def islands(rows: DataFrame, by: list[str], order: list[Column | str], starts_new: Column, out: str = "island") -> DataFrame:
    """Number the runs of rows: starts_new may use lag over ``before(by, order)``."""
    w = before(by, order)
    flagged = rows.withColumn("__new", F.coalesce(starts_new.cast("int"), F.lit(1)))
    return flagged.withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def before(by: list[str], order: list[Column | str]):
    return Window.partitionBy(*by).orderBy(*order)


def sections(windows: DataFrame, k: int, contig: str = "contig_id", pos: str = "pos", cell: str = "cell") -> DataFrame:
    """(contig, cell, start_coord, end_coord): neighbouring windows of a contig in the same cell, from the first start to the last end."""
    w = before([contig], [pos])
    runs = islands(windows, [contig], [pos], F.col(cell) != F.lag(cell).over(w))
    return runs.groupBy(contig, "island").agg(F.first(cell).alias(cell), F.min(pos).alias("start_coord"), (F.max(pos) + k).alias("end_coord")).drop("island")


def sections_of(contigs: DataFrame, k: int, cell_of, contig: str = "contig_id", seq: str = "seq", cell: str = "cell") -> DataFrame:
    """The same from whole sequences: cell_of is a function of a window's column that gives its cell.

    Runs are found inside blocks of a sequence first, each row by itself; only the runs,
    not the windows, are shuffled, to join those that go on in the next block.
    """
    rows = with_blocks(contigs.select(contig, seq), k, seq)
    n = F.least(F.lit(BLOCK), F.col("__n") - k + 1 - F.col("__at"))
    rows = rows.where(n > 0).withColumn("__c", F.transform(F.sequence(F.lit(0), n - 1), lambda i: cell_of(F.substring("__part", i + 1, F.lit(k)))))
    starts = F.filter(F.sequence(F.lit(0), F.size("__c") - 1), lambda i: (i == 0) | (F.get("__c", i) != F.get("__c", i - 1)))
    rows = rows.withColumn("__f", starts)
    run = F.posexplode(F.transform("__f", lambda i, j: F.struct(i.alias("s"), (F.coalesce(F.get("__f", j + 1), F.size("__c")) - 1).alias("e"), F.get("__c", i).alias("c")))).alias("__j", "__r")
    runs = rows.select(contig, "__at", run).select(contig, (F.col("__at") + F.col("__r.s")).alias("start_coord"), (F.col("__at") + F.col("__r.e") + k).alias("end_coord"), F.col("__r.c").alias(cell))
    w = before([contig], ["start_coord"])
    joined = islands(runs, [contig], ["start_coord"], F.col(cell) != F.lag(cell).over(w))
    return joined.groupBy(contig, "island").agg(F.first(cell).alias(cell), F.min("start_coord").alias("start_coord"), F.max("end_coord").alias("end_coord")).drop("island")


def merge_ranges(rows: DataFrame, by: list[str], k: int, start: str = "q_start", end: str = "q_end") -> DataFrame:
    """Ranges of each group joined where one starts at most k after the end of the one before it."""
    w = before(by, [start, end])
    runs = islands(rows, by, [start, end], F.col(start) > F.lag(end).over(w) + k)
    last = F.max(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))
    return runs.groupBy(*by, "island").agg(F.min(start).alias(start), last["e"].alias(end)).drop("island")


def condense(rows: DataFrame, by: list[str], slosh: int, cap: int = 0) -> DataFrame:
    """Matches (q_start, q_end, t_start, t_end) of each group in order of (q_start, t_start), joined where both starts are at most
    slosh after the ends before them. cap: only the first so many matches of a group."""
    order = ["q_start", "t_start", "q_end", "t_end"]
    w = before(by, order)
    if cap:
        rows = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")
    new = ~((F.col("q_start") <= F.lag("q_end").over(w) + slosh) & (F.col("t_start") <= F.lag("t_end").over(w) + slosh))
    runs = islands(rows, by, order, new)
    key = F.struct(*order)
    first, last = F.min(key), F.max(key)
    return runs.groupBy(*by, "island").agg(first["q_start"].alias("q_start"), last["q_end"].alias("q_end"), first["t_start"].alias("t_start"), last["t_end"].alias("t_end")).drop("island")


def slop(start: Column | str, end: Column | str, k: int, length: Column | str | None = None) -> tuple[Column, Column]:
    """A range made k longer on either side, from 0 on and, where a length is given, up to it."""
    s, e = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    e = e + k
    if length is not None:
        e = F.least(e, F.col(length) if isinstance(length, str) else length)
    return F.greatest(s - k, F.lit(0)), e


def blocks(contigs: DataFrame, block: int = 10_000, contig: str = "contig_id", seq: str = "seq") -> DataFrame:
    """(contig, contig_start, block_seq): pieces of whole sequences, in one pass over each."""
    parts = F.posexplode(F.regexp_extract_all(F.col(seq), F.lit("(?s).{1,%d}" % block), F.lit(0))).alias("__i", "block_seq")
    return contigs.select(contig, parts).select(contig, (F.col("__i") * block).alias("contig_start"), "block_seq")


def sequence_range(seq: Column | str, start: Column | str, end: Column | str) -> Column:
    """seq[start:end], both clipped to the sequence."""
    q, s, e = (F.col(x) if isinstance(x, str) else x for x in (seq, start, end))
    s = F.greatest(s, F.lit(0))
    return F.substring(q, (s + 1).cast("int"), F.greatest(F.least(e, F.length(q)) - s, F.lit(0)).cast("int"))


def pad_seeds(start: Column | str, end: Column | str, gap: int) -> tuple[Column, Column]:
    """A seed interval made longer by the smaller of a quarter of its length and gap, on either side."""
    s, e = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    by = F.least(F.floor((e - s) / 4), F.lit(gap))
    return F.greatest(s - by, F.lit(0)), e + by
