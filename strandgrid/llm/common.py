"""What the operators of this subpackage share: tables, checkpoints, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and the control characters 0x09 to 0x0D.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WS_BYTES = WS_CHARS.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir). Where that is unset, a temporary one if there is one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='strandgrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of results of ``cut`` that nothing will read again."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.written_to
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: A key with at least this share of all rows is joined by broadcast: there are at most so many.
HOT_SHARE = 2000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n: str, spread: Column) -> DataFrame:
    """Inner join of rows with keyed on key, no key's rows all in one task.

    keyed has one row for each key, and in n how many rows have it; it is read twice, so write it
    first. Keys with 1 / HOT_SHARE of all rows, HOT_SHARE at most, are broadcast, and their
    rows stay where they are or are dealt by ``spread``; the other keys are shuffled.
    """
    total = keyed.agg(F.sum(n).alias("n")).first()["n"] or 0
    hot = F.col(n) * HOT_SHARE >= F.lit(total)
    others = [c for c in keyed.columns if c != key]
    few = keyed.where(hot).select(F.col(key).alias("__hot"), F.struct(*others).alias("__few"))
    many = keyed.where(~hot).select(F.col(key).alias("__many"), F.struct(*others).alias("__found"))
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("__hot"), "left").withColumn("__by", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(spread))
    found = marked.join(many, (F.col("__by") == F.col("__many")) & F.col("__hot").isNull(), "left").withColumn("__found", F.coalesce("__few", "__found")).where("__found IS NOT NULL")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__found.{c}").alias(c) for c in others])


def shielded(docs: DataFrame):
    """docs with all columns but doc_id and text renamed, so that no name of theirs meets one of an operator's, and a
    function that gives a result's first columns their own names again."""
    names = [c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.toDF(*docs.columns, *out.columns[len(names) :])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null, as an array, with built-in functions."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_bytes(raw: bytes) -> bytes:
    """Lower-case A to Z alone, in UTF-8."""
    return raw.translate(_LOWER)
