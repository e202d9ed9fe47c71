"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word for sizes: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of a frame as one struct ``row``, beside the columns an operator works on.

    Whatever else the frame holds cannot clash with an operator's own names.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[c.alias(name) for name, c in columns.items()])


def crc32_rest(ident: Column, divisor: int) -> Column:
    """Remainder of the checksum of an id written as text; an id that is null counts as remainder 0."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % F.lit(divisor), F.lit(0)).cast("int")


def one_row_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row with all its columns for each (none, id, digest) of ``kept``: whether the id is null, the id or 0, and md5 of the text."""
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = wrapped(docs, none=F.col("doc_id").isNull(), id=F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), digest=digest,
                   # Of repeats that differ in other columns the first in this order stays.
                   rest=F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    same = Window.partitionBy("none", "id", "digest").orderBy("rest")
    return (rows.join(kept, ["none", "id", "digest"], "left_semi")
            .withColumn("place", F.row_number().over(same)).where("place = 1").select("row.*"))
