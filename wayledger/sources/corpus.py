"""Corpus index in JSON lines: read, report bad rows, write in shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata as R

SCHEMA = (
    "path string, canonical string, display string, system string, tokens array<string>, colour string,"
    " ownership string, size_class string, two_row boolean, width_px int, height_px int, quality double,"
    " font_authentic boolean, grid_seeded boolean, track_id string, frame bigint, _corrupt_record string"
)
REQUIRED = ["path", "canonical", "system", "tokens", "colour", "two_row", "width_px", "quality"]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    ).json(path)


def is_bad() -> Column:
    """Unparsable row, missing field or unknown colour."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    return F.col("_corrupt_record").isNotNull() | missing | ~F.col("colour").isin(*R.COLOURS, "unknown")


def read_index(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Good rows of an index; ``bad_rows`` tells how many were skipped."""
    good = read_raw(spark, path).filter(~F.coalesce(is_bad(), F.lit(True))).drop("_corrupt_record")
    return good.limit(limit) if limit is not None else good


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = read_raw(spark, path).withColumn("_bad", F.coalesce(is_bad(), F.lit(True)))
    # Every schema column stays referenced: a JSON scan of the corrupt column alone is refused.
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("_bad").alias("n_bad"))


def write_index(corpus: DataFrame, path: str, row_id: str = "i", rows_per_shard: int = 1000) -> None:
    """JSON lines, at most ``rows_per_shard`` rows per shard folder.

    Shard names have five digits, or more where they need more. 1000 rows is the format's own rule;
    a large corpus wants far fewer folders.
    """
    number = F.floor(F.col(row_id) / rows_per_shard).cast("string")
    shard = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    corpus.withColumn("shard", shard).repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)
