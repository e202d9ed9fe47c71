"""Content-addressed images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import refdata as R
from .screening import at


def checked(uploads: DataFrame, as_of, stored: DataFrame | None = None, days: int = R.IMAGES_DAYS) -> tuple[DataFrame, DataFrame]:
    """``(new blobs, rejected)``: the claimed digest must equal the content's, stored once."""
    raw = uploads.withColumn("content", F.unbase64("data")).withColumn("actual", F.sha2("content", 256))
    good = raw.filter(F.col("actual") == F.col("sha256"))
    w = W.partitionBy("sha256").orderBy("content_type")
    once = good.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    if stored is not None:
        once = once.join(stored.select("sha256"), "sha256", "left_anti")
    new = once.select(
        "sha256", "content_type", F.octet_length("content").cast("bigint").alias("bytes"), "content",
        (at(as_of) + F.make_dt_interval(days=F.lit(days))).alias("expires_at"),
    )
    bad = raw.filter(F.col("actual") != F.col("sha256")).select(
        "sha256", "actual",
        F.concat(F.lit("blob digest mismatch: claimed "), F.substring("sha256", 1, 12), F.lit("..., actual "),
                 F.substring("actual", 1, 12), F.lit("...")).alias("error"),
    )
    return new, bad


def have(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.select("sha256").distinct().join(stored.select("sha256"), "sha256", "left_semi")


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.select("sha256").distinct().join(stored.select("sha256"), "sha256", "left_anti")


def addressed(contents: DataFrame, content: str = "content") -> DataFrame:
    """Distinct contents with reference counts. Digests are made before the shuffle and
    counted on both sides of it, so a content copied millions of times moves as counts."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    size = F.octet_length(content).cast("bigint")
    return contents.select(digest.alias("sha256"), size.alias("bytes")).groupBy("sha256").agg(
        F.count("*").alias("refs"), F.first("bytes").alias("bytes")
    )


def stored_bytes(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count("*").alias("n_blobs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("blob_bytes"))
