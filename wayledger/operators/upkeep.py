"""Retention carried out: sweeps, legal holds and erasures on stored tables.

``retention`` says what must go or stay; here tables lie in folders of one root, by month, and files
are rewritten. Everything that must go is written down before the first deletion, so that the rows
of one table still tell what must go from the next.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import refdata as R
from ..session import file_system, materialise
from ..sources import rewrite
from . import retention

#: The time of each stored table by which its rows are laid out.
TIMES = {"reads": "captured_at", "sessions": "entered_at", "unreadable": "captured_at", "hits": "matched_at", "reviews": "queued_at",
         "anomalies": "detected_at", "blobs": "expires_at", "access_log": "at"}
MONTH = ["month"]


def store(tables: dict[str, DataFrame], root: str, mode: str = "append") -> None:
    """Write tables below ``root``, by month in files of even size; rows without a time go under the month ``none``."""
    for name, rows in tables.items():
        time = TIMES.get(name)
        month = F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("none")) if time in rows.columns else F.lit("none")
        dated = rows.withColumn("month", month)
        dated.hint("rebalance", F.col("month")).write.mode(mode).partitionBy("month").parquet(f"{root}/{name}")
        # Columns are kept beside the rows: a table that has lost all of them is still a table.
        rows.sparkSession.createDataFrame([(dated.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{root}/{name}/_columns")


def _schema(spark: SparkSession, root: str, name: str) -> StructType:
    return StructType.fromJson(json.loads(spark.read.text(f"{root}/{name}/_columns").first()[0]))


def stored(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stored tables by name, without their month."""
    system, _ = file_system(spark, root)
    have = [n for n in TIMES if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_columns"))]
    return {n: spark.read.schema(_schema(spark, root, n)).parquet(f"{root}/{n}").drop("month") for n in have}


def _remove(spark: SparkSession, root: str, gone: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, int]:
    """Delete by key, dependants before what they point at; returns the files rewritten per table."""
    noted = {name: (materialise(keys.select(*on).distinct()), on) for name, (keys, on) in gone.items()}
    return {name: rewrite.remove(spark, f"{root}/{name}", keys, on, MONTH, _schema(spark, root, name)) for name, (keys, on) in noted.items()}


def apply_sweep(spark: SparkSession, root: str, as_of, audit_days: int = R.AUDIT_DAYS) -> dict[str, int]:
    """Delete what has expired, with what points at it; returns the files rewritten per table."""
    t = stored(spark, root)
    gone: dict[str, tuple[DataFrame, list[str]]] = {}
    if "reads" in t:
        reads = t["reads"].filter(retention.expired(as_of))
        for name in ("hits", "reviews"):
            if name in t:
                gone[name] = (reads.select(F.col("id").alias("read_id")), ["read_id"])
        if "blobs" in t:
            gone["blobs"] = (retention.removable_blobs(t["blobs"], t["reads"], as_of), ["sha256"])
        gone["reads"] = (reads, ["id"])
    rewritten = _remove(spark, root, gone)
    for name in ("sessions", "unreadable", "access_log"):
        if name in t:
            over = retention.audit_expired(as_of, audit_days) if name == "access_log" else retention.expired(as_of)
            over = F.coalesce(over, F.lit(False))
            rewritten[name] = rewrite.change(spark, f"{root}/{name}", lambda x, o=over: x.filter(o), lambda x, o=over: x.filter(~o), MONTH, _schema(spark, root, name))
    return rewritten


def apply_holds(spark: SparkSession, root: str, holds: DataFrame) -> dict[str, int]:
    """Write the effective expiry of held plates into reads and sessions, so that sweeps pass them by."""
    plates = holds.select("plate_hmac").distinct()
    out = {}
    for name in ("reads", "sessions"):
        if name in stored(spark, root):
            out[name] = rewrite.change(
                spark, f"{root}/{name}", lambda x: x.join(plates, "plate_hmac", "left_semi"),
                lambda x: retention.with_holds(x, holds).select(x.columns), MONTH, _schema(spark, root, name))
    return out


def apply_erasure(spark: SparkSession, root: str, requests: DataFrame, as_of) -> DataFrame:
    """Delete all rows of the plates under erasure; returns the requests as done, with counts.

    Images that only erased reads pointed at go too. The access log is not touched.
    """
    t = stored(spark, root)
    report = materialise(retention.erasure_report(t, requests, as_of))
    plates = requests.filter("status <> 'done'").select("plate_hmac").distinct()
    reads = t["reads"].join(plates, "plate_hmac", "left_semi")
    gone: dict[str, tuple[DataFrame, list[str]]] = {
        name: (reads.select(F.col("id").alias("read_id")), ["read_id"]) for name in ("hits", "reviews") if name in t}
    if "blobs" in t:
        gone["blobs"] = (retention.orphaned_images(t["reads"], requests), ["sha256"])
    gone |= {name: (plates, ["plate_hmac"]) for name in ("sessions", "anomalies", "reads") if name in t}
    _remove(spark, root, gone)
    return report
