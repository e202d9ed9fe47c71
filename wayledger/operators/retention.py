"""Expiry, legal holds and erasure as keep/remove splits.

Tables are files: a sweep writes the kept rows of the touched partitions. Each function
returns DataFrames; nothing is deleted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from .screening import at


def expired(as_of, column: str = "expires_at") -> Column:
    return F.col(column).isNotNull() & (F.col(column) <= at(as_of))


def keep(df: DataFrame, as_of, column: str = "expires_at") -> DataFrame:
    return df.filter(~expired(as_of, column))


def audit_expired(as_of, days: int = R.AUDIT_DAYS) -> Column:
    return F.col("at") <= at(as_of) - F.make_dt_interval(days=F.lit(days))


def sweep(tables: dict[str, DataFrame], as_of, audit_days: int = R.AUDIT_DAYS) -> dict[str, DataFrame]:
    """Kept rows per table; hits and review items go with the reads they point at."""
    out = {name: keep(tables[name], as_of) for name in ("reads", "sessions", "unreadable") if name in tables}
    if "reads" in tables:
        gone = tables["reads"].filter(expired(as_of)).select(F.col("id").alias("read_id"))
        for name in ("hits", "reviews"):
            if name in tables:
                out[name] = tables[name].join(gone, "read_id", "left_anti")
    if "blobs" in tables:
        gone_blobs = removable_blobs(tables["blobs"], tables["reads"], as_of)
        out["blobs"] = tables["blobs"].join(gone_blobs, "sha256", "left_anti")
    if "access_log" in tables:
        out["access_log"] = tables["access_log"].filter(~audit_expired(as_of, audit_days))
    return out


def sweep_counts(tables: dict[str, DataFrame], as_of, audit_days: int = R.AUDIT_DAYS) -> DataFrame:
    """Rows each table would lose. Dependants count rows whose read expires."""
    parts = []

    def add(name: str, removed: DataFrame) -> None:
        parts.append(removed.agg(F.count("*").alias("n_deleted")).select(F.lit(name).alias("table_name"), "n_deleted"))

    for name in ("reads", "sessions", "unreadable"):
        if name in tables:
            add(name, tables[name].filter(expired(as_of)))
    gone = tables["reads"].filter(expired(as_of)).select(F.col("id").alias("read_id"))
    for name in ("hits", "reviews"):
        if name in tables:
            add(name, tables[name].join(gone, "read_id", "left_semi"))
    if "blobs" in tables:
        add("blobs", removable_blobs(tables["blobs"], tables["reads"], as_of))
    if "access_log" in tables:
        add("audit", tables["access_log"].filter(audit_expired(as_of, audit_days)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def image_refs(reads: DataFrame) -> DataFrame:
    """Digests that reads point at, one row each."""
    both = F.array_compact(F.array("plate_image_sha256", "context_image_sha256"))
    return reads.select(F.explode(both).alias("sha256")).distinct()


def removable_blobs(blobs: DataFrame, reads: DataFrame, as_of) -> DataFrame:
    """Expired images no surviving read points at."""
    live = image_refs(reads.filter(F.col("expires_at") > at(as_of)))
    return blobs.filter(expired(as_of)).select("sha256").join(live, "sha256", "left_anti")


def overdue(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """Rows past their deadline but still present; ``healthy`` when none are."""
    parts = [
        df.agg(F.count_if(expired(as_of)).alias("n_overdue")).select(F.lit(name).alias("table_name"), "n_overdue")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("healthy", F.col("n_overdue") == 0)


def with_holds(df: DataFrame, holds: DataFrame) -> DataFrame:
    """Effective expiry under legal holds: a held plate's rows expire when the hold ends."""
    until = holds.groupBy("plate_hmac").agg(F.max("hold_until").alias("_until"))
    joined = df.join(until, "plate_hmac", "left")
    return joined.withColumn("held", F.col("_until").isNotNull()).withColumn(
        "expires_at", F.coalesce("_until", "expires_at")
    ).select(*df.columns, "held")


def hold_for_case(plates: DataFrame, as_of, days: int = 365) -> DataFrame:
    """Hold rows for pseudonyms: ``(plate_hmac, hold_until)``."""
    return plates.select("plate_hmac").distinct().withColumn("hold_until", at(as_of) + F.make_dt_interval(days=F.lit(days)))


def erase(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """Tables without the plates under erasure. The access log is not touched."""
    todo = requests.filter("status <> 'done'").select("plate_hmac").distinct()
    out = {
        name: tables[name].join(todo, "plate_hmac", "left_anti")
        for name in ("reads", "sessions", "anomalies") if name in tables
    }
    gone = tables["reads"].join(todo, "plate_hmac", "left_semi").select(F.col("id").alias("read_id"))
    for name in ("hits", "reviews"):
        if name in tables:
            out[name] = tables[name].join(gone, "read_id", "left_anti")
    return out


def erasure_report(tables: dict[str, DataFrame], requests: DataFrame, as_of) -> DataFrame:
    """Requests with deleted counts; those already done are returned unchanged."""
    todo = requests.filter("status <> 'done'").select("plate_hmac").distinct()

    def counts(name: str, out: str) -> DataFrame:
        hit = tables[name].join(todo, "plate_hmac", "left_semi")
        return hit.groupBy("plate_hmac").agg(F.count("*").alias(out))

    joined = requests.join(counts("reads", "_reads"), "plate_hmac", "left").join(
        counts("sessions", "_sessions"), "plate_hmac", "left"
    )
    zero = F.lit(0).cast("bigint")
    done = F.col("status") == "done"
    return joined.select(
        "request_id", "plate_hmac",
        F.when(done, F.col("reads_deleted")).otherwise(F.coalesce("_reads", zero)).alias("reads_deleted"),
        F.when(done, F.col("sessions_deleted")).otherwise(F.coalesce("_sessions", zero)).alias("sessions_deleted"),
        F.when(done, F.col("executed_at")).otherwise(at(as_of)).alias("executed_at"),
        F.lit("done").alias("status"),
    )


def orphaned_images(reads: DataFrame, requests: DataFrame) -> DataFrame:
    """Digests only erased reads pointed at."""
    todo = requests.filter("status <> 'done'").select("plate_hmac").distinct()
    erased = image_refs(reads.join(todo, "plate_hmac", "left_semi"))
    kept = image_refs(reads.join(todo, "plate_hmac", "left_anti"))
    return erased.join(kept, "sha256", "left_anti")


# Fixed pattern: JSON keys that name a digest, and the digest's shape.
DIGEST_REF = r'"(?:[^"\\]*_)?sha256"\s*:\s*"([0-9a-f]{64})"'


def payload_refs(events: DataFrame) -> DataFrame:
    """Every digest any payload refers to, at any depth."""
    return events.select(
        F.explode(F.regexp_extract_all("payload", F.lit(DIGEST_REF), F.lit(1))).alias("sha256")
    ).distinct()


def prune_events(events: DataFrame, as_of, keep_days: int = 7, keep_unsent: bool = True) -> DataFrame:
    """Events that stay on a node: recent ones, and unsent ones unless told otherwise."""
    old = F.col("queued_at") < at(as_of) - F.make_dt_interval(days=F.lit(keep_days))
    gone = old & F.col("sent_at").isNotNull() if keep_unsent else old
    return events.filter(~gone)


def prune_blobs(blobs: DataFrame, kept_events: DataFrame) -> DataFrame:
    """Blobs some kept event still refers to."""
    return blobs.join(payload_refs(kept_events), "sha256", "left_semi")
