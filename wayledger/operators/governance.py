"""Permissions, stated purpose and the access log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.plates import lookup

LOG_SCHEMA = (
    "query_id string, at timestamp, actor string, role string, action string, target string,"
    " reason string, result string, n_records bigint, client_ip string"
)


class PermissionDenied(Exception):
    """The role may not perform the action."""


class ReasonRequired(Exception):
    """The action needs a stated purpose."""


@dataclass(frozen=True)
class Principal:
    username: str
    role: str
    client_ip: str = ""


def authorise(principal: Principal, action: str, reason: str | None) -> str:
    """Validated reason. Permission is tested before purpose."""
    if principal.role not in R.PERMISSIONS.get(action, ()):
        raise PermissionDenied(f"role {principal.role!r} may not perform {action!r}")
    stated = (reason or "").strip()
    if action in R.REASON_REQUIRED and len(stated) < R.MIN_REASON_LENGTH:
        raise ReasonRequired(f"{action!r} requires a stated reason of at least {R.MIN_REASON_LENGTH} characters")
    return stated or "not required for this action"


def log_row(
    spark: SparkSession, query_id: str, principal: Principal, action: str, target: str, reason: str,
    result: str = "started", n_records: int | None = None,
) -> DataFrame:
    """One access-log row; ``target`` is cut to 256 characters."""
    row = [(query_id, principal.username, principal.role, action, target[:256], reason, result, n_records, principal.client_ip)]
    schema = (
        "query_id string, actor string, role string, action string, target string, reason string,"
        " result string, n_records bigint, client_ip string"
    )
    stamped = spark.createDataFrame(row, schema).withColumn("at", F.current_timestamp())
    return stamped.select(*[c.split()[0] for c in LOG_SCHEMA.split(", ")])


def folded_log(log: DataFrame) -> DataFrame:
    """One row per query: its first row with the latest result and record count."""
    first = F.struct("actor", "role", "action", "target", "reason")
    step = F.struct("at", F.when(F.col("result") == "started", 0).otherwise(1).alias("done"))
    return log.groupBy("query_id").agg(
        F.min("at").alias("at"), F.min_by(first, step).alias("f"),
        F.max_by(F.struct("result", "n_records"), step).alias("l"),
    ).select("query_id", "at", "f.*", "l.*")


def unfinished(log: DataFrame) -> DataFrame:
    """Queries that never completed."""
    return folded_log(log).filter("result = 'started'")


def compliance(log: DataFrame) -> DataFrame:
    """Log rows judged against the policy: ``denied`` and ``missing_reason`` flags."""
    roles = lookup(R.PERMISSIONS, F.col("action"))
    allowed = F.coalesce(F.array_contains(roles, F.col("role")), F.lit(False))
    needs = F.col("action").isin(R.REASON_REQUIRED)
    short = F.length(F.regexp_replace(F.coalesce("reason", F.lit("")), r"(?U)^\s+|\s+$", "")) < R.MIN_REASON_LENGTH
    return log.withColumn("denied", ~allowed).withColumn("missing_reason", allowed & needs & short)


def audit_trail(log: DataFrame, actor: str | None = None, since: Column | None = None, limit: int = 500) -> DataFrame:
    """Newest access-log rows; not itself logged, as reviews would log themselves without end."""
    rows = log
    if actor:
        rows = rows.filter(F.col("actor") == actor)
    if since is not None:
        rows = rows.filter(F.col("at") >= since)
    return rows.orderBy(F.col("at").desc(), F.col("query_id").desc()).limit(min(limit, R.MAX_LIMIT))
