"""Watch-list screening: live matches, entries, back-fill, hit lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.plates import with_canonical
from ..functions.pseudonym import PlateHasher


def at(when: str | datetime | Column) -> Column:
    """The instant results are computed for; replaces every clock read."""
    if isinstance(when, Column):
        return when
    text = when.isoformat(sep=" ") if isinstance(when, datetime) else when
    return F.to_timestamp(F.lit(text))


def screen(reads: DataFrame, watchlist: DataFrame, as_of, actionable_band: str = "high") -> DataFrame:
    """One hit per (verified read, active unexpired entry of the same pseudonym).

    No broadcast hint: Spark broadcasts a list it has measured to be small and otherwise
    shuffles, where AQE splits the partition of a plate that dominates the reads.
    """
    live = watchlist.filter(
        F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > at(as_of)))
    ).select("plate_hmac", F.col("id").alias("watchlist_id"), "category")
    return reads.filter("verified").join(live, "plate_hmac").select(
        F.col("id").alias("read_id"), "watchlist_id", "category", "plate_hmac", "plate_canonical",
        "camera_id", "captured_at", "confidence", "provisional",
        (F.col("confidence") == actionable_band).alias("actionable"),
    )


def add_entries(requests: DataFrame, hasher: PlateHasher) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` watch-list entries: the plate must parse, the reason be given."""
    keyed = with_canonical(requests, "plate", "plate_canonical").withColumn("reason", F.trim("reason"))
    error = F.when(F.col("plate_canonical").isNull(), "not a valid Nepali plate").when(
        F.coalesce("reason", F.lit("")) == "", "a watch-list entry requires a reason"
    )
    judged = keyed.withColumn("error", error)
    accepted = judged.filter("error is null").drop("error", "plate").withColumn(
        "plate_hmac", hasher.hash(F.col("plate_canonical"))
    ).withColumn("active", F.lit(True))
    return accepted, judged.filter("error is not null").drop("plate_canonical")


def backfill(reads: DataFrame, entries: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Past reads of new entries: verified, final, informational only."""
    recent = reads.filter(
        (F.col("captured_at") >= at(as_of) - F.make_dt_interval(days=F.lit(days)))
        & F.col("verified") & ~F.col("provisional")
    )
    keys = entries.select("plate_hmac", F.col("id").alias("watchlist_id"), "category")
    return recent.join(keys, "plate_hmac").select(
        F.col("id").alias("read_id"), "watchlist_id", "category", "plate_canonical", "captured_at",
        "confidence", F.lit(False).alias("actionable"),
    )


def acknowledged(hits: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Latest acknowledgement of each hit joined on, unacknowledged hits keep nulls."""
    last = acknowledgements.groupBy("hit_id").agg(
        F.max_by("actor", "at").alias("acknowledged_by"), F.max("at").alias("acknowledged_at")
    )
    return hits.join(last, hits["id"] == last["hit_id"], "left").drop("hit_id")


def hit_list(
    hits: DataFrame, reads: DataFrame, watchlist: DataFrame, unacknowledged_only: bool = True, limit: int = 500
) -> DataFrame:
    """Newest hits with their read and entry. The page is cut before the joins.

    A page never exceeds ``MAX_LIMIT`` rows, whatever is asked.
    """
    page = hits.filter("acknowledged_at is null") if unacknowledged_only else hits
    top = page.orderBy(F.col("matched_at").desc(), F.col("id").desc()).limit(min(limit, R.MAX_LIMIT))
    # At most ``MAX_LIMIT`` rows: a proven bound, so the page is the broadcast side.
    r = reads.select(F.col("id").alias("read_id"), "plate_canonical", "camera_id", "captured_at")
    w = watchlist.select(F.col("id").alias("watchlist_id"), "category")
    found_reads = r.join(F.broadcast(top.select("read_id").distinct()), "read_id", "left_semi")
    found_entries = w.join(F.broadcast(top.select("watchlist_id").distinct()), "watchlist_id", "left_semi")
    return top.join(found_reads, "read_id", "left").join(found_entries, "watchlist_id", "left").select(
        "id", "matched_at", "confidence", "actionable", F.col("plate_canonical").alias("plate"),
        "camera_id", "captured_at", "category",
    )


def active_entries(watchlist: DataFrame, limit: int = 500) -> DataFrame:
    return watchlist.filter("active").orderBy(F.col("added_at").desc(), F.col("id").desc()).limit(min(limit, R.MAX_LIMIT))
