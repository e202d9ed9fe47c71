"""Chain verification that goes on where it stopped: verified stretches of each node's log.

A segment is a stretch of consecutive sequences of a node with what its borders need: the ``prev_hash`` its
first event carries, the link hash its last one asks for, and the first sequence inside that fails. Two
segments that touch make one, and only the link between them is left to check, so each event is hashed
once, when it comes. Segments may be joined in any order: an event that fills a gap late mends it. A node
has one segment more than gaps, however long its log is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..session import materialise
from .chain import with_verdict
from .ordered import with_previous, with_running

SEGMENTS = "node_id string, low bigint, high bigint, n_events bigint, prev_hash string, link_hash string, failed bigint"


def _failure(sequence: Column) -> Column:
    return F.format_string("verification failed at sequence %d", sequence)


def segments_of(events: DataFrame, within: str | None = None) -> DataFrame:
    """Segments of events, each (node_id, sequence) once. Every event is hashed once; events without node or
    sequence belong to no chain and are left out. What is written for that goes to the folder ``within``, if given."""
    seq = F.col("sequence").cast("bigint")
    single = with_verdict(events).filter("node_id is not null and sequence is not null").select(
        "node_id", seq.alias("low"), seq.alias("high"), F.lit(1).cast("bigint").alias("n_events"), "prev_hash", "link_hash",
        F.when(~F.col("verified"), seq).alias("failed"))
    return joined(materialise(single, within, compression="zstd"))


def joined(segments: DataFrame) -> DataFrame:
    """Segments that touch as one, with the link between them checked. Joining again changes nothing."""
    linked = with_previous(segments.select(*[c.split()[0] for c in SEGMENTS.split(", ")]), ["node_id"], "low", ["high", "link_hash"])
    follows = F.coalesce(F.col("low") == F.col("prev_high") + 1, F.lit(False))
    torn = F.when(follows & (F.col("prev_hash") != F.col("prev_link_hash")), F.col("low"))
    marked = linked.withColumn("failed", F.least("failed", torn)).withColumn("_opens", F.when(~follows, F.col("low")))
    started = with_running(marked, ["node_id"], "low", F.col("_opens"), "_start")
    return started.groupBy("node_id", F.col("_start").alias("low")).agg(
        F.max("high").alias("high"), F.sum("n_events").alias("n_events"), F.min_by("prev_hash", started["low"]).alias("prev_hash"),
        F.max_by("link_hash", started["low"]).alias("link_hash"), F.min("failed").alias("failed"))


def verdict(segments: DataFrame, start: str | None = R.GENESIS) -> DataFrame:
    """What :func:`.chain.verify_chains` says of all the events that joined ``segments`` were made of."""
    placed = with_previous(segments, ["node_id"], "low", ["high"])
    first = F.col("prev_high").isNull()
    astray = F.lit(False) if start is None else F.coalesce(F.col("prev_hash") != F.lit(start), F.lit(False))
    at = F.when(~first | astray, F.col("low")).otherwise(F.col("failed"))
    gap = F.format_string("sequence gap at %d (expected %d)", "low", F.col("prev_high") + 1)
    reason = F.when(~first, gap).when(at.isNotNull(), _failure(at))
    return placed.withColumn("_at", at).withColumn("reason", reason).groupBy("node_id").agg(
        F.sum("n_events").alias("n_events"), F.min("low").alias("first_sequence"), F.max("high").alias("last_sequence"),
        F.min_by("reason", "_at").alias("reason"),
    ).select("node_id", "n_events", "first_sequence", "last_sequence", F.col("reason").isNull().alias("ok"), "reason")
