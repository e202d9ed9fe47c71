"""Ingest as one job: from delivered batches to reads, hits, reviews and unreadable passages, with stored state.

Every micro-batch admits nodes, sets refused events apart, stores new ones, projects them, and screens
the reads that are new. Node heads, gaps and the runs of stored sequences are kept as state beside the
log, and of each session its first event, its last closing and its latest plate, as parts that each
batch adds to. Superseded reads are a view over the stored rows. All are right however events were
spread over batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.pseudonym import PlateHasher
from ..operators import ingest
from ..operators.screening import screen
from ..sources import events as ev
from . import live, partials

STORED = ("events", "reads", "hits", "reviews", "unreadable", "rejected")


def read_id() -> Column:
    """A read's id: its node and sequence."""
    return F.concat_ws(":", "node_id", F.col("sequence").cast("string"))


SESSIONS = "session_parts"


def _keep_sessions(spark: SparkSession, root: str, new: DataFrame, key: str) -> None:
    """Add what a batch's events say of sessions. A root whose events are older than this table is read once."""
    path = f"{root}/{SESSIONS}"
    if not partials.folders(spark, path):
        before = live.stored_events(spark, f"{root}/events").filter(F.col(live.BATCH) != key)
        partials.add(ingest.session_parts(before), "before", path)
    partials.fold(spark, path, ingest.merged_parts, but=key)
    partials.add(ingest.session_parts(new), key, path)


def start(
    spark: SparkSession, inbox: str, root: str, checkpoint: str, hasher: PlateHasher,
    nodes: DataFrame | None = None, watchlist: DataFrame | None = None, as_of=None, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Drain a folder of event batches into the tables below ``root``.

    Each table has one folder per micro-batch, replaced if the batch is applied again. ``watchlist``
    is screened as it stands at ``as_of``.
    """
    run = live.run_of(spark, checkpoint)

    def apply(batch: DataFrame, number: int) -> None:
        key = f"{run}-{number}"
        live.apply_batch(spark, batch, key, f"{root}/events", f"{root}/rejects", nodes)
        new = spark.read.parquet(f"{root}/events/{live.BATCH}={key}")
        known, unknown = ingest.routed(new)
        live.own_folder(unknown.unionByName(ingest.reads_without_plate(known)), key, f"{root}/rejected")
        live.own_folder(ingest.project_reads(known, hasher, nodes=nodes).withColumn("id", read_id()), key, f"{root}/reads")
        live.own_folder(ingest.unreadable_passages(known), key, f"{root}/unreadable")
        _keep_sessions(spark, root, known, key)
        reads = spark.read.parquet(f"{root}/reads/{live.BATCH}={key}")
        live.own_folder(ingest.review_items(reads), key, f"{root}/reviews")
        if watchlist is not None:
            live.own_folder(screen(reads, watchlist, as_of), key, f"{root}/hits")

    source = ev.read_envelopes(spark, inbox, stream=True, maxFilesPerTrigger=str(files_per_batch))
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tables(spark: SparkSession, root: str, hasher: PlateHasher) -> dict[str, DataFrame]:
    """The stored tables and the views over them by name; tables that hold nothing yet are left out."""
    out = {name: live.stored_events(spark, f"{root}/{name}") for name in STORED}
    have = {name: rows.drop(live.BATCH) for name, rows in out.items() if rows is not None}
    if "events" in have:
        parts = spark.read.schema(ingest.SESSION_PARTS).parquet(f"{root}/{SESSIONS}")
        have["sessions"] = ingest.sessions_of(ingest.merged_parts(parts), hasher)
        have["heads"] = live.known(spark, f"{root}/events")[1]
        have["gaps"] = spark.read.parquet(f"{root}/events/{live.GAPS}").drop(live.BATCH)
    if "reads" in have:
        have["reads"] = ingest.with_superseded(have["reads"])
    return have
