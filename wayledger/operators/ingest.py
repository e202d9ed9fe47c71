"""Event log to tables: dedup, routing, reads, review items, sessions, receipts.

``events`` is append-only and the only source of truth; every table here is a function of
it, so the same code serves batch and micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.plates import band_rank
from ..functions.pseudonym import PlateHasher
from .ordered import with_running


@dataclass(frozen=True)
class RetentionPolicy:
    """Days each kind of record is kept."""

    reads_days: int = R.READS_DAYS
    sessions_days: int = R.SESSIONS_DAYS
    images_days: int = R.IMAGES_DAYS
    unreadable_days: int = R.UNREADABLE_DAYS
    audit_days: int = R.AUDIT_DAYS


READ_PAYLOAD = (
    "kind string, camera_id string, site_id string, track_id bigint, plate string, plate_display string,"
    " system string, ownership string, size_class string, confidence string, score double, n_frames int,"
    " agreement double, provisional boolean, repaired_fields array<string>, warnings array<string>,"
    " alternatives array<string>, plate_image_sha256 string, context_image_sha256 string,"
    " observed_colour string, observed_vehicle_type string"
)
ZONE_PAYLOAD = (
    "kind string, camera_id string, zone_id string, session_id string, track_id bigint, entered_at string,"
    " exited_at string, dwell_seconds double, close_reason string, plate string"
)
SESSION_PLATE_PAYLOAD = "kind string, camera_id string, plate string, confidence string, sessions array<string>"
UNREADABLE_PAYLOAD = (
    "kind string, camera_id string, site_id string, track_id bigint, n_crops int, best_crop_quality double"
)


def instant(text: Column) -> Column:
    """ISO text (with or without ``Z``) to UTC timestamp; a bad string gives null."""
    return F.try_to_timestamp(text)


def expiry(start: Column, days: int) -> Column:
    return start + F.make_dt_interval(days=F.lit(days))


def first_arrivals(events: DataFrame) -> DataFrame:
    """One event per ``(node_id, sequence)``: the earliest arrival, of equal ones the smallest batch.

    Arrival numbers of different batches may overlap; within a batch they are distinct. The ``row_number`` filter becomes a group limit that already runs before the shuffle,
    so a flood of copies of one event leaves each map task as a single row.
    """
    w = W.partitionBy("node_id", "sequence").orderBy(*(c for c in ("arrival", "batch_id") if c in events.columns))
    return events.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def new_events(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Events to apply: first arrivals that are not stored yet."""
    fresh = first_arrivals(events)
    if stored is None:
        return fresh
    return fresh.join(stored.select("node_id", "sequence"), ["node_id", "sequence"], "left_anti")


def enrol(records: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert node records. Returns ``(nodes, conflicts)``; a different key never overwrites."""
    stored = nodes.select("node_id", F.col("public_key").alias("_stored_key"))
    matched = records.join(stored, "node_id", "left")
    conflicts = matched.filter(F.col("_stored_key") != F.col("public_key")).drop("_stored_key")
    w = W.partitionBy("node_id").orderBy("public_key")
    fresh = (
        matched.filter("_stored_key is null").drop("_stored_key")
        .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    )
    return nodes.unionByName(fresh, allowMissingColumns=True), conflicts


def kind_of(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.kind"), F.lit(""))


def routed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(known, rejected)`` by event kind; rejected rows carry sequence and error."""
    tagged = events.withColumn("kind", kind_of(F.col("payload")))
    known = tagged.filter(F.col("kind").isin(R.EVENT_KINDS))
    rejected = tagged.filter(~F.col("kind").isin(R.EVENT_KINDS)).select(
        "node_id", "sequence", F.concat(F.lit("unknown event kind '"), "kind", F.lit("'")).alias("error")
    )
    return known, rejected


def _payload(events: DataFrame, kinds: Sequence[str], schema: str) -> DataFrame:
    return events.filter(kind_of(F.col("payload")).isin(list(kinds))).withColumn(
        "p", F.from_json("payload", schema)
    )


def project_reads(
    events: DataFrame, hasher: PlateHasher, policy: RetentionPolicy = RetentionPolicy(),
    nodes: DataFrame | None = None,
) -> DataFrame:
    """``plate_read`` events to the reads table. Reads without a plate are left out; see
    :func:`reads_without_plate`. Needs the ``verified`` verdict on the events."""
    reads = _payload(events, ["plate_read"], READ_PAYLOAD).filter(F.coalesce("p.plate", F.lit("")) != "")
    if nodes is not None:
        places = nodes.select(
            "node_id", F.col("camera_id").alias("_cam"), F.col("site_id").alias("_site")
        )
        reads = reads.join(places, "node_id", "left")
    else:
        reads = reads.withColumn("_cam", F.lit(None).cast("string")).withColumn("_site", F.lit(None).cast("string"))
    captured = instant(F.col("captured_at"))
    empty = F.array().cast("array<string>")
    p = F.col("p")
    return reads.select(
        "node_id", "sequence", captured.alias("captured_at"), "received_at",
        expiry(captured, policy.reads_days).alias("expires_at"),
        F.coalesce(p["camera_id"], "_cam", "node_id").alias("camera_id"),
        F.coalesce(p["site_id"], "_site", F.lit("unknown")).alias("site_id"),
        p["track_id"].alias("track_id"),
        hasher.hash(p["plate"]).alias("plate_hmac"),
        p["plate"].alias("plate_canonical"),
        F.coalesce(p["plate_display"], F.lit("")).alias("plate_display"),
        F.coalesce(p["system"], F.lit("unknown")).alias("plate_system"),
        F.coalesce(p["ownership"], F.lit("unknown")).alias("ownership"),
        F.coalesce(p["size_class"], F.lit("unknown")).alias("size_class"),
        F.coalesce(p["confidence"], F.lit("reject")).alias("confidence"),
        F.coalesce(p["score"], F.lit(0.0)).alias("score"),
        F.coalesce(p["n_frames"], F.lit(0)).alias("n_frames"),
        F.coalesce(p["agreement"], F.lit(0.0)).alias("agreement"),
        F.coalesce(p["provisional"], F.lit(False)).alias("provisional"),
        F.coalesce(p["repaired_fields"], empty).alias("repaired_fields"),
        F.coalesce(p["warnings"], empty).alias("warnings"),
        F.coalesce(p["alternatives"], empty).alias("alternatives"),
        p["plate_image_sha256"].alias("plate_image_sha256"),
        p["context_image_sha256"].alias("context_image_sha256"),
        p["observed_colour"].alias("observed_colour"),
        p["observed_vehicle_type"].alias("observed_vehicle_type"),
        "prev_hash", "payload_hash", "signature", "verified",
    )


def reads_without_plate(events: DataFrame) -> DataFrame:
    """Rejected reads."""
    reads = _payload(events, ["plate_read"], READ_PAYLOAD)
    return reads.filter(F.coalesce("p.plate", F.lit("")) == "").select(
        "node_id", "sequence", F.lit("read has no plate").alias("error")
    )


def with_superseded(reads: DataFrame) -> DataFrame:
    """Add ``superseded_by``: for a provisional read, the sequence of the first later final
    read of the same node and track."""
    final = F.when(~F.col("provisional") & F.col("track_id").isNotNull(), F.col("sequence"))
    later = with_running(
        reads, ["node_id", "track_id"], "sequence", final, "_next", func=F.min,
        forward=False, inclusive=False,
    )
    return later.withColumn("superseded_by", F.when(F.col("provisional"), F.col("_next"))).drop("_next")


def review_items(reads: DataFrame, below: str = "high") -> DataFrame:
    """Final reads under the band go to human review, verified or not."""
    limit = R.BANDS.index(below)
    return reads.filter((band_rank(F.col("confidence")) < limit) & ~F.col("provisional")).select(
        "node_id", "sequence", F.col("captured_at").alias("queued_at"),
        F.concat(F.lit("confidence_"), "confidence").alias("reason"),
        F.col("plate_canonical").alias("machine_plate"),
    )


def zone_sessions(
    events: DataFrame, hasher: PlateHasher, policy: RetentionPolicy = RetentionPolicy()
) -> DataFrame:
    """Zone entry and exit events folded to one row per session, plates back-filled.

    The fold does not depend on arrival order. Unverified events are applied too, and
    ``verified`` says whether every event of the session was.
    """
    return sessions_of(session_parts(events), hasher, policy)


#: What is known of a session: its first event, the last that closes it, the last plate of its own and the last filled in.
SESSION_PARTS = (
    "session_id string, o struct<sequence: bigint, node_id: string, zone_id: string, camera_id: string, track_id: bigint, entered: timestamp>,"
    " c struct<sequence: bigint, exited: timestamp, dwell: double, why: string>, own struct<sequence: bigint, plate: string>,"
    " late struct<sequence: bigint, plate: string>, verified boolean"
)


def session_parts(events: DataFrame) -> DataFrame:
    """What the events say of each session: one row of ``SESSION_PARTS`` a session, to be merged by :func:`merged_parts`.

    Plates filled in for a session that no event here opens or closes have a row as well.
    """
    zone = _payload(events, ["zone_entry", "zone_exit"], ZONE_PAYLOAD).filter(
        F.coalesce("p.session_id", F.lit("")) != ""
    )
    p = F.col("p")
    exited, plate = instant(p["exited_at"]), p["plate"]
    entered = F.coalesce(instant(p["entered_at"]), instant(F.col("captured_at")))
    rows = zone.select(
        p["session_id"].alias("session_id"),
        F.struct("sequence", "node_id", p["zone_id"].alias("zone_id"), F.coalesce(p["camera_id"], "node_id").alias("camera_id"),
                 p["track_id"].alias("track_id"), entered.alias("entered")).alias("o"),
        F.when(exited.isNotNull(), F.struct("sequence", exited.alias("exited"), p["dwell_seconds"].alias("dwell"), p["close_reason"].alias("why"))).alias("c"),
        F.when(F.coalesce(plate, F.lit("")) != "", F.struct("sequence", plate.alias("plate"))).alias("own"), "verified",
    )
    late = _payload(events, ["session_plate"], SESSION_PLATE_PAYLOAD).filter(F.coalesce("p.plate", F.lit("")) != "")
    filled = late.select(F.explode("p.sessions").alias("session_id"), F.struct("sequence", F.col("p.plate").alias("plate")).alias("late"))
    return merged_parts(rows.unionByName(filled, allowMissingColumns=True))


def merged_parts(parts: DataFrame) -> DataFrame:
    """Parts of sessions as one row a session. Merging again, in any order and cut, gives the same."""
    return parts.groupBy("session_id").agg(
        F.min("o").alias("o"), F.max("c").alias("c"), F.max("own").alias("own"), F.max("late").alias("late"), F.bool_and("verified").alias("verified"))


def sessions_of(parts: DataFrame, hasher: PlateHasher, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    """Sessions as they are shown, of merged parts; one that has only a plate filled in is not shown yet."""
    plate = F.greatest("own", "late")["plate"]
    entered = F.col("o.entered")
    return parts.filter(F.col("o").isNotNull()).select(
        "session_id", F.coalesce("o.zone_id", F.lit("")).alias("zone_id"), F.col("o.camera_id").alias("camera_id"),
        F.col("o.node_id").alias("node_id"), F.col("o.track_id").alias("track_id"), entered.alias("entered_at"),
        F.col("c.exited").alias("exited_at"), F.col("c.dwell").alias("dwell_seconds"),
        F.col("c.why").alias("close_reason"), hasher.hash(plate).alias("plate_hmac"),
        plate.alias("plate_canonical"), expiry(entered, policy.sessions_days).alias("expires_at"), "verified",
    )


def unreadable_passages(events: DataFrame, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    rows = _payload(events, ["unreadable_passage"], UNREADABLE_PAYLOAD)
    captured = instant(F.col("captured_at"))
    return rows.select(
        "node_id", "sequence", F.coalesce("p.camera_id", "node_id").alias("camera_id"),
        captured.alias("captured_at"), F.coalesce("p.n_crops", F.lit(0)).alias("n_crops"),
        F.coalesce("p.best_crop_quality", F.lit(0.0)).alias("best_crop_quality"),
        expiry(captured, policy.unreadable_days).alias("expires_at"),
    )


def receipt(events: DataFrame, stored: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """One row per delivered event: accepted, duplicate, unverified, gap, error.

    Kept long instead of as lists per batch, so a batch of any size stays distributed.
    Unknown kinds are accepted as well, which stops the node from resending them.
    """
    from .chain import arrival_gaps

    # First copies are found by a group-limited window; all others are duplicates.
    events = events.withColumn("batch_id", F.coalesce("batch_id", F.lit("")))
    firsts = first_arrivals(events.select("node_id", "sequence", "arrival", "batch_id")).withColumn("_first", F.lit(True))
    rows = events.join(firsts, ["node_id", "sequence", "arrival", "batch_id"], "left")
    if stored is not None:
        known = stored.select("node_id", "sequence", F.lit(True).alias("_stored")).distinct()
        rows = rows.join(known, ["node_id", "sequence"], "left")
    else:
        rows = rows.withColumn("_stored", F.lit(None).cast("boolean"))
    gaps = arrival_gaps(events, heads, ties=["batch_id"]).select("node_id", "arrival", "batch_id", "expected", "missing")
    rows = rows.join(gaps, ["node_id", "arrival", "batch_id"], "left")
    duplicate = F.col("_first").isNull() | F.col("_stored").isNotNull()
    kind = kind_of(F.col("payload"))
    plate = F.coalesce(F.get_json_object("payload", "$.plate"), F.lit(""))
    session = F.coalesce(F.get_json_object("payload", "$.session_id"), F.lit(""))
    error = F.when(~duplicate, F.when(
        ~kind.isin(R.EVENT_KINDS), F.concat(F.lit("unknown event kind '"), kind, F.lit("'"))
    ).when((kind == "plate_read") & (plate == ""), "read has no plate").when(
        kind.isin("zone_entry", "zone_exit") & (session == ""), "zone event has no session_id"
    ))
    return rows.select(
        "batch_id", "node_id", "sequence", "arrival", F.lit(True).alias("accepted"),
        duplicate.alias("duplicate"), (~duplicate & ~F.col("verified")).alias("unverified"),
        F.when(~duplicate, F.col("expected")).alias("gap_expected"),
        F.when(~duplicate, F.col("missing")).alias("gap_missing"), error.alias("error"),
    )


def receipt_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("batch_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if("duplicate").alias("duplicates"),
        F.count_if("unverified").alias("unverified"), F.count("error").alias("rejected"),
        F.count("gap_missing").alias("gaps"), F.coalesce(F.sum("gap_missing"), F.lit(0)).alias("missing"),
    )


def pending(events: DataFrame, limit: int = 256) -> DataFrame:
    """Oldest unsent events first, a page per call."""
    return events.filter("sent_at is null").orderBy("sequence").limit(limit)


def backlog(events: DataFrame) -> DataFrame:
    """Delivery state per node: totals, unsent, oldest unsent, payload bytes, attempts."""
    unsent = F.col("sent_at").isNull()
    return events.groupBy("node_id").agg(
        F.count("*").alias("total"), F.count_if(unsent).alias("unsent"),
        F.min_by("captured_at", F.when(unsent, F.col("sequence"))).alias("oldest_unsent"),
        F.sum(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.sum("attempts").alias("attempts"),
    )
