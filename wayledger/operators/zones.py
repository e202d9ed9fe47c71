"""Zone membership, debounced entry and exit, sessions.

Frames of a camera carry consecutive ``frame_index`` values: a track is absent from a frame
exactly when that index is missing from its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import in_polygon, reference_x, reference_y
from ..session import materialise
from .ordered import BLOCK, with_halo, with_running

KEYS = ["camera_id", "track_id", "zone_id"]


def memberships(frames: DataFrame, zones: DataFrame) -> DataFrame:
    """Is each box's road contact point inside each zone of its camera.

    An equi-join on the camera; zones per camera are few and configured by hand.
    """
    z = zones.select("camera_id", "zone_id", "polygon", "max_dwell_seconds", "enter_frames", "exit_frames")
    rows = frames.select("camera_id", "track_id", "frame_index", "ts", "box").join(z, "camera_id")
    inside = in_polygon(reference_x(F.col("box")), reference_y(F.col("box")), F.col("polygon"))
    return rows.withColumn("inside", inside).drop("polygon", "box")


def longest_threshold(zones: DataFrame) -> int:
    """The most frames any zone wants to see in a row; ``zones`` may be the zones or rows joined with them."""
    return zones.agg(F.max(F.greatest("enter_frames", "exit_frames"))).first()[0] or 1


def transitions(
    members: DataFrame, zones: DataFrame | None = None, block: int = BLOCK, lost_grace_frames: int = 0, idle_seconds: float | None = None,
) -> DataFrame:
    """Entry, exit and loss events per (camera, track, zone).

    A latch turns on after ``enter_frames`` consecutive frames inside and off after
    ``exit_frames`` outside; a missing frame ends the presence and resets it, and so does a pause
    longer than ``idle_seconds`` where that is given. Rows are cut in blocks of frames with a halo
    as wide as the longest threshold of ``zones``, whatever it is, so a very long track is spread
    over many tasks; the latch is carried over block borders by one row per block. Signals are
    written once, so that the frames behind them are read once.
    """
    # A frame's run is as long as asked for if as many rows before it, each within the grace, agree.
    reach = longest_threshold(members if zones is None else zones) * (1 + lost_grace_frames)
    near = with_halo(members, "frame_index", before=reach, after=1 + lost_grace_frames, size=block)
    w = W.partitionBy(*KEYS, "_block").orderBy("frame_index")
    step = 1 + lost_grace_frames
    lagged = near.select(
        "*", F.lag("frame_index").over(w).alias("_pf"), F.lag("ts").over(w).alias("_pt"), F.lead("ts").over(w).alias("_nt"), F.lag("inside").over(w).alias("_pi"),
        F.lead("frame_index").over(w).alias("_nf"), F.row_number().over(w).alias("_n"),
    )
    paused = lambda a, b: F.lit(False) if idle_seconds is None else (
        F.unix_micros(b) - F.unix_micros(a) > int(idle_seconds * 1_000_000))
    starts = F.col("_pf").isNull() | (F.col("frame_index") - F.col("_pf") > step) | paused("_pt", "ts")
    ends = F.col("_nf").isNull() | (F.col("_nf") - F.col("frame_index") > step) | paused("ts", "_nt")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    run_start = F.last(F.when(starts | (F.col("inside") != F.col("_pi")), F.col("_n")), ignorenulls=True).over(upto)
    runs = lagged.select("*", starts.alias("_starts"), ends.alias("_ends"), (F.col("_n") - run_start + 1).alias("_len")).filter("_core")
    signal = (
        F.when(F.col("inside") & (F.col("_len") >= F.col("enter_frames")), True)
        .when(~F.col("inside") & (F.col("_len") >= F.col("exit_frames")), False)
        .when(F.col("_starts"), False)
    )
    signalled = materialise(runs.select(
        *KEYS, "_block", "frame_index", "ts", "max_dwell_seconds", "_starts", "_ends", signal.alias("_signal")))
    summary = signalled.groupBy(*KEYS, "_block").agg(
        F.max_by("_signal", F.when(F.col("_signal").isNotNull(), F.col("frame_index"))).alias("_last")
    )
    carry = summary.select(*KEYS, "_block", F.last("_last", ignorenulls=True).over(
        W.partitionBy(*KEYS).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ).alias("_carry"))
    known = signalled.select(
        "*", F.last("_signal", ignorenulls=True).over(upto).alias("_now"),
        F.last("_signal", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_was"),
    ).join(carry, [*KEYS, "_block"], "left")
    rows = known.withColumn("_latch", F.coalesce("_now", "_carry", F.lit(False))).withColumn(
        "_before", F.when(F.col("_starts"), False).otherwise(F.coalesce("_was", "_carry", F.lit(False)))
    )
    kinds = F.array_compact(F.array(
        F.when(F.col("_latch") & ~F.col("_before"), F.struct(F.lit("entry").alias("kind"), F.col("frame_index").alias("at_frame"))),
        F.when(~F.col("_latch") & F.col("_before"), F.struct(F.lit("exit").alias("kind"), F.col("frame_index").alias("at_frame"))),
        F.when(F.col("_latch") & F.col("_ends"), F.struct(F.lit("lost").alias("kind"), (F.col("frame_index") + step).alias("at_frame"))),
    ))
    return rows.select(
        *KEYS, "ts", "frame_index", "max_dwell_seconds", F.explode(kinds).alias("e")
    ).select(*KEYS, "e.kind", "e.at_frame", F.when(F.col("e.kind") != "lost", F.col("ts")).alias("at"), "max_dwell_seconds")


def sessions(frames: DataFrame, zones: DataFrame, **options) -> DataFrame:
    """Zone sessions with entry, end, reason and dwell; open sessions have no end.

    A session longer than the zone's maximum ends as ``timed_out`` at the first camera frame
    past it; it is not reopened while the track stays inside.
    """
    # Transitions are a small part of the frames: written once, so that no later step runs over
    # the frames again.
    events = materialise(transitions(memberships(frames, zones), zones, **options))
    camera_frames = frames.groupBy("camera_id", "frame_index").agg(F.min("ts").alias("frame_ts"))
    # A loss is dated by the camera's frame after the last one; without such a frame the session is open.
    dated = events.join(camera_frames.withColumnRenamed("frame_index", "at_frame"), ["camera_id", "at_frame"], "left").filter(
        "kind <> 'lost' or frame_ts is not null")
    line = dated.withColumn("at", F.coalesce("at", "frame_ts"))
    # Events of one key alternate and are few; frames were reduced to them block by block.
    w = W.partitionBy(*KEYS).orderBy("at_frame", F.when(F.col("kind") == "entry", 1).otherwise(0))
    paired = line.withColumn("_end", F.lead(F.struct("kind", "at_frame", "at")).over(w)).filter("kind = 'entry'")
    opened = paired.select(
        *KEYS, F.col("at_frame").alias("entry_frame"), F.col("at").alias("entered_at"), "max_dwell_seconds",
        F.col("_end.at_frame").alias("end_frame"), F.col("_end.at").alias("end_at"),
        F.when(F.col("_end.kind") == "exit", "exited").when(F.col("_end.kind") == "lost", "track_lost").alias("end_reason"),
    )
    full = _with_timeouts(opened, camera_frames)
    timed = F.col("timeout_frame").isNotNull()
    exited_at = F.when(timed, F.col("timeout_at")).otherwise(F.col("end_at"))
    dwell = F.greatest(F.lit(0.0), (F.unix_micros(exited_at) - F.unix_micros("entered_at")) / F.lit(1_000_000.0))
    return full.select(
        *KEYS, "entry_frame", "entered_at",
        F.when(timed, F.col("timeout_frame")).otherwise(F.col("end_frame")).alias("exit_frame"),
        exited_at.alias("exited_at"),
        F.when(timed, "timed_out").otherwise(F.col("end_reason")).alias("close_reason"),
        F.round(F.when(exited_at.isNotNull(), dwell), 3).alias("dwell_seconds"),
    )


def _with_timeouts(opened: DataFrame, camera_frames: DataFrame) -> DataFrame:
    """Add the first camera frame past the dwell limit and before the session's own end.

    A forward as-of lookup: sessions stand at their deadline on one line with the camera's
    frames, and the next frame after each deadline is a running minimum from the far end.
    """
    deadline = F.unix_micros("entered_at") + (F.col("max_dwell_seconds") * 1_000_000).cast("bigint")
    tick = "struct<pos:bigint,frame:bigint,ts:timestamp>"
    asks = opened.select(
        "camera_id", (deadline * 2 + 1).alias("pos"), F.struct(*opened.columns).alias("ask"), F.lit(None).cast(tick).alias("tick")
    )
    ticks = camera_frames.select(
        "camera_id", (F.unix_micros("frame_ts") * 2).alias("pos"), F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"),
        F.struct(
            (F.unix_micros("frame_ts") * 2).alias("pos"), F.col("frame_index").cast("bigint").alias("frame"), F.col("frame_ts").alias("ts"),
        ).alias("tick"),
    )
    hour = F.floor(F.col("pos") / F.lit(2 * 3_600_000_000)).cast("bigint")
    answered = with_running(
        ticks.unionByName(asks), ["camera_id"], "pos", F.col("tick"), "next", func=F.min, forward=False, block=hour
    ).filter("ask is not null")
    before_end = F.col("ask.end_frame").isNull() | (F.col("next.frame") < F.col("ask.end_frame"))
    return answered.select(
        "ask.*", F.when(before_end, F.col("next.frame")).alias("timeout_frame"), F.when(before_end, F.col("next.ts")).alias("timeout_at"),
    )


def attach_plates(session_rows: DataFrame, plates: DataFrame) -> DataFrame:
    """Plate of the track on each of its sessions; unread vehicles keep a null."""
    return session_rows.join(plates.select("camera_id", "track_id", "plate"), ["camera_id", "track_id"], "left")
