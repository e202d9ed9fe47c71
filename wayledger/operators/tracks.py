"""Tracks: box links, passages, provisional triggers, counters, read payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import iou
from .ordered import block_of, with_halo, with_running


def link_candidates(detections: DataFrame, threshold: float = 0.30, cell: float = 256.0) -> DataFrame:
    """Box pairs of consecutive frames of a camera whose overlap reaches the threshold.

    Boxes meet in grid cells, and a pair counts only in the cell that holds the upper-left
    corner of their intersection: crowded frames do not pair all boxes, and no pair repeats.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive: boxes that do not touch share no cell")

    def cells(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))

    spread = detections.withColumn("cx", F.explode(cells("box.x1", "box.x2"))).withColumn(
        "cy", F.explode(cells("box.y1", "box.y2"))
    )
    prev = spread.select(
        "camera_id", (F.col("frame_index") + 1).alias("frame_index"), "cx", "cy",
        F.col("track_id").alias("prev_track_id"), F.col("box").alias("prev_box"),
    )
    pairs = spread.join(prev, ["camera_id", "frame_index", "cx", "cy"])
    corner_x = F.floor(F.greatest("box.x1", "prev_box.x1") / cell)
    corner_y = F.floor(F.greatest("box.y1", "prev_box.y1") / cell)
    overlap = iou(F.col("box"), F.col("prev_box"))
    return pairs.filter((corner_x == F.col("cx")) & (corner_y == F.col("cy"))).withColumn("iou", overlap).filter(
        F.col("iou") >= threshold
    ).select("camera_id", "frame_index", "prev_track_id", "track_id", "iou")


def with_passage(frames: DataFrame, idle_frames: int = 12) -> DataFrame:
    """Add ``passage_start``: frame that opened the passage. A longer gap opens a new one.

    A row opens a passage when no row of its track lies within the idle limit before it, which
    copies of the rows near a block border decide inside the block.
    """
    keys = ["camera_id", "track_id"]
    near = with_halo(frames, "frame_index", before=idle_frames)
    w = W.partitionBy(*keys, "_block").orderBy("frame_index")
    gap = F.col("frame_index") - F.lag("frame_index").over(w)
    opened = near.withColumn("_gap", gap).filter("_core")
    opens = F.when(F.col("_gap").isNull() | (F.col("_gap") > idle_frames), F.col("frame_index"))
    return with_running(opened, keys, "frame_index", opens, "passage_start").drop("_gap", "_core", "_block")


def passages(frames: DataFrame, idle_frames: int = 12) -> DataFrame:
    """First seen, last seen and frame count per passage."""
    return with_passage(frames, idle_frames).groupBy("camera_id", "track_id", "passage_start").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("frames_seen"),
        F.max("frame_index").alias("last_frame"),
    )


def provisional_triggers(
    frames: DataFrame, idle_frames: int = 12, min_frames: int = 8, min_candidates: int = 3
) -> DataFrame:
    """First frame of each passage with enough frames seen and enough crops taken.

    ``has_crop`` marks frames with a crop. Both counts need only the n-th row of a group,
    found by group-limited windows.
    """
    keys = ["camera_id", "track_id", "passage_start"]
    rows = with_passage(frames, idle_frames)
    w = W.partitionBy(*keys).orderBy("frame_index")

    def nth(df: DataFrame, n: int, name: str) -> DataFrame:
        ranked = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
        return ranked.filter(F.col("_r") == n).select(*keys, F.col("frame_index").alias(name))

    seen = nth(rows, min_frames, "_seen")
    crops = nth(rows.filter("has_crop"), min_candidates, "_crops")
    return seen.join(crops, keys).select(*keys, F.greatest("_seen", "_crops").alias("trigger_frame"))


def directions(frames: DataFrame, trail: int = 64) -> DataFrame:
    """Unit vector of travel from the first to the last box of the trail; null if unmoved.

    The trail counts boxes, so rows are numbered per track before the block border copies.
    """
    keys = ["camera_id", "track_id"]
    numbered = with_row_number(frames, keys, "frame_index")
    near = with_halo(numbered, "_n", before=trail - 1)
    w = W.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-(trail - 1), 0)
    first = F.first("box").over(w)
    ends = near.withColumn("_a", first).filter("_core")
    a, b = F.col("_a"), F.col("box")
    dx = (b["x1"] + b["x2"]) / 2 - (a["x1"] + a["x2"]) / 2
    dy = (b["y1"] + b["y2"]) / 2 - (a["y1"] + a["y2"]) / 2
    moved = ends.withColumn("_dx", dx).withColumn("_dy", dy).withColumn("_len", F.sqrt(dx * dx + dy * dy))
    ok = F.col("_len") > 1e-3
    return moved.select(
        *keys, "frame_index",
        F.when(ok, F.col("_dx") / F.col("_len")).alias("dir_x"), F.when(ok, F.col("_dy") / F.col("_len")).alias("dir_y"),
    )


def with_row_number(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Number rows ``_n`` from 1 along ``order`` within ``keys``, block by block."""
    blocked = df.withColumn("_b", block_of(F.col(order)))
    counts = blocked.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    base = counts.select(*keys, "_b", F.coalesce(
        F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    ).alias("_base"))
    local = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order))
    return blocked.withColumn("_local", local).join(base, [*keys, "_b"], "left").withColumn(
        "_n", F.col("_base") + F.col("_local")
    ).drop("_b", "_local", "_base")


def read_payloads(fused: DataFrame, best_crops: DataFrame, passage: DataFrame) -> DataFrame:
    """Edge read payload per passage: a plate read, or an unreadable passage.

    ``best_crops`` holds ``track_id, n_crops, best_quality, plate_box``; a passage without
    usable crops counts as unreadable with no crops.
    """
    rows = passage.join(fused, "track_id", "left").join(best_crops, "track_id", "left")
    readable = F.col("canonical").isNotNull() & F.col("n_crops").isNotNull()
    return rows.select(
        "camera_id", "track_id", F.when(readable, "plate_read").otherwise("unreadable_passage").alias("kind"),
        F.when(readable, F.col("canonical")).alias("plate"),
        F.when(readable, F.col("confidence")).alias("confidence"),
        F.when(readable, F.round("plate_score", 4)).alias("score"),
        (readable & (F.col("confidence") == "high")).alias("actionable"),
        F.when(readable, F.col("n_frames")).alias("n_frames"),
        F.when(readable, F.round("agreement", 4)).alias("agreement"),
        F.coalesce("n_crops", F.lit(0).cast("bigint")).alias("n_crops"),
        F.round("best_quality", 4).alias("best_crop_quality"),
        F.when(readable, F.struct(*[F.round(F.col("plate_box")[c], 1).alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("plate_box"),
        "first_seen", "last_seen",
    )


def camera_counters(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Per camera: frames, detections, tracks, reads, provisional reads, zone events, unreadable."""
    seen = frames.groupBy("camera_id").agg(
        F.count_distinct("frame_index").alias("frames"), F.count("*").alias("detections"),
        F.count_distinct("track_id").alias("tracks_started"),
    )
    k = F.col("kind")
    done = events.groupBy("camera_id").agg(
        F.count_if((k == "plate_read") & ~F.col("provisional")).alias("reads"),
        F.count_if((k == "plate_read") & F.col("provisional")).alias("provisional"),
        F.count_if(k == "zone_entry").alias("zone_entries"), F.count_if(k == "zone_exit").alias("zone_exits"),
        F.count_if(k == "unreadable_passage").alias("unreadable"),
    )
    counters = [c for c in done.columns if c != "camera_id"]
    return seen.join(done, "camera_id", "left").fillna(0, counters)
