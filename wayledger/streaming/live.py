"""Structured Streaming forms: ingest, roll-up, passages, zone debounce."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chain, ingest
from ..operators import runs as R
from ..operators.screening import screen
from ..session import file_system, materialise, passing_dir, shuffles_dropped
from ..sources import events as ev
from ..sources import rewrite
from . import partials
from .partials import BATCH


def stored_events(spark: SparkSession, path: str) -> DataFrame | None:
    """The events of a log, null while there are none."""
    system, target = file_system(spark, path)
    if not system.exists(target) or not any(f.getPath().getName().startswith(BATCH) for f in system.listStatus(target)):
        return None
    return spark.read.parquet(path)


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """Name of the run that a checkpoint belongs to, made and kept with it at the first start.

    Batch numbers begin anew with every checkpoint; with the run's name they stay distinct.
    """
    path = f"{checkpoint}/run"
    system, target = file_system(spark, path)
    if not system.exists(target):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def apply_batch(
    spark: SparkSession, batch: DataFrame, batch_key: str, events_path: str, rejects_path: str | None = None,
    nodes: DataFrame | None = None, on_new: Callable[[DataFrame], None] | None = None,
) -> None:
    """Append a batch's new events, and what was refused with its reason.

    Each batch owns one folder of the log and one of the rejects, under ``batch_key``. Applying it
    again after a failure replaces these folders and touches no others, so nothing is stored twice
    and nothing is lost. Copies of stored events are found by the runs of stored sequences, which are
    kept beside the log (:func:`known`): no event that is stored already is read. Which events are new is
    decided on their numbers alone; whole events are shuffled once, and not at all if none is new. The batch is
    read from its source for each of these steps, not kept. ``nodes`` admits events of active nodes only.
    """
    with shuffles_dropped(*{id(s): s for s in (spark, batch.sparkSession)}.values()), passing_dir(spark) as place:
        good, bad = ev.split_wellformed(ev.unpack(batch))
        refused = bad.select("batch_id", "batch_node", "sequence", "error")
        if nodes is not None:
            good, shut = ev.from_active_nodes(good, nodes)
            refused = refused.unionByName(shut.select("batch_id", "batch_node", F.col("sequence").cast("string").alias("sequence"), "error"))
        if rejects_path is not None:
            broken = batch.filter(F.col("_corrupt_record").isNotNull()).select(
                F.col("batch_id"), F.col("node_id").alias("batch_node"), F.lit(None).cast("string").alias("sequence"),
                F.lit("not json").alias("error"))
            own_folder(refused.unionByName(broken), batch_key, rejects_path)
        stored, heads = known(spark, events_path, but=batch_key)
        new = materialise(R.not_held(good.select("node_id", "sequence").distinct(), stored), place)
        first = ingest.new_events(good)
        fresh = first.filter(F.lit(False)) if new.isEmpty() else first.join(new, ["node_id", "sequence"], "left_semi")
        own_folder(chain.with_verdict(fresh).drop("batch_node").sortWithinPartitions("node_id", "sequence"), batch_key, events_path)
        remember(spark, events_path, batch_key, stored, heads)
    if on_new is not None:
        on_new(spark.read.parquet(events_path).filter(F.col(BATCH) == batch_key))


#: Folders inside a log that its readers pass over: what is known of it after each batch, and its gaps.
KNOWN, GAPS = "_known", "_gaps"
#: States of a log that are kept: a batch that is applied again needs the one before it.
STATES_KEPT = 3
HEADS = "node_id string, chain_sequence bigint, chain_head string, last_seen_at timestamp"


def _states(spark: SparkSession, events_path: str) -> list[tuple[int, str, bool]]:
    """(number, batch key, complete) of the stored states, oldest first."""
    system, folder = file_system(spark, f"{events_path}/{KNOWN}")
    found = []
    for status in system.listStatus(folder) if system.exists(folder) else []:
        number, _, key = status.getPath().getName().partition("-")
        done = file_system(spark, f"{events_path}/{KNOWN}/{number}-{key}/heads/_SUCCESS")[1]
        found.append((int(number), key, system.exists(done)))
    return sorted(found)


def known(spark: SparkSession, events_path: str, but: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(runs, heads)`` of a log: the last stored state, for a batch that is applied again the one before it.

    A log without a state, such as one from before states were kept, is read once.
    """
    states = [s for s in _states(spark, events_path) if s[2] and s[1] != but]
    if states:
        path = f"{events_path}/{KNOWN}/{states[-1][0]}-{states[-1][1]}"
        return spark.read.schema(R.RUNS).parquet(f"{path}/runs"), spark.read.schema(HEADS).parquet(f"{path}/heads")
    stored = stored_events(spark, events_path)
    stored = stored.filter(F.col(BATCH) != but) if stored is not None and but is not None else stored
    if stored is None:
        return spark.createDataFrame([], R.RUNS), spark.createDataFrame([], HEADS)
    return R.merged(R.runs_of(stored)), chain.node_heads(stored)


def remember(spark: SparkSession, events_path: str, batch_key: str, runs: DataFrame, heads: DataFrame) -> None:
    """Store the state of a log after a batch, made of the state before and of the batch's own events, and its gaps."""
    new = spark.read.parquet(f"{events_path}/{BATCH}={batch_key}")
    own_folder(chain.arrival_gaps(new, heads, ties=["batch_id"]), batch_key, f"{events_path}/{GAPS}")
    states = _states(spark, events_path)
    number = max([s[0] for s in states if s[1] != batch_key], default=0) + 1
    path = f"{events_path}/{KNOWN}/{number}-{batch_key}"
    R.merged(runs.unionByName(R.runs_of(new))).write.mode("overwrite").parquet(f"{path}/runs")
    R.merged_heads(heads.unionByName(chain.node_heads(new))).write.mode("overwrite").parquet(f"{path}/heads")
    for old, key, _ in states:
        if old <= number - STATES_KEPT:
            system, folder = file_system(spark, f"{events_path}/{KNOWN}/{old}-{key}")
            system.delete(folder, True)


def own_folder(rows: DataFrame, batch_key: str, path: str) -> None:
    """Replace the folder of a batch; a batch without rows leaves an empty one. Digests and keys as text take half the space in zstd."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{BATCH}={batch_key}")


def compact(spark: SparkSession, events_path: str, keep: int = 1) -> int:
    """Merge the folders of finished batches into one; returns how many were merged.

    The ``keep`` newest folders stay, since a restart may apply them again. Run it between two runs
    of the stream. What is cut short is finished by the next call, so no event is seen twice or lost.
    """
    rewrite.recover(spark, events_path)
    system, root = file_system(spark, events_path)
    found = sorted((f.getModificationTime(), f.getPath().toString()) for f in system.listStatus(root) if f.getPath().getName().startswith(BATCH))
    old = [name for _, name in found][:-keep or None]
    if len(old) < 2:
        return 0
    rows = spark.read.option("basePath", events_path).parquet(*old).withColumn(BATCH, F.lit(f"merged-{uuid.uuid4().hex}"))
    rewrite.replace(spark, events_path, old, rows.repartitionByRange("node_id", "sequence").sortWithinPartitions("node_id", "sequence"), [BATCH])
    return len(old)


def start_ingest(
    spark: SparkSession, inbox: str, events_path: str, checkpoint: str,
    on_new: Callable[[DataFrame], None] | None = None, files_per_batch: int = 1000,
    rejects_path: str | None = None, nodes: DataFrame | None = None,
) -> StreamingQuery:
    """Watch a folder of event batches and append every new event once, refused ones to ``rejects_path``."""
    source = ev.read_envelopes(spark, inbox, stream=True, maxFilesPerTrigger=str(files_per_batch))
    run = run_of(spark, checkpoint)
    return (
        source.writeStream.foreachBatch(
            lambda df, i: apply_batch(spark, df, f"{run}-{i}", events_path, rejects_path, nodes, on_new))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


#: Folder inside the stored reads that their readers pass over: keys of each hour, to count plates from.
KEYS = "_keys"


def day_keys(spark: SparkSession, reads_path: str, days: list[str]) -> DataFrame:
    """Stored parts of some days. Only the folders of these days are listed and read."""
    path = f"{reads_path}/{KEYS}"
    return spark.read.option("basePath", path).parquet(*[f"{path}/{BATCH}=*/day={d}" for d in days]).drop(BATCH)


def start_rollup(spark: SparkSession, reads: DataFrame, reads_path: str, rollup_path: str, checkpoint: str) -> StreamingQuery:
    """Keep reads and their hourly roll-up: a batch rewrites the days it touches, exactly, however late.

    Every batch stores its reads in a folder of its own, and beside them how often each plate was read
    per hour and camera. The hours of the touched days are counted from these keys and replace the day
    in the roll-up; no read that an earlier batch has stored is read again, and no key of another day.
    Distinct plates are exact.
    """
    from ..plans import investigate as Q

    run = run_of(spark, checkpoint)

    def refresh(batch: DataFrame, number: int) -> None:
        key, keys = f"{run}-{number}", f"{reads_path}/{KEYS}"
        own_folder(batch, key, reads_path)
        partials.fold(spark, keys, Q.merged_keys, ["day"], but=key)
        partials.add(Q.hourly_keys(spark.read.schema(batch.schema).parquet(f"{reads_path}/{BATCH}={key}")), key, keys, ["day"])
        touched = [n[len("day="):] for n in _names(spark, f"{keys}/{BATCH}={key}") if n.startswith("day=")]
        if touched:
            rows = Q.rollup_of_keys(day_keys(spark, reads_path, touched)).hint("rebalance", "day")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(rollup_path)

    return reads.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    system, folder = file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(folder)]


def final_reads(reads: DataFrame, camera_id: str | None = None) -> DataFrame:
    """Live feed: final reads as they arrive, for an append sink."""
    rows = reads.filter(~F.col("provisional"))
    return rows.filter(F.col("camera_id") == camera_id) if camera_id else rows


def live_hits(reads: DataFrame, watchlist: DataFrame, as_of) -> DataFrame:
    """Watch-list hits of a read stream: a stream-static join on the pseudonym."""
    return screen(reads, watchlist, as_of)


def passages(frames: DataFrame, idle_seconds: float, late: str = "10 seconds") -> DataFrame:
    """Passages as event-time sessions per camera and track."""
    gap = f"{int(idle_seconds * 1000)} milliseconds"
    return (
        frames.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "camera_id", "track_id")
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("frames_seen"))
        .select("camera_id", "track_id", "first_seen", "last_seen", "frames_seen")
    )


#: What a bucket keeps, pickled: presences by key, and the frames that wait by key. As columns of a row it would
#: be taken apart and put together cell by cell on both sides, which costs ten times the work on the frames.
_STATE = "held binary"
_EVENTS = "camera_id string, track_id bigint, zone_id string, kind string, at_frame bigint, at timestamp"
#: Seconds without a frame of the track, in event time, after which its presence is over.
IDLE_SECONDS = 60.0
#: Keys are dealt to so many buckets. The number belongs to a checkpoint and bounds the tasks that share the keys.
BUCKETS = 1024


def zone_transitions(members: DataFrame, late: str = "10 seconds", idle_seconds: float = IDLE_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Streaming zone transitions: the rows of the batch operator with the same ``idle_seconds``.

    Debouncing needs the frames in order, and they may come in any order within ``late``. So frames
    wait in the state until the watermark has passed them and are then taken in order; what a key
    keeps is bounded by the frames of that span. A presence whose track stays away is closed once
    the watermark is ``idle_seconds`` beyond its last frame. Python is called once a bucket of keys
    and micro-batch, not once a key: a call costs milliseconds. A checkpoint made with
    another number of ``buckets``, or by key, cannot go on.
    """
    columns = [c.split()[0] for c in _EVENTS.split(", ")]
    idle_us, none = int(idle_seconds * 1_000_000), -(1 << 63)

    def whole(column: pd.Series) -> list[int | None]:
        """Integers of a column, which pandas makes floats where it holds a null."""
        return column.tolist() if column.dtype.kind == "i" else [None if pd.isna(x) else int(x) for x in column.tolist()]

    def advance(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Take the frames of a bucket that the watermark has passed, key by key."""
        # By key: latch, side, run, last frame, its time; and frame, time, inside, frames to enter, frames to leave.
        present, waiting = pickle.loads(state.get[0]) if state.exists else ({}, {})
        if not state.hasTimedOut:
            for rows in batches:
                times = rows["ts"].astype("datetime64[us]").astype("int64")
                keys = zip(rows["camera_id"].tolist(), rows["track"].tolist(), rows["zone_id"].tolist(), strict=True)
                seen = zip(whole(rows["frame_index"]), times.tolist(), rows["inside"].tolist(), whole(rows["enter_frames"]), whole(rows["exit_frames"]), strict=True)
                for key, row in zip(keys, seen, strict=True):
                    waiting.setdefault(key, []).append(row)
        mark = state.getCurrentWatermarkMs() * 1000
        out: list[tuple] = []
        for key, rows in list(waiting.items()):
            ready = sorted(x for x in rows if x[1] <= mark)
            if not ready:
                continue
            if len(ready) < len(rows):
                waiting[key] = [x for x in rows if x[1] > mark]
            else:
                del waiting[key]
            latch, side, run, last, last_us = present.get(key, (False, False, 0, None, None))
            for frame, us, inside, enter, leave in ready:
                if last is not None and (frame > last + 1 or us - last_us > idle_us):
                    if latch:
                        out.append((*key, "lost", last + 1, None))
                    latch, run = False, 0
                run = run + 1 if run and side == inside else 1
                side, last, last_us = inside, frame, us
                limit = enter if inside else leave
                if inside != latch and limit is not None and run >= limit:
                    latch = inside
                    out.append((*key, "entry" if inside else "exit", frame, us))
            present[key] = bool(latch), bool(side), run, last, last_us
        for key in [k for k, (*_, last_us) in present.items() if k not in waiting and mark > last_us + idle_us]:
            latch, _, _, last, _ = present.pop(key)
            if latch:
                out.append((*key, "lost", last + 1, None))
        if present or waiting:
            state.update((pickle.dumps((present, waiting), protocol=4),))
            wake = min([min(x[1] for x in rows) for rows in waiting.values()] + [row[4] + idle_us for key, row in present.items() if key not in waiting])
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if out:
            frame_out = pd.DataFrame(out, columns=columns)
            frame_out["track_id"] = pd.Series([None if x is None else int(x) for x in frame_out["track_id"]], dtype="Int64")
            # Whole numbers, with the least one for none: pandas may fail on floats that it has made of them.
            frame_out["at"] = np.array([none if row[-1] is None else row[-1] for row in out], "int64").view("datetime64[us]")
            yield frame_out

    # Track numbers go as text, which is exact beside nulls. The time keeps its column, which carries the watermark.
    rows = members.withWatermark("ts", late).filter("frame_index is not null").select(
        F.pmod(F.xxhash64("camera_id", "track_id", "zone_id"), F.lit(buckets)).alias("bucket"), "camera_id", F.col("track_id").cast("string").alias("track"),
        "zone_id", "frame_index", "ts", "inside", "enter_frames", "exit_frames")
    return rows.groupBy("bucket").applyInPandasWithState(advance, _EVENTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain the stream's present input into a Parquet table and read it back."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/table")
