"""Zone sessions and provisional triggers as frames arrive, each row once, over state with timers.

Both need a camera's frames in order, and they may come in any order within ``late``. Frames wait in
the state until the watermark has passed them and are then taken in order, so the rows do not depend
on how frames were cut into micro-batches. A timer wakes a key for its next waiting frame and for what
it has to forget. Needs the RocksDB state store (``STATE_STORE``), whose state a restart reads again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.zones import attach_plates, memberships

# The processors travel to the workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

SESSION_ROWS = (
    "camera_id string, track_id bigint, zone_id string, entry_frame bigint, entered_at timestamp, exit_frame bigint,"
    " exited_at timestamp, close_reason string, dwell_seconds double"
)
TRIGGER_ROWS = "camera_id string, track_id bigint, passage_start bigint, trigger_frame bigint"


def use_state_store(spark: SparkSession) -> None:
    """Let queries started from now on keep their state where timers can be kept."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


_KINDS = {"bigint": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType()}


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def _struct(columns: str) -> StructType:
    """A struct of ``name type, name type``; workers have no session that could parse it."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _when(us: int) -> datetime:
    return datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000, tzinfo=None)


class _Waiting(StatefulProcessor):
    """Rows in time order behind the watermark: what the two processors below share.

    ``rows`` names the columns that wait; the first is the time in microseconds.
    """

    rows: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _struct(self.rows))
        self.names = _names(self.rows)

    def taken(self, rows: Iterator[pd.DataFrame], mark: int) -> list[tuple]:
        """Rows up to the mark, in order; the others go on waiting, and a timer stands at the first of them."""
        queue = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        fresh = [x for batch in rows for x in batch[self.names].astype(object).where(batch[self.names].notna(), None).itertuples(index=False, name=None)]
        if not fresh and not queue:
            return []
        queue += fresh
        ready = sorted((x for x in queue if x[0] <= mark), key=lambda x: tuple((v is not None, v) for v in x))
        rest = [x for x in queue if x[0] > mark]
        if rest:
            self.waiting.put(rest)
            self.wake(min(x[0] for x in rest))
        elif self.waiting.exists():
            self.waiting.clear()
        return ready

    def wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1_000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self.step(key, rows, timerValues.getCurrentWatermarkInMs() * 1_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.step(key, iter(()), timerValues.getCurrentWatermarkInMs() * 1_000)

    def close(self) -> None:
        pass


class _Sessions(_Waiting):
    """Debounced sessions of the tracks of one camera."""

    rows = "us bigint, frame bigint, track bigint, zone string, inside boolean, enter int, leave int, limit_us bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.present = handle.getListState("present", _struct(
            "track bigint, zone string, side boolean, run int, latch boolean, last bigint, entry_frame bigint, entered_us bigint, limit_us bigint"))

    def step(self, key, rows, mark) -> Iterator[pd.DataFrame]:
        ready = self.taken(rows, mark)
        if not ready:
            return
        present = {(r[0], r[1]): list(r)[2:] for r in self.present.get()} if self.present.exists() else {}
        out: list[tuple] = []

        def finish(where: tuple, state: list, frame: int, us: int, reason: str) -> None:
            if state[4] is not None:
                dwell = (max(0, us - state[5]) + 500) // 1_000 / 1_000.0  # halves go up, as in the batch form
                out.append((key[0], *where, state[4], _when(state[5]), frame, _when(us), reason, dwell))
                state[4] = state[5] = None

        at = 0
        while at < len(ready):
            us, frame = ready[at][:2]
            here: dict[tuple, tuple] = {}
            while at < len(ready) and ready[at][:2] == (us, frame):
                here[ready[at][2:4]] = ready[at]
                at += 1
            for where in [w for w in present if w not in here]:
                finish(where, present.pop(where), frame, us, "track_lost")
            for where, (*_, inside, enter, leave, limit) in here.items():
                # side, run, latch, last frame, entry frame, entered, limit
                state = present.setdefault(where, [inside, 0, False, frame, None, None, limit])
                if frame > state[3] + 1:
                    finish(where, state, frame, us, "track_lost")
                    state[1], state[2] = 0, False
                state[1] = state[1] + 1 if state[1] and state[0] == inside else 1
                state[0], state[3], state[6] = inside, frame, limit
                if inside != state[2] and state[1] >= (enter if inside else leave):
                    state[2] = inside
                    if inside:
                        state[4], state[5] = frame, us
                    else:
                        finish(where, state, frame, us, "exited")
            for where, state in present.items():
                if state[4] is not None and us > state[5] + state[6]:
                    finish(where, state, frame, us, "timed_out")
        self.present.put([(*w, *s) for w, s in present.items()])
        if out:
            yield pd.DataFrame(out, columns=_names(SESSION_ROWS))


def closed_sessions(frames: DataFrame, zones: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Rows of zone sessions as they close: those of :func:`..operators.zones.sessions` that have an end.

    A session ends by its exit, at the first frame of its camera without its track, or at the first
    frame past its zone's longest dwell. Frames that come later than ``late`` are left out. A camera is
    one key, since its frames are what closes sessions: as many frames as one lens takes. It keeps the
    tracks in view and the frames that wait. Plates may come at any time and are joined to the stored
    rows (:func:`plated`).
    """
    rows = memberships(frames.withWatermark("ts", late), zones).select(
        "camera_id", "ts", F.unix_micros("ts").alias("us"), F.col("frame_index").alias("frame"), F.col("track_id").alias("track"),
        F.col("zone_id").alias("zone"), "inside", F.col("enter_frames").cast("int").alias("enter"), F.col("exit_frames").cast("int").alias("leave"),
        (F.col("max_dwell_seconds") * 1_000_000).cast("bigint").alias("limit_us"))
    return rows.groupBy("camera_id").transformWithStateInPandas(_Sessions(), SESSION_ROWS, "Append", "EventTime")


def plated(sessions: DataFrame, plates: DataFrame) -> DataFrame:
    """Stored sessions with the plate of their track, however late it came: the newest of (camera_id, track_id, plate, ts)."""
    newest = plates.groupBy("camera_id", "track_id").agg(F.max(F.struct("ts", "plate")).alias("p"))
    return attach_plates(sessions, newest.select("camera_id", "track_id", F.col("p.plate").alias("plate")))


class _Triggers(_Waiting):
    """One trigger per passage of a track, as soon as both counts are reached."""

    rows = "us bigint, frame bigint, crop boolean"

    def __init__(self, idle_frames: int, idle_us: int, min_frames: int, min_candidates: int) -> None:
        self.idle_frames, self.idle_us, self.min_frames, self.min_candidates = idle_frames, idle_us, min_frames, min_candidates

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.passage = handle.getValueState("passage", _struct(
            "start bigint, last bigint, last_us bigint, seen bigint, crops bigint, told boolean"))

    def step(self, key, rows, mark) -> Iterator[pd.DataFrame]:
        ready = self.taken(rows, mark)
        now = tuple(self.passage.get()) if self.passage.exists() else None
        out = []
        for us, frame, crop in ready:
            if now is None or frame - now[1] > self.idle_frames or us - now[2] > self.idle_us:
                now = (frame, frame, us, 0, 0, False)
            start, _, _, seen, crops, told = now
            seen, crops = seen + 1, crops + bool(crop)
            if not told and seen >= self.min_frames and crops >= self.min_candidates:
                told = True
                out.append((key[0], key[1], start, frame))
            now = (start, frame, us, seen, crops, told)
        if now is not None and now[2] + self.idle_us < mark and not self.waiting.exists():
            self.passage.clear()  # silent: a later frame opens a passage of its own
        elif now is not None:
            self.passage.update(now)
            self.wake(now[2] + self.idle_us)
        if out:
            yield pd.DataFrame(out, columns=_names(TRIGGER_ROWS))


def provisional_triggers(
    frames: DataFrame, idle_frames: int = 12, idle_seconds: float = 60.0, min_frames: int = 8, min_candidates: int = 3, late: str = "10 seconds",
) -> DataFrame:
    """First frame of each passage with enough frames seen and enough crops, told once while the passage is open.

    A passage ends by a gap of more than ``idle_frames`` frames or ``idle_seconds``; a track that has
    been silent for so long is forgotten.
    """
    rows = frames.withWatermark("ts", late).select(
        "camera_id", "track_id", "ts", F.unix_micros("ts").alias("us"), F.col("frame_index").alias("frame"), F.col("has_crop").alias("crop"))
    return rows.groupBy("camera_id", "track_id").transformWithStateInPandas(
        _Triggers(idle_frames, int(idle_seconds * 1_000_000), min_frames, min_candidates), TRIGGER_ROWS, "Append", "EventTime")
