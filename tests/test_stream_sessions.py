"""Streamed sessions and triggers against the batch operators: any cut of frames, late rows, restarts, late plates."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayledger.operators import tracks, zones
from wayledger.streaming import live, sessions

START = datetime(2024, 1, 1)
FRAMES = "camera_id string, track_id long, frame_index long, ts timestamp, box struct<x1:double,y1:double,x2:double,y2:double>, has_crop boolean"
PLATES = "camera_id string, track_id long, plate string, ts timestamp"
SESSION = ("camera_id", "track_id", "zone_id", "entry_frame", "entered_at", "exit_frame", "exited_at", "close_reason", "dwell_seconds")


def frame_rows(seed, n=160):
    """Vehicles that drive through a square of one camera, halt in it, miss frames, leave and return."""
    rng, rows = random.Random(seed), []
    for camera in ("C1", "C2"):
        for track in range(6):
            x, speed = rng.uniform(-20, 40), rng.choice([0.4, 1.0, 3.0])
            for f in range(rng.randrange(60), n):
                if rng.random() < 0.03:
                    continue
                x += speed if rng.random() < 0.9 else -speed * 4
                rows.append((camera, track, f, START + timedelta(seconds=f), (x - 1, 0.0, x + 1, 10.0), rng.random() < 0.4))
        rows += [(camera, 99, f, START + timedelta(seconds=f), (-50.0, 0.0, -40.0, 10.0), False) for f in range(n)]  # always in view
    return rows


def zone_table(spark):
    ring = [(20.0, 0.0), (60.0, 0.0), (60.0, 20.0), (20.0, 20.0)]
    return spark.createDataFrame([(c, "Z", ring, 30.0, 3, 4) for c in ("C1", "C2")],
                                 "camera_id string, zone_id string, polygon array<struct<x:double,y:double>>, max_dwell_seconds double, enter_frames int, exit_frames int")


def cut(rows, n, seed, late=8):
    """Rows in ``n`` lots by a time of arrival up to ``late`` seconds behind their own."""
    rng = random.Random(seed)
    lots = [[] for _ in range(n)]
    for row in rows:
        arrival = (row[3] - START).total_seconds() + rng.uniform(0, late)
        lots[min(n - 1, max(0, int(arrival * n / 170)))].append(row)
    return lots


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, tmp_path, build, lots, restart_after):
    """Write lots as files and drain them, stopping after some of them."""
    sessions.use_state_store(spark)
    out = None
    for part in (lots[:restart_after], lots[restart_after:]):
        for name, schema, rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        out = live.run_to_table(build(), f"{tmp_path}/out")
    return out


def batch_sessions(spark, rows, mark):
    frames = spark.createDataFrame(rows, FRAMES)
    got = zones.sessions(frames, zone_table(spark)).filter(F.col("exited_at") <= mark)
    return sorted(tuple(r[c] for c in SESSION) for r in got.collect())


@pytest.mark.parametrize("seed,lots", [(1, 6), (2, 3)])
def test_sessions_equal_batch_over_any_cut(spark, tmp_path, seed, lots):
    rows = frame_rows(seed)
    pieces = [("frames", FRAMES, lot) for lot in cut(rows, lots, seed)]
    build = lambda: sessions.closed_sessions(stream_of(spark, tmp_path / "frames", FRAMES), zone_table(spark))
    got = sorted(tuple(r[c] for c in SESSION) for r in run(spark, tmp_path, build, pieces, lots // 2).collect())
    want = batch_sessions(spark, rows, START + timedelta(seconds=159 - 10))
    assert got == want and {r[7] for r in want} == {"exited", "track_lost", "timed_out"}


def test_plates_before_and_after_the_end_of_a_session(spark, tmp_path):
    rows = frame_rows(5)
    last = START + timedelta(seconds=159)
    plates = [("C1", 0, "early", START + timedelta(seconds=1)), ("C1", 1, "late", last), ("C2", 2, "first", START), ("C2", 2, "second", last), ("C9", 7, "none", last)]
    build = lambda: sessions.closed_sessions(stream_of(spark, tmp_path / "frames", FRAMES), zone_table(spark))
    done = run(spark, tmp_path, build, [("frames", FRAMES, lot) for lot in cut(rows, 4, 5)], 2)
    keys = lambda df: sorted(tuple(r[c] for c in SESSION) for r in df.collect())
    for lot in (plates[:3], plates[3:]):
        spark.createDataFrame(lot, PLATES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/plates")
        stored = live.run_to_table(stream_of(spark, tmp_path / "plates", PLATES), f"{tmp_path}/read")
        got = sessions.plated(done, stored)
        assert keys(got) == keys(done)
    of = lambda c, k: {r.plate for r in got.collect() if (r.camera_id, r.track_id) == (c, k)}
    assert of("C1", 0) == {"early"} and of("C1", 1) == {"late"} and of("C2", 2) == {"second"} and of("C2", 3) == {None}


def test_triggers_are_told_once_and_equal_batch(spark, tmp_path):
    rows = frame_rows(8)
    # A silence longer than the idle time, then the track again.
    rows += [("C1", 50, f, START + timedelta(seconds=f), (0.0, 0.0, 1.0, 1.0), True) for f in [*range(20), *range(90, 120)]]
    pieces = [("frames", FRAMES, lot) for lot in cut(rows, 5, 8)]

    def build():
        return sessions.provisional_triggers(stream_of(spark, tmp_path / "frames", FRAMES), idle_frames=4, idle_seconds=30.0)

    got = sorted(tuple(r) for r in run(spark, tmp_path, build, pieces, 2).collect())
    seen = spark.createDataFrame([r for r in rows if r[3] <= START + timedelta(seconds=149)], FRAMES)
    assert got == sorted(tuple(r) for r in tracks.provisional_triggers(seen, idle_frames=4).collect())
    assert [r for r in got if r[1] == 50 and r[0] == "C1"] == [("C1", 50, 0, 7), ("C1", 50, 90, 97)]
