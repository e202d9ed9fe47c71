import math
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayledger import refdata as R
from wayledger.functions import geometry as G
from wayledger.functions.plates import fields_of
from wayledger.operators import crops as K
from wayledger.operators import fusion as U
from wayledger.operators import tracks as T
from wayledger.operators import zones as Z
from wayledger.streaming import live

T0 = datetime(2024, 1, 1)
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
FRAMES = f"camera_id string, track_id bigint, frame_index bigint, ts timestamp, box {BOX}"
ZONES = ("zone_id string, camera_id string, polygon array<struct<x:double,y:double>>, max_dwell_seconds double, enter_frames int, exit_frames int")
SQUARE = [(100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0)]


def at(x, y):
    """A box whose road contact point is (x, y)."""
    return (x - 10.0, y - 20.0, x + 10.0, y)


def frames(spark, paths, fps=10.0):
    rows = [("CAM", t, f, T0 + timedelta(seconds=f / fps), at(*p)) for t, path in paths.items() for f, p in path.items()]
    return spark.createDataFrame(rows, FRAMES)


def zone(spark, dwell=3600.0, enter=2, leave=2):
    return spark.createDataFrame([("Z", "CAM", SQUARE, dwell, enter, leave)], ZONES)


def spark_sessions(df):
    return sorted(((r.track_id, r.entry_frame, r.exit_frame, r.close_reason) for r in df.collect()), key=lambda r: r[:2])


def test_entry_and_exit(spark):
    path = {f: (50.0 + 20 * f, 200.0) for f in range(20)}
    s = Z.sessions(frames(spark, {1: path}), zone(spark)).collect()
    assert len(s) == 1 and s[0].close_reason == "exited" and s[0].dwell_seconds > 0


def test_jitter_on_the_border_is_quiet(spark):
    path = {f: (101.0 if f % 2 else 99.0, 200.0) for f in range(30)}
    assert Z.transitions(Z.memberships(frames(spark, {1: path}), zone(spark))).count() == 0


def test_lost_timeout_and_open(spark):
    inside = (200.0, 200.0)
    lost = {1: {f: inside for f in range(5)}, 2: {f: (10.0, 10.0) for f in range(9)}}
    assert spark_sessions(Z.sessions(frames(spark, lost), zone(spark))) == [(1, 1, 5, "track_lost")]
    long = {1: {f: inside for f in range(40)}}
    assert spark_sessions(Z.sessions(frames(spark, long), zone(spark, dwell=2.0))) == [(1, 1, 22, "timed_out")]
    assert spark_sessions(Z.sessions(frames(spark, long), zone(spark))) == [(1, 1, None, None)]


@pytest.mark.parametrize("block", [16, 256, 65_536])
def test_thresholds_of_any_length_across_blocks(spark, block):
    """Outside up to frame 39, inside for 2,500 frames, outside to the end: what must happen follows from the numbers."""
    first, stay, end = 40, 2_500, 4_000
    path = {f: (200.0, 200.0) if first <= f < first + stay else (10.0, 10.0) for f in range(end)}
    wanted = (1, 64, 65, 100, 1_000)
    zones = spark.createDataFrame([(f"Z{n}", "CAM", SQUARE, 9e9, n, n) for n in wanted], ZONES)
    rows = Z.transitions(Z.memberships(frames(spark, {1: path}), zones), zones, block=block).collect()
    got = sorted((int(r.zone_id[1:]), r.kind, r.at_frame) for r in rows)
    assert got == sorted([(n, "entry", first + n - 1) for n in wanted] + [(n, "exit", first + stay + n - 1) for n in wanted])


def test_a_missing_frame_ends_a_presence(spark):
    path = {f: (200.0, 200.0) for f in (*range(0, 30), *range(31, 50), *range(52, 53))}
    for block in (16, 65_536):
        rows = Z.transitions(Z.memberships(frames(spark, {1: path}), zone(spark, enter=3)), block=block).collect()
        assert sorted((r.at_frame, r.kind) for r in rows) == [(2, "entry"), (30, "lost"), (33, "entry"), (50, "lost")]
        rows = Z.transitions(Z.memberships(frames(spark, {1: path}), zone(spark, enter=3)), block=block, lost_grace_frames=2).collect()
        assert [r.kind for r in rows] == ["entry", "lost"]


def test_block_size_changes_no_session(spark):
    rng = random.Random(9)
    paths = {0: {f: (10.0, 10.0) for f in range(300)}}
    for t in range(1, 9):
        x, path = rng.uniform(50, 350), {}
        for f in range(300):
            x = min(max(x + rng.uniform(-25, 25), 40.0), 360.0)
            if rng.random() > (0.02 if t < 6 else 0.0):
                path[f] = (x, 200.0)
        paths[t] = path
    for dwell in (3.0, 3600.0):
        one, other = (spark_sessions(Z.sessions(frames(spark, paths), zone(spark, dwell, 3, 5), block=b)) for b in (32, 65_536))
        assert one == other and len(one) > 30
        assert all(end is None or start < end for _, start, end, _ in one)
        if dwell == 3.0:
            assert all(end - start <= 31 for _, start, end, why in one if why == "timed_out")


def test_stream_takes_shuffled_frames_like_the_batch(spark, tmp_path):
    rng = random.Random(2)
    paths = {t: {f: (200.0 if (f // 23 + t) % 2 else 10.0, 200.0) for f in range(240) if f % 97 != 50} for t in range(1, 4)}
    far = {9: {f: (10.0, 10.0) for f in range(2_000, 2_002)}}
    rows = frames(spark, paths).collect()
    want = Z.transitions(Z.memberships(frames(spark, paths), zone(spark, enter=3, leave=4)), idle_seconds=60.0).collect()
    rows.sort(key=lambda r: r.frame_index + rng.uniform(0, 80))  # ten frames a second, so within 8 seconds
    parts = [rows[k * len(rows) // 6:(k + 1) * len(rows) // 6] for k in range(6)]
    for part in [*parts, frames(spark, far).collect()]:
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = live.run_to_table(live.zone_transitions(Z.memberships(stream, zone(spark, enter=3, leave=4))), f"{tmp_path}/out").collect()
    key = lambda r: (r.track_id, r.at_frame, r.kind, r["at"])
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str) and len(got) > 20


def test_stream_calls_python_once_a_bucket_and_batch(spark, tmp_path):
    """Many short tracks in two buckets, cut anywhere, over restarts: the rows of the batch operator from two states."""
    rng = random.Random(5)
    paths = {t: {f: (200.0 if rng.random() < 0.7 else 10.0, 200.0) for f in range(4 * t, 4 * t + 40) if rng.random() > 0.03} for t in range(1, 60)}
    far = {99: {f: (10.0, 10.0) for f in range(3_000, 3_002)}}
    rows = frames(spark, paths).collect()
    want = Z.transitions(Z.memberships(frames(spark, paths), zone(spark, enter=2, leave=2)), idle_seconds=60.0).collect()
    rows.sort(key=lambda r: r.frame_index + rng.uniform(0, 80))
    parts = [rows[k * len(rows) // 4:(k + 1) * len(rows) // 4] for k in range(4)]
    held = []
    for part in [*parts, frames(spark, far).collect()]:
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(FRAMES).parquet(f"{tmp_path}/in")
        told = live.zone_transitions(Z.memberships(stream, zone(spark, enter=2, leave=2)), buckets=2)
        query = told.writeStream.format("parquet").option("path", f"{tmp_path}/out/table").option(
            "checkpointLocation", f"{tmp_path}/out/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        held += [json.loads(x.json)["stateOperators"][0]["numRowsTotal"] for x in query.recentProgress]
    got = spark.read.schema(told.schema).parquet(f"{tmp_path}/out/table").collect()
    key = lambda r: (r.track_id, r.at_frame, r.kind, r["at"])
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str) and len(got) > 200
    assert max(held) == 2


def test_passages_and_triggers(spark):
    path = {f: (10.0, 10.0) for f in [*range(10), *range(21, 29), 43]}
    df = frames(spark, {1: path}).withColumn("has_crop", F.col("frame_index") % 5 == 0)
    got = sorted((r.passage_start, r.frames_seen, r.last_frame) for r in T.passages(df).collect())
    assert got == [(0, 18, 28), (43, 1, 43)]
    assert [(r.passage_start, r.trigger_frame) for r in T.provisional_triggers(df).collect()] == [(0, 25)]


def test_links_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for f in range(6):
        for t in range(12):
            x, y = rng.uniform(-300, 900), rng.uniform(0, 900)
            rows.append(("C", t, f, T0, (x, y, x + rng.uniform(20, 500), y + rng.uniform(20, 500))))

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    want = {(b[2], a[1], b[1]) for a in rows for b in rows if b[2] == a[2] + 1 and iou(a[4], b[4]) >= 0.1}
    got = [(r.frame_index, r.prev_track_id, r.track_id) for r in T.link_candidates(spark.createDataFrame(rows, FRAMES), 0.1).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def chosen(spark, rows, **options):
    df = K.select_crops(spark.createDataFrame([("t", f, q) for f, q in rows], "track_id string, frame_index bigint, quality double"), **options)
    return sorted(r.frame_index for r in df.collect())


def test_crop_choice_worked_by_hand(spark):
    # Two crops of three: 10 first. Beside it 11 counts 0.9 (1 - 0.6 * 5/6) = 0.45, so the weaker but distant 30 comes before it.
    assert chosen(spark, [(10, 1.0), (11, 0.9), (30, 0.5)], k=2) == [10, 30]
    # At 0.4 the distant one loses to 0.45.
    assert chosen(spark, [(10, 1.0), (11, 0.9), (30, 0.4)], k=2) == [10, 11]
    # Crops below the floor are never chosen; few enough are all chosen, whatever their distance.
    assert chosen(spark, [(1, 0.04), (2, 0.05), (3, 1.0)], k=2) == [2, 3]


def test_crop_choice_keeps_its_promises(spark):
    rng = random.Random(6)
    for n in (3, 8, 9, 40, 201):
        rows = [(f, round(0.06 + 0.9 * rng.random(), 4)) for f in range(n)]
        got = chosen(spark, rows)
        assert len(got) == len(set(got)) == min(n, 8)
        assert max(rows, key=lambda r: r[1])[0] in got
    # A flat track spreads its crops: no two within half a window.
    flat = chosen(spark, [(f, 0.5) for f in range(100)])
    assert min(b - a for a, b in zip(flat, flat[1:])) >= 3


def test_small_and_clipped_crops_score_low(spark):
    def q(width, x=500.0):
        b = G.box(F.lit(x), F.lit(500.0), F.lit(x + width), F.lit(530.0))
        return K.crop_quality(b, F.lit(1.0), F.lit(1.0), F.lit(1920.0), F.lit(1080.0))

    tiny, small, good, wide, edge = spark.range(1).select(q(12.0), q(30.0), q(90.0), q(120.0), q(120.0, 5.0)).first()
    assert tiny == 0.0 and tiny < small < good < wide == 1.0 and math.isclose(edge, 0.55)


CAND = "track_id string, frame bigint, rank int, quality double, system string, canonical string, score double, confidence string"


def fuse(spark, rows, **kw):
    df = fields_of(spark.createDataFrame(rows, CAND), "canonical", F.col("score"))
    return {r.track_id: r for r in U.fuse(df, **kw).collect()}


def test_fields_no_frame_reads_together_are_assembled(spark):
    plates = ["NP-L:NA-1-CHA-1234", "NP-L:BA-1-PA-1234", "NP-L:BA-1-CHA-1235"]
    rows = [("t", i, 0, 0.8, "devanagari", p, 0.8, "medium") for i, p in enumerate(plates)]
    r = fuse(spark, rows)["t"]
    assert r.canonical == "NP-L:BA-1-CHA-1234" and r.assembled and r.n_frames == 3 and r.agreement == 0.0
    assert math.isclose(r.field_support["zone"], 2 / 3) and math.isclose(r.score, math.log(1e-9)) and len(r.alternatives) == 2


def test_single_frame_is_capped_and_disagreement_lowers(spark):
    one = [("one", 0, 0, 1.0, "devanagari", "NP-L:BA-1-CHA-1234", 0.95, "high")]
    many = [("many", i, 0, 1.0, "embossed", "NP-E:3-B-PA-1234", 0.95, "high") for i in range(4)]
    split = [("split", i, 0, 0.9, "devanagari", "NP-L:BA-1-CHA-1234" if i < 2 else "NP-L:NA-2-PA-9999", 0.95, "high") for i in range(4)]
    got = fuse(spark, one + many + split)
    assert got["one"].confidence == "medium"
    assert got["many"].confidence == "high" and got["many"].agreement == 1.0
    assert got["split"].agreement <= 0.5 and got["split"].confidence in ("low", "medium", "reject")


def test_illegal_assembly_falls_back_to_a_whole_plate(spark):
    rows = [("t", i, 0, 1.0, s, p, q, "medium") for i, (s, p, q) in enumerate([
        ("devanagari", "NP-L:BA-1-CHA-1234", 0.9), ("embossed", "NP-E:3-B-PA-5678", 0.8), ("embossed", "NP-E:4-A-PA-5678", 0.3)])]
    r = fuse(spark, rows)["t"]
    assert not r.assembled and r.canonical == "NP-L:BA-1-CHA-1234" and r.plate_score == 0.9


def test_pooled_rows_are_distributions(spark):
    rng = random.Random(2)
    rows = [("ok", f, 0.5 + f / 10, [[rng.uniform(-5, 0) for _ in range(6)] for _ in range(3)]) for f in range(4)]
    rows += [("ragged", 0, 1.0, [[0.0, 1.0]]), ("ragged", 1, 1.0, [[0.0, 1.0], [1.0, 0.0]]), ("blind", 0, 0.0, [[0.0, 1.0]])]
    df = spark.createDataFrame(rows, "track_id string, frame bigint, quality double, log_probs array<array<double>>")
    out = U.pooled_posteriors(df)
    assert {r.track_id for r in out.select("track_id").distinct().collect()} == {"ok"}
    for r in out.groupBy("t").agg(F.sum(F.exp("log_prob")).alias("s")).collect():
        assert math.isclose(r.s, 1.0, rel_tol=1e-9)


def test_colour_bonus_is_soft(spark):
    post = F.create_map(F.lit("red_white"), F.lit(0.88), F.lit("black_white"), F.lit(0.12))
    private, public, none = spark.range(1).select(
        U.colour_bonus(post, F.lit("private")), U.colour_bonus(post, F.lit("tourist")), U.colour_bonus(post, F.lit("unknown"))).first()
    assert private > math.log(0.9 - 0.05) and math.isclose(public, math.log(1e-3)) and none == 0.0
    assert R.COLOUR_OWNERSHIP["red_white"] == "private"
