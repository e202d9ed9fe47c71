import random

from pyspark.sql import functions as F

from wayledger.operators.ordered import block_of, with_previous, with_running
from wayledger.operators.tracks import directions, with_row_number


def test_blocks_agree_with_plain_order(spark):
    """Small blocks, a key that holds a third of the rows, gaps wider than a block."""
    rng = random.Random(5)
    rows = [(k, o, rng.randrange(100)) for k, n in (("hot", 200), ("a", 30), ("b", 1)) for o in sorted(rng.sample(range(900), n))]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    block = block_of(F.col("o"), 16)
    out = with_previous(df, ["k"], "o", ["v"], block=block)
    out = with_running(out, ["k"], "o", F.col("v"), "peak", block=block)
    out = with_running(out, ["k"], "o", F.col("v"), "low_ahead", func=F.min, forward=False, inclusive=False, block=block)
    got = {(r.k, r.o): (r.prev_v, r.peak, r.low_ahead) for r in out.collect()}
    for key in ("hot", "a", "b"):
        line = sorted((o, v) for k, o, v in rows if k == key)
        for i, (o, v) in enumerate(line):
            before, upto, after = [x for _, x in line[:i]], [x for _, x in line[: i + 1]], [x for _, x in line[i + 1:]]
            assert got[(key, o)] == (before[-1] if before else None, max(upto), min(after) if after else None)


def test_row_numbers(spark):
    df = spark.createDataFrame([("x", i * 70_000) for i in range(5)] + [("y", 3)], "k string, o bigint")
    got = sorted((r.k, r.o, r._n) for r in with_row_number(df, ["k"], "o").collect())
    assert got == [("x", i * 70_000, i + 1) for i in range(5)] + [("y", 3, 1)]


def test_direction_uses_the_last_64_boxes(spark):
    rows = [("c", 1, i, (float(i if i < 50 else 49), 0.0, float(i if i < 50 else 49) + 10, 10.0)) for i in range(130)]
    df = spark.createDataFrame(rows, "camera_id string, track_id bigint, frame_index bigint, box struct<x1:double,y1:double,x2:double,y2:double>")
    got = {r.frame_index: r.dir_x for r in directions(df).collect()}
    assert got[0] is None and got[10] == 1.0 and got[111] == 1.0 and got[112] is None
