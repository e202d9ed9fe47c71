"""Verification from segments against verification of the whole log, over cuts, gaps, late events and tampering."""

import random

import pytest

from wayledger.operators import chain as C
from wayledger.operators import ordered
from wayledger.operators import segments as S
from wayledger.streaming import verification

from .test_ingest import chain, frame, read
from .test_streams_and_files import deliver


def rows_of(df):
    return sorted(map(tuple, df.select("node_id", "n_events", "first_sequence", "last_sequence", "ok", "reason").collect()))


def stored(spark, df):
    return spark.createDataFrame(df.collect(), S.SEGMENTS)


@pytest.mark.parametrize("seed,block", [(1, 1 << 16), (2, 5)])
def test_any_cut_says_what_the_whole_log_says(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ordered.block_of, "__defaults__", (block,))
    rng = random.Random(seed)
    rows = []
    for node, faults in (("A", 0), ("B", 1), ("C", 3), ("D", 0)):
        own = chain([read(track_id=k) for k in range(14)], node, start=3 if node == "D" else 1)
        for r in rng.sample(own, faults):
            which = rng.randrange(3)
            if which == 0:
                r[6] = r[6].replace("1234", "9999")  # payload
            elif which == 1:
                r[3] = "0" * 64  # link
            else:
                r[7] = None if rng.random() < 0.5 else False  # signature
        rows += own
    cuts = [[], [], []]
    for r in rows:
        rng.choice(cuts).append(r)
    cuts.append([cuts[0].pop()])
    have, told = spark.createDataFrame([], S.SEGMENTS), []
    for k, cut in enumerate(cuts):
        have = stored(spark, S.joined(have.unionByName(S.segments_of(frame(spark, cut)))))
        told += cut
        assert rows_of(S.verdict(have)) == rows_of(C.verify_chains(frame(spark, told)))
    assert rows_of(S.verdict(have, None)) == rows_of(C.verify_chains(frame(spark, told), start=None))
    assert sorted(map(tuple, S.joined(have).collect())) == sorted(map(tuple, have.collect()))
    # Every sequence has come: one segment a node is left.
    assert have.count() == 4


def test_nothing_and_events_of_no_chain(spark):
    assert S.verdict(S.segments_of(frame(spark, []))).count() == 0
    lost = chain([read()] * 2)
    lost[0][0], lost[1][1] = None, None
    assert S.segments_of(frame(spark, lost)).count() == 0


def test_stream_with_a_break_in_each_run(spark, tmp_path):
    inbox, out = tmp_path / "in", f"{tmp_path}/out"
    inbox.mkdir()
    rows = chain([read()] * 9, "N1")
    rows[6][6] = rows[6][6].replace("1234", "9999")

    def run(checkpoint="ck"):
        verification.start(spark, str(inbox), f"{out}/events", f"{out}/{checkpoint}", files_per_batch=1).awaitTermination()
        return rows_of(verification.verdicts(spark, f"{out}/events"))

    deliver(inbox, "a", rows[:2], 0)
    deliver(inbox, "b", rows[3:5], 1)
    assert run() == [("N1", 4, 1, 5, False, "sequence gap at 4 (expected 3)")]
    deliver(inbox, "c", rows[5:], 2)
    assert run() == [("N1", 8, 1, 9, False, "sequence gap at 4 (expected 3)")]
    deliver(inbox, "d", [rows[2]], 3)
    assert run() == [("N1", 9, 1, 9, False, "verification failed at sequence 7")]
    # All again under a new checkpoint: nothing is counted twice.
    assert run("other") == [("N1", 9, 1, 9, False, "verification failed at sequence 7")]
    # Segments are all it reads.
    plan = verification.verdicts(spark, f"{out}/events")
    assert all(f"/{verification.SEGMENTS}/" in f for f in plan.inputFiles())
