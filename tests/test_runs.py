"""Runs of stored sequences against sets; the streamed log finds copies, gaps and heads without reading what it stored."""

import random
import shutil

import pytest

from wayledger.operators import chain as C
from wayledger.operators import runs as R
from wayledger.sources import events as ev
from wayledger.streaming import live

from .test_ingest import chain, read
from .test_streams_and_files import deliver

EVENTS = "node_id string, sequence long, other string"


def as_runs(held):
    out = []
    for node, seq in sorted(held):
        if out and out[-1][0] == node and out[-1][2] == seq - 1:
            out[-1][2] = seq
        else:
            out.append([node, seq, seq])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 1 << 16), (3, 50)])
def test_runs_against_sets(spark, monkeypatch, seed, block):
    from wayledger.operators import ordered

    monkeypatch.setattr(ordered.block_of, "__defaults__", (block,))
    monkeypatch.setattr(R, "BLOCK", block)
    rng, held = random.Random(seed), set()
    stored = spark.createDataFrame([], R.RUNS)
    for _ in range(3):
        events = [(rng.choice("AAB"), rng.choice([rng.randrange(-5, 60), 200_000 + rng.randrange(9)]), "x") for _ in range(60)]
        batch = spark.createDataFrame(events, EVENTS)
        fresh = R.not_held(batch.dropDuplicates(["node_id", "sequence"]), stored)
        assert fresh.columns == batch.columns
        assert {(r.node_id, r.sequence) for r in fresh.collect()} == {e[:2] for e in events} - held
        held |= {e[:2] for e in events}
        stored = spark.createDataFrame(R.merged(stored.unionByName(R.runs_of(batch))).collect(), R.RUNS)
        assert sorted(tuple(r) for r in stored.collect()) == as_runs(held)
        # Merged once more, and with what it holds, it stays as it is.
        again = R.merged(stored.unionByName(stored).unionByName(R.runs_of(batch)))
        assert sorted(tuple(r) for r in again.collect()) == as_runs(held)
    gaps = {(r.node_id, r.gap_from, r.gap_to) for r in R.missing(stored).collect()}
    every = as_runs(held)
    assert gaps == {(a[0], a[2] + 1, b[1] - 1) for a, b in zip(every, every[1:]) if a[0] == b[0]}
    assert R.merged(spark.createDataFrame([], R.RUNS)).count() == 0


def batch_of(spark, folder, name):
    return ev.read_envelopes(spark, f"{folder}/{name}.json")


def test_log_is_not_read_again(spark, tmp_path):
    rows = chain([read()] * 30)
    log = f"{tmp_path}/log"
    for name, some, arrival in (("a", rows[:10], 0), ("b", rows[5:14] + rows[20:24], 100), ("c", rows[:26], 200)):
        deliver(tmp_path, name, some, arrival)
    live.apply_batch(spark, batch_of(spark, tmp_path, "a"), "r-0", log)
    live.apply_batch(spark, batch_of(spark, tmp_path, "b"), "r-1", log)
    stored, heads = live.known(spark, log)
    assert sorted(tuple(r) for r in stored.collect()) == [("N1", 1, 14), ("N1", 21, 24)]
    assert [(r.node_id, r.chain_sequence) for r in heads.collect()] == [("N1", 24)]
    want = C.node_heads(spark.read.parquet(log)).collect()
    assert {tuple(r) for r in heads.collect()} == {tuple(r) for r in want}
    # What was stored is gone from this copy of the log, and still known.
    for k in (0, 1):
        shutil.move(f"{log}/{live.BATCH}=r-{k}", tmp_path / f"away-{k}")
    live.apply_batch(spark, batch_of(spark, tmp_path, "c"), "r-2", log)
    assert sorted(r.sequence for r in spark.read.parquet(log).collect()) == [15, 16, 17, 18, 19, 20, 25, 26]
    assert sorted(tuple(r) for r in live.known(spark, log)[0].collect()) == [("N1", 1, 26)]
    gaps = spark.read.parquet(f"{log}/{live.GAPS}").collect()
    assert [(r.expected, r.received, r.missing) for r in gaps] == [(15, 21, 6)]


def test_a_batch_may_be_applied_again_after_any_step(spark, tmp_path):
    rows = chain([read()] * 12)
    log = f"{tmp_path}/log"
    deliver(tmp_path, "a", rows[:5], 0)
    deliver(tmp_path, "b", rows[3:12], 100)
    live.apply_batch(spark, batch_of(spark, tmp_path, "a"), "r-0", log)
    for _ in range(3):
        live.apply_batch(spark, batch_of(spark, tmp_path, "b"), "r-1", log)
        assert sorted(r.sequence for r in spark.read.parquet(log).collect()) == list(range(1, 13))
    # A driver that ended before the state was complete: the state before it counts.
    done = next(p for p in (tmp_path / "log" / live.KNOWN).iterdir() if p.name.endswith("r-1"))
    (done / "heads" / "_SUCCESS").unlink()
    assert sorted(tuple(r) for r in live.known(spark, log)[0].collect()) == [("N1", 1, 5)]
    live.apply_batch(spark, batch_of(spark, tmp_path, "b"), "r-1", log)
    assert sorted(r.sequence for r in spark.read.parquet(log).collect()) == list(range(1, 13))
    # A log without states is read once.
    shutil.move(f"{log}/{live.KNOWN}", tmp_path / "states")
    assert sorted(tuple(r) for r in live.known(spark, log)[0].collect()) == [("N1", 1, 12)]
