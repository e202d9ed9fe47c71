"""Partial aggregates over batches: sessions and the hourly roll-up against one pass over all rows, whatever the cut."""

import json
import random
from datetime import datetime, timedelta

import pytest

from wayledger.operators import ingest
from wayledger.plans import investigate as Q
from wayledger.streaming import live, partials

NOW = datetime(2024, 2, 1)


def shown(rows):
    return sorted(map(str, (tuple(r) for r in rows.collect())))


@pytest.mark.parametrize("cut", [1, 4, 20])
def test_parts_of_sessions_over_any_cut(spark, hasher, tmp_path, monkeypatch, cut):
    rng = random.Random(cut)
    events = []
    for k in range(12):
        s, at = f"S{k}", f"2024-02-01T0{k % 10}:00:00+00:00"
        events.append({"kind": "zone_entry", "session_id": s, "zone_id": "Z", "track_id": k, "entered_at": at, "plate": "NP-L:BA-1-CHA-1" if k % 3 == 0 else None})
        if k % 4:
            events.append({"kind": "zone_exit", "session_id": s, "zone_id": "Z", "track_id": k, "entered_at": at,
                           "exited_at": f"2024-02-01T0{k % 10}:05:00+00:00", "dwell_seconds": 300.0, "close_reason": "exit"})
        if k % 2:
            events.append({"kind": "session_plate", "plate": f"NP-L:BA-1-CHA-{k}", "sessions": [s, "never opened"]})
    events += [{"kind": "session_plate", "plate": "NP-L:BA-1-CHA-99", "sessions": None}, {"kind": "zone_exit", "session_id": ""}]
    rows = [("N", k, json.dumps(e), NOW.isoformat(), k % 5 != 0) for k, e in enumerate(events)]
    schema = "node_id string, sequence long, payload string, captured_at string, verified boolean"
    whole = ingest.zone_sessions(spark.createDataFrame(rows, schema), hasher)
    assert whole.count() == 12
    rng.shuffle(rows)
    monkeypatch.setattr(partials, "FAN", 3)
    path, n = str(tmp_path / "parts"), 0
    for n, at in enumerate(range(0, len(rows), cut)):
        parts = ingest.session_parts(spark.createDataFrame(rows[at:at + cut], schema)) if n < 12 else None
        if parts is None:  # the rest as one batch
            parts = ingest.session_parts(spark.createDataFrame(rows[at:], schema))
        partials.fold(spark, path, ingest.merged_parts, but=f"run-{n}")
        for _ in range(1 + n % 2):  # every second batch is applied twice
            partials.add(parts, f"run-{n}", path)
        if n == 12:
            break
    stored = spark.read.schema(ingest.SESSION_PARTS).parquet(path)
    assert shown(ingest.sessions_of(ingest.merged_parts(stored), hasher)) == shown(whole)
    assert len(partials.folders(spark, path)) <= 3 * 3
    if n > 3:
        assert any(k.startswith("merged") for k in partials.folders(spark, path))
    none = spark.createDataFrame([], schema)
    assert ingest.zone_sessions(none, hasher).count() == 0


def test_a_cut_fold_is_finished(spark, tmp_path, monkeypatch):
    from wayledger.sources import rewrite

    path = str(tmp_path / "parts")
    monkeypatch.setattr(partials, "FAN", 2)
    for k in range(2):
        partials.add(spark.createDataFrame([(k, "a"), (7, "b")], "n long, k string"), f"run-{k}", path, ["k"])

    def merge(rows):
        return rows.groupBy("k", "n").count().drop("count")

    finish = rewrite._finish
    monkeypatch.setattr(rewrite, "_finish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        partials.fold(spark, path, merge, ["k"], but="run-2")
    assert spark.read.parquet(path).count() == 4  # readers still see the old folders
    monkeypatch.setattr(rewrite, "_finish", finish)
    assert partials.fold(spark, path, merge, ["k"], but="run-2") == 0
    got = spark.read.parquet(path)
    assert sorted((r.n, r.k) for r in got.collect()) == [(0, "a"), (1, "a"), (7, "b")]
    assert [k.split("-")[0] for k in partials.folders(spark, path)] == ["merged1"]


def test_rollup_reads_only_touched_days(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partials, "FAN", 2)
    rng, schema = random.Random(1), "captured_at timestamp, camera_id string, site_id string, plate_hmac string, confidence string, provisional boolean"
    inbox, reads, out = (str(tmp_path / n) for n in ("inbox", "reads", "rollup"))
    every = []
    for k in range(5):  # one day a batch, each with some reads of the first day, late
        rows = [(NOW + timedelta(days=0 if rng.random() < 0.2 else k, hours=rng.randrange(3)), rng.choice("AB"), "S", rng.choice(["p", "q", None]),
                 rng.choice(["high", "low"]), rng.random() < 0.1) for _ in range(60)]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        live.start_rollup(spark, stream, reads, out, str(tmp_path / "checkpoint")).awaitTermination()  # a restart each time
    want = Q.hourly_rollup(spark.createDataFrame(every, schema))
    assert shown(spark.read.parquet(out).select(want.columns)) == shown(want)
    files = live.day_keys(spark, reads, ["2024-02-03"]).inputFiles()
    assert files and all("day=2024-02-03" in f for f in files)
    assert any(k.startswith("merged") for k in partials.folders(spark, f"{reads}/{live.KEYS}"))
    assert spark.read.parquet(reads).count() == len(every)
