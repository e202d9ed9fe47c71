import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayledger.operators import blobs as B
from wayledger.operators import evaluation as E
from wayledger.sources import config, corpus, events as ev, frames, tables
from wayledger.streaming import live

from .test_ingest import chain, read


def deliver(folder, name, rows, arrival):
    keys = ["node_id", "sequence", "captured_at", "prev_hash", "payload_hash", "signature", "payload", "signature_ok"]
    events = [{k: (str(v) if k == "sequence" else v) for k, v in zip(keys, r[:8])} for r in rows]
    body = {"batch_id": name, "node_id": "N1", "received_at": "2024-01-01T00:00:00Z", "arrival": arrival, "events": events}
    (folder / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False) + "\n", encoding="utf-8")


def test_stream_stores_each_event_once(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    rows = chain([read()] * 6)
    seen = []
    run = lambda: live.start_ingest(spark, str(inbox), f"{out}/events", f"{out}/ck", on_new=lambda d: seen.append(d.count())).awaitTermination()
    deliver(inbox, "a", rows[:4], 0)
    run()
    deliver(inbox, "b", rows[2:], 100)
    run()
    stored = spark.read.parquet(f"{out}/events")
    assert sorted(r.sequence for r in stored.collect()) == [1, 2, 3, 4, 5, 6]
    assert seen == [4, 2] and stored.filter("not verified").count() == 0
    # The same micro-batch applied again, as after a failure, changes nothing.
    batch = ev.read_envelopes(spark, str(inbox / "b.json"))
    live.apply_batch(spark, batch, f"{live.run_of(spark, f'{out}/ck')}-1", f"{out}/events")
    assert sorted(r.sequence for r in spark.read.parquet(f"{out}/events").collect()) == [1, 2, 3, 4, 5, 6]


def test_new_checkpoint_loses_and_repeats_nothing(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    rows = chain([read()] * 7)
    rows[6][5] = None  # refused
    nodes = spark.createDataFrame([("N1", True)], "node_id string, active boolean")
    deliver(inbox, "a", rows[:4], 0)
    for name in ("one", "two", "three"):
        live.start_ingest(spark, str(inbox), f"{out}/events", f"{out}/{name}", rejects_path=f"{out}/no", nodes=nodes).awaitTermination()
        assert sorted(r.sequence for r in spark.read.parquet(f"{out}/events").collect()) == list(range(1, 5 if name == "one" else 7))
        if name == "one":
            deliver(inbox, "b", rows[2:], 0)
            (inbox / "z.json").write_text("{nope\n")
    assert live.compact(spark, f"{out}/events") == 2 and live.compact(spark, f"{out}/events") == 0
    assert sorted(r.sequence for r in spark.read.parquet(f"{out}/events").collect()) == [1, 2, 3, 4, 5, 6]
    errors = {r.error for r in spark.read.parquet(f"{out}/no").collect()}
    assert errors == {"malformed event: missing signature", "not json"}


def test_interrupted_merge_is_ended(spark, tmp_path):
    log = f"{tmp_path}/log"
    for k in range(3):
        spark.createDataFrame([("n", k)], "node_id string, sequence long").write.parquet(f"{log}/{live.BATCH}=r-{k}")
    live.compact(spark, log)
    # As left by a driver that ended before the old folders were gone.
    merged = next(p for p in (tmp_path / "log").iterdir() if "merged" in p.name)
    hidden = tmp_path / "log" / "_rewriting-x"
    hidden.mkdir()
    spark.createDataFrame([(str(merged),)], "value string").coalesce(1).write.text(f"{hidden}/old")
    spark.read.parquet(str(merged)).write.parquet(f"{hidden}/rows/{live.BATCH}=merged-x")
    live.compact(spark, log)
    assert sorted(r.sequence for r in spark.read.parquet(log).collect()) == [0, 1, 2]
    assert not hidden.exists() and not merged.exists()


def test_nodes_that_are_not_admitted_are_refused(spark, tmp_path):
    deliver(tmp_path, "a", chain([read()] * 2), 0)
    nodes = spark.createDataFrame([("N1", False)], "node_id string, active boolean")
    live.apply_batch(spark, ev.read_envelopes(spark, str(tmp_path)), "r-0", f"{tmp_path}/events", f"{tmp_path}/no", nodes)
    assert spark.read.parquet(f"{tmp_path}/events").count() == 0
    assert [r.error for r in spark.read.parquet(f"{tmp_path}/no").collect()] == ["node is deactivated"] * 2


def test_malformed_events_are_set_apart(spark, tmp_path):
    rows = chain([read()] * 4)
    rows[1][5], rows[2][1], rows[3][0] = None, "x", "N2"
    deliver(tmp_path, "a", rows, 0)
    (tmp_path / "z.json").write_text("{nope\n")
    raw = ev.read_envelopes(spark, str(tmp_path))
    good, bad = ev.split_wellformed(ev.unpack(raw))
    assert [r.sequence for r in good.collect()] == [1]
    assert sorted(r.error for r in bad.collect()) == [
        "event claims node 'N2' in a 'N1' batch", "malformed event: bad sequence", "malformed event: missing signature"]
    nodes = spark.createDataFrame([("N1", False)], "node_id string, active boolean")
    assert ev.from_active_nodes(good, nodes)[1].first().error == "node is deactivated"


def test_corpus_reader_skips_and_counts(spark, tmp_path):
    good = {"path": "p", "canonical": "NP-E:3-B-PA-1234", "system": "embossed", "tokens": ["3"], "colour": "white_black", "two_row": False,
            "width_px": 90, "quality": 0.5, "track_id": None, "frame": None}
    lines = [json.dumps(good), "{broken", json.dumps({**good, "colour": "mauve"}), json.dumps({**good, "tokens": None})]
    (tmp_path / "index.jsonl").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "index.jsonl")
    assert corpus.read_index(spark, path).count() == 1
    assert tuple(corpus.bad_rows(spark, path).first()) == (4, 3)


def test_blob_digest_must_match(spark):
    import base64
    import hashlib

    data = b"jpeg bytes"
    rows = [(hashlib.sha256(data).hexdigest(), base64.b64encode(data).decode(), "image/jpeg")] * 2 + [("0" * 64, base64.b64encode(data).decode(), "image/jpeg")]
    new, bad = B.checked(spark.createDataFrame(rows, "sha256 string, data string, content_type string"), datetime(2024, 1, 1))
    assert [(r.bytes, r.expires_at) for r in new.collect()] == [(10, datetime(2024, 3, 31))]
    assert bad.first().error.startswith("blob digest mismatch: claimed 000000000000...")


def test_zone_and_node_configuration(spark):
    raw = spark.createDataFrame([("Z", "C", None, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]], None, None, None)], config.ZONE_SCHEMA)
    z = config.zones(raw).first()
    assert (z.name, z.max_dwell_seconds, z.enter_frames, z.exit_frames) == ("Z", 21600.0, 3, 5)
    with pytest.raises(ValueError, match="'Y'"):
        config.zones(spark.createDataFrame([("Y", "C", None, [[0.0, 0.0]], None, None, None)], config.ZONE_SCHEMA))
    cam = lambda i, s: (i, s, None, None, None, None)
    nodes = spark.createDataFrame([("N", "S", 0, [cam("a", "x"), cam("a", "y"), cam("b", None)]), ("M", "S", None, [])], config.NODE_SCHEMA)
    assert sorted((r.node_id, r.problem) for r in config.problems(nodes).collect()) == [
        ("M", "cameras must be a non-empty list"), ("N", "duplicate camera_id a"), ("N", "edge_retention_days must be at least 1"), ("N", "missing source")]


def test_reads_are_laid_out_by_day(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 3, i), f"C{i % 2}", f"h{i}") for i in range(12)]
    reads = spark.createDataFrame(rows, "id bigint, captured_at timestamp, camera_id string, plate_hmac string")
    path = str(tmp_path / "reads")
    tables.write_reads(reads, path)
    tables.write_reads(reads.filter("to_date(captured_at) = '2024-01-02'").limit(1), path)
    back = tables.read_reads(spark, path)
    assert back.filter("capture_date = '2024-01-02'").count() == 1 and back.count() == 9


def test_deleting_rewrites_only_touched_days(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i // 4, i % 4), "C", f"h{i}") for i in range(12)]
    path = str(tmp_path / "reads")
    tables.write_reads(spark.createDataFrame(rows, "id bigint, captured_at timestamp, camera_id string, plate_hmac string"), path)
    untouched = {p.name for p in (tmp_path / "reads" / "capture_date=2024-01-03").iterdir()}
    # All of the first day and half of the second.
    assert tables.delete_rows(spark, path, F.col("id") < 6) == 2
    assert sorted(r.id for r in tables.read_reads(spark, path).collect()) == list(range(6, 12))
    assert not (tmp_path / "reads" / "capture_date=2024-01-01").exists()
    assert {p.name for p in (tmp_path / "reads" / "capture_date=2024-01-03").iterdir()} == untouched
    assert tables.delete_rows(spark, path, F.col("id") < 6) == 0


def test_stills_are_numbered_per_folder(spark):
    files = spark.createDataFrame([("/b/2.JPG",), ("/b/1.png",), ("/a/9.bmp",), ("/a/x.txt",)], "path string")
    got = sorted((r.path, r.frame_index) for r in frames.number_stills(files, "2024-01-01 00:00:00", fps=2.0).collect())
    assert got == [("/a/9.bmp", 1), ("/b/1.png", 1), ("/b/2.JPG", 2)]


def test_thinning_equals_the_greedy_rule(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for cam in ("a", "b"):
        t, last = 0, None
        for i in range(600):
            t += rng.choice([10_000, 33_000, 40_000, 90_000, 5_000_000 if i % 97 == 0 else 20_000])
            rows.append((cam, i, datetime(2024, 1, 1) + timedelta(microseconds=t)))
            if last is None or t - last >= 1_000_000 / 15:
                want.add((cam, i))
                last = t
    df = spark.createDataFrame(rows, "camera_id string, frame_index bigint, ts timestamp")
    for block in (1, 2, 600):
        got = {(r.camera_id, r.frame_index) for r in frames.thinned(df, 15.0, block_seconds=block).collect()}
        assert got == want


def test_split_never_splits_a_track(spark):
    rows = [(f"p{i}", f"t{i // 10}") for i in range(400)]
    out = E.split_corpus(spark.createDataFrame(rows, "path string, track_id string"), 0.1, seed=1)
    per = out.groupBy("track_id").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in per) and sum(r.s == "val" for r in per) == 4
    one = E.split_corpus(spark.createDataFrame([("p", None), ("q", None)], "path string, track_id string"), 0.01)
    assert one.filter("split = 'val'").count() == 1


def test_grid_covers_every_structure(spark):
    rows = [(f"{r.system}:{r.region}-0-{r.vehicle_class}-1234" if r.system == "NP-L" else f"NP-E:{r.region}-{r.vehicle_class}-AB-1234",) for r in E.grid(spark).collect()]
    assert len(rows) == 14 * 13 + 7 * 21
    assert E.missing_structures(spark.createDataFrame(rows, "canonical string")).count() == 0
    assert E.missing_structures(spark.createDataFrame(rows[1:], "canonical string")).count() == 1


def test_lots_are_written_by_many_tasks(spark, tmp_path):
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from wayledger.plans.catalog import quality

    rows = spark.range(0, 900, 1, 8).withColumn("lot", (F.col("id") % 3).cast("int"))
    path, seen = str(tmp_path / "inbox"), []
    for k in quality._in_lots(SimpleNamespace(spark=spark), rows, 3, path):
        found = spark.read.parquet(path)
        seen.append((k, found.count(), found.filter(F.col("id") % 3 > k).count(), len(found.inputFiles()) > k + 1))
    assert seen == [(0, 300, 0, True), (1, 600, 0, True), (2, 900, 0, True)]


def test_lots_are_written_once_and_small(spark, tmp_path, monkeypatch):
    import os
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from wayledger.plans.catalog import quality

    monkeypatch.setattr(quality, "shared_dir", lambda _: str(tmp_path))
    digests = spark.range(0, 6_000, 1, 3).select(F.sha2(F.col("id").cast("string"), 256).alias("value"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).cast("int").alias("lot"))
    path = str(tmp_path / "inbox")
    seen = [(k, spark.read.text(path).count()) for k in quality._in_lots(SimpleNamespace(spark=spark), digests, 3, path, "text")]
    assert seen == [(0, 2_400), (1, 4_800), (2, 4_800)]  # rows of no lot stay out, and the last lot has none
    assert {r.value for r in spark.read.text(path).collect()} == {r.value for r in digests.filter("lot is not null").collect()}
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.startswith(("part-", "lot-")) and "__HIVE" not in d]
    assert sum(os.path.getsize(f) for f in files) < 0.7 * 4_800 * 65 and all(d.startswith(path) for d in map(os.path.dirname, files))


def test_a_batch_is_not_kept_and_what_it_shuffles_goes(spark, tmp_path, monkeypatch):
    import json
    import os

    from wayledger.streaming import live

    def line(arrival, sequence, node="N1"):
        own = {"node_id": node, "sequence": str(sequence), "captured_at": "2024-01-01T00:00:00Z", "prev_hash": "0", "payload_hash": "x", "signature": "eA==",
               "payload": f"{arrival}", "signature_ok": True}
        return json.dumps({"batch_id": f"B{arrival}", "node_id": node, "received_at": "2024-01-01T00:00:00Z", "arrival": arrival, "events": [own]})

    def shuffled():
        return {f for d, _, names in os.walk(local) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    held, write, before = [], live.own_folder, shuffled()
    monkeypatch.setattr(live, "own_folder", lambda *a: (held.append(spark.sparkContext._jsc.getPersistentRDDs().size()), write(*a)))
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    inbox, log = str(tmp_path / "inbox"), str(tmp_path / "log")
    # Copies of 3 arrive before and after it, once in the same batch and once in a later one; N2 says what N1 says.
    lots = [[line(k, s) for k, s in enumerate([1, 2, 3, 3, 4])] + [line(0, 3, "N2")], [line(20, 3), line(21, 6), line(22, 5), line(23, 6)]]
    for k, lot in enumerate(lots):
        os.makedirs(inbox, exist_ok=True)
        (tmp_path / "inbox" / f"{k}.json").write_text("\n".join(lot))
        live.start_ingest(spark, inbox, log, f"{tmp_path}/first").awaitTermination()
    live.start_ingest(spark, inbox, log, f"{tmp_path}/second").awaitTermination()
    stored = sorted((r.node_id, r.sequence, r.arrival) for r in spark.read.parquet(log).collect())
    assert stored == [("N1", 1, 0), ("N1", 2, 1), ("N1", 3, 2), ("N1", 4, 4), ("N1", 5, 22), ("N1", 6, 21), ("N2", 3, 0)]
    assert len(held) == 6 and set(held) == {cached}
    assert shuffled() <= before
    assert all(f.endswith(".zstd.parquet") for d, _, names in os.walk(log) if "_known" not in d for f in names if f.startswith("part-"))
