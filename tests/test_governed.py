from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayledger.operators import governance as gov
from wayledger.operators import retention as E
from wayledger.plans import investigate as Q

NOW = datetime(2024, 2, 1)
READ = ("id bigint, captured_at timestamp, camera_id string, site_id string, plate_canonical string, confidence string, score double,"
        " verified boolean, provisional boolean, expires_at timestamp, plate_image_sha256 string, context_image_sha256 string")
WHO = gov.Principal("ram", "investigator")


def table(spark, hasher):
    rows = [
        (1, NOW, "A", "S", "NP-L:BA-1-CHA-1234", "high", 0.9, True, False, NOW + timedelta(days=1), "img1", None),
        (2, NOW + timedelta(seconds=30), "A", "S", "NP-E:3-B-PA-1234", "high", 0.9, True, False, NOW - timedelta(days=1), "img2", "ctx"),
        (3, NOW + timedelta(hours=1), "B", "S", "NP-L:BA-1-CHA-1234", "low", 0.4, False, False, None, None, None),
        (4, NOW + timedelta(hours=1, seconds=20), "B", "S", "NP-E:3-B-PA-1234", "high", 0.9, True, False, NOW + timedelta(days=1), "img1", "ctx"),
        (5, NOW + timedelta(hours=1, seconds=25), "B", "S", "NP-L:KO-0-PA-247", "high", 0.9, True, False, NOW + timedelta(days=9), None, None),
    ]
    return spark.createDataFrame(rows, READ).withColumn("plate_hmac", hasher.hash(F.col("plate_canonical")))


def desk(spark, hasher, tmp_path):
    return Q.Investigator(spark, hasher, {"reads": table(spark, hasher)}, str(tmp_path / "log"))


def log(spark, tmp_path):
    return gov.folded_log(spark.read.schema(gov.LOG_SCHEMA).parquet(str(tmp_path / "log"))).collect()


def test_search_in_any_script_is_logged(spark, hasher, tmp_path):
    rows = desk(spark, hasher, tmp_path).find_plate(WHO, "बा १ च १२३४", "stolen car inquiry").collect()
    assert [r.id for r in rows] == [3, 1]
    entry = log(spark, tmp_path)
    assert len(entry) == 1 and (entry[0].actor, entry[0].result, entry[0].n_records) == ("ram", "ok", 2)


def test_failed_search_is_still_logged(spark, hasher, tmp_path):
    with pytest.raises(ValueError):
        desk(spark, hasher, tmp_path).find_plate(WHO, "HELLO", "stolen car inquiry")
    with pytest.raises(ValueError):
        desk(spark, hasher, tmp_path).find_partial(WHO, "12", "stolen car inquiry")
    assert {(e.result, e.n_records) for e in log(spark, tmp_path)} == {("invalid_plate", 0), ("fragment_too_short", 0)}


def test_permission_before_purpose(spark, hasher, tmp_path):
    with pytest.raises(gov.PermissionDenied):
        desk(spark, hasher, tmp_path).find_plate(gov.Principal("op", "operator"), "BA 1 CHA 1234", "")
    with pytest.raises(gov.ReasonRequired):
        desk(spark, hasher, tmp_path).find_plate(WHO, "BA 1 CHA 1234", "  short  ")
    with pytest.raises(gov.PermissionDenied):
        desk(spark, hasher, tmp_path).audit_trail(gov.Principal("root", "admin"))
    assert gov.authorise(gov.Principal("op", "operator"), "read.live", None) == "not required for this action"


def test_auditor_reads_the_log(spark, hasher, tmp_path):
    d = desk(spark, hasher, tmp_path)
    d.camera_feed(WHO, NOW, minutes=5)
    trail = d.audit_trail(gov.Principal("eye", "auditor"), actor="ram").collect()
    assert [(r.action, r.target) for r in trail] == [("read.live", "camera=all")]


def test_holds_erasures_and_entries_are_governed(spark, hasher, tmp_path):
    d, admin = desk(spark, hasher, tmp_path), gov.Principal("root", "admin")
    hold = d.hold_for_case(admin, "BA 1 CHA 1234", "court order 12", NOW, days=5).first()
    erasure = d.request_erasure(WHO, "बा १ च १२३४", "subject request 7", NOW).first()
    assert hold.plate_hmac == erasure.plate_hmac and hold.hold_until == NOW + timedelta(days=5)
    assert (erasure.status, erasure.requested_by) == ("pending", "ram")
    requests = spark.createDataFrame([(1, "3 B PA 1234", "stolen", "theft")], "id bigint, plate string, reason string, category string")
    accepted, rejected, past = d.add_to_watchlist(WHO, requests, "stolen car inquiry", NOW)
    assert accepted.count() == 1 and rejected.count() == 0 and sorted(r.read_id for r in past.collect()) == [2, 4]
    with pytest.raises(gov.PermissionDenied):
        d.hold_for_case(WHO, "BA 1 CHA 1234", "court order 12", NOW)
    assert {(e.action, e.n_records) for e in log(spark, tmp_path)} == {("admin.retention", 2), ("erasure.request", None), ("watchlist.write", 1)}


def test_partial_search_is_literal(spark, hasher):
    reads = table(spark, hasher)
    assert Q.partial(reads, "___").count() == 0 and Q.partial(reads, "b-pa").count() == 2


def test_convoy_needs_several_cameras(spark, hasher):
    reads = table(spark, hasher)
    key = reads.filter("id = 1").first().plate_hmac
    got = [tuple(r) for r in Q.convoy(reads, key, window_seconds=30).collect()]
    assert got == [("NP-E:3-B-PA-1234", 2, 2)]
    assert Q.convoy(reads, key, window_seconds=29).count() == 0
    assert Q.convoy(reads, key, window_seconds=30, min_shared=1).count() == 2
    for bad in ({"window_seconds": 5}, {"min_shared": 0}):
        with pytest.raises(ValueError):
            Q.convoy(reads, key, **bad)


def test_statistics_hold_no_plate(spark, hasher):
    reads = table(spark, hasher)
    sessions = spark.createDataFrame([("z", None), ("z", NOW)], "zone_id string, exited_at timestamp")
    open_rows = spark.createDataFrame([(None,), (NOW,)], "reviewed_at timestamp")
    out = Q.statistics(reads, sessions, open_rows, open_rows, NOW + timedelta(hours=2), hours=24)
    assert not any("plate" in c and c != "distinct_plates" for c in out.columns)
    assert tuple(out.first()) == (24, 5, 4, 1, 3, 1, 1, 1)


def test_sweep_and_overdue(spark, hasher):
    reads = table(spark, hasher)
    hits = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, read_id bigint")
    blobs = spark.createDataFrame([("img1", NOW), ("img2", NOW), ("ctx", NOW), ("young", NOW + timedelta(days=5))], "sha256 string, expires_at timestamp")
    tables = {"reads": reads, "hits": hits, "blobs": blobs}
    kept = E.sweep(tables, NOW)
    assert sorted(r.id for r in kept["reads"].collect()) == [1, 3, 4, 5]
    assert [r.id for r in kept["hits"].collect()] == [1]
    assert sorted(r.sha256 for r in kept["blobs"].collect()) == ["ctx", "img1", "young"]
    assert {r.table_name: r.n_deleted for r in E.sweep_counts(tables, NOW).collect()} == {"reads": 1, "hits": 1, "blobs": 1}
    assert {r.table_name: (r.n_overdue, r.healthy) for r in E.overdue({"reads": reads}, NOW).collect()} == {"reads": (1, False)}


def test_legal_hold_moves_the_deadline(spark, hasher):
    reads = table(spark, hasher)
    holds = E.hold_for_case(reads.filter("id = 2"), NOW, days=10)
    got = {r.id: (r.held, r.expires_at) for r in E.with_holds(reads, holds).collect()}
    assert got[2] == (True, NOW + timedelta(days=10)) and got[1][0] is False


def test_erasure(spark, hasher):
    reads = table(spark, hasher)
    key = reads.filter("id = 1").first().plate_hmac
    sessions = spark.createDataFrame([("s", key), ("t", "other")], "session_id string, plate_hmac string")
    requests = spark.createDataFrame([(1, key, "pending", None, None, None)],
                                     "request_id bigint, plate_hmac string, status string, reads_deleted bigint, sessions_deleted bigint, executed_at timestamp")
    tables = {"reads": reads, "sessions": sessions}
    assert sorted(r.id for r in E.erase(tables, requests)["reads"].collect()) == [2, 4, 5]
    report = E.erasure_report(tables, requests, NOW)
    row = report.first()
    assert (row.reads_deleted, row.sessions_deleted, row.status) == (2, 1, "done")
    again = E.erasure_report({"reads": reads.limit(0), "sessions": sessions.limit(0)}, report, NOW + timedelta(days=1)).first()
    assert (again.reads_deleted, again.executed_at) == (2, NOW)


def test_prune_keeps_unsent_and_referenced(spark):
    a, b, c = ("a" * 64), ("b" * 64), ("c" * 64)
    rows = [
        (1, NOW - timedelta(days=30), NOW, '{"plate_image_sha256":"%s"}' % a),
        (2, NOW - timedelta(days=30), None, '{"x":[{"deep":{"context_image_sha256" : "%s"}}],"note":"sha256"}' % b),
        (3, NOW, NOW, '{"sha256":"%s","bad_sha256":"ZZ"}' % c),
    ]
    events = spark.createDataFrame(rows, "sequence bigint, queued_at timestamp, sent_at timestamp, payload string")
    kept = E.prune_events(events, NOW)
    assert sorted(r.sequence for r in kept.collect()) == [2, 3]
    assert sorted(r.sequence for r in E.prune_events(events, NOW, keep_unsent=False).collect()) == [3]
    blobs = spark.createDataFrame([(a,), (b,), (c,)], "sha256 string")
    assert sorted(r.sha256 for r in E.prune_blobs(blobs, kept).collect()) == [b, c]


def test_other_routes_are_permitted_and_logged(spark, hasher, tmp_path):
    d = desk(spark, hasher, tmp_path)
    admin, reader = gov.Principal("sita", "admin"), gov.Principal("hari", "operator")
    d.tables["hits"] = spark.createDataFrame([(1, 3)], "id bigint, read_id bigint")
    d.tables["blobs"] = spark.createDataFrame([("ab" * 32, b"x")], "sha256 string, data binary")
    d.tables["nodes"] = spark.createDataFrame([("n1", "k1")], "node_id string, public_key string")
    assert [(r.hit_id, r.actor) for r in d.acknowledge(reader, 1, "2024-02-01 00:00:00").collect()] == [(1, "hari")]
    assert d.acknowledge(reader, 9, "2024-02-01 00:00:00").count() == 0
    assert d.image(reader, "ab" * 32, "checking a read").count() == 1
    nodes, conflicts = d.enrol(admin, spark.createDataFrame([("n2", "k2"), ("n1", "other")], "node_id string, public_key string"))
    assert sorted(r.node_id for r in nodes.collect()) == ["n1", "n2"] and conflicts.count() == 1
    for refused in (lambda: d.enrol(reader, d.tables["nodes"]), lambda: d.sweep(reader, "nowhere", "2024-02-01 00:00:00"),
                    lambda: d.execute_erasure(reader, "nowhere", None, "2024-02-01 00:00:00")):
        with pytest.raises(gov.PermissionDenied):
            refused()
    entries = log(spark, tmp_path)
    assert sorted(e.action for e in entries) == ["hit.acknowledge", "hit.acknowledge", "node.enrol", "read.image"]
    assert d.compact_log() > 1
    assert sorted(map(str, log(spark, tmp_path))) == sorted(map(str, entries)) and d.compact_log() == 1


def test_long_results_come_whole(spark, hasher, tmp_path):
    sessions = spark.range(1500).select(F.concat(F.lit("Z"), "id").alias("zone_id"), F.lit(None).cast("timestamp").alias("exited_at"))
    d = Q.Investigator(spark, hasher, {"sessions": sessions}, str(tmp_path / "log"))
    rows = d.occupancy(gov.Principal("op", "operator"))
    assert rows.count() == 1500 and rows.distinct().count() == 1500
    assert [e.n_records for e in log(spark, tmp_path)] == [1500]
    assert d.compact_log() > 1 and d.compact_log() == 1
    assert [e.n_records for e in log(spark, tmp_path)] == [1500]
