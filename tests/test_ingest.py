import base64
import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from wayledger import refdata as R
from wayledger.operators import chain as C
from wayledger.operators import ingest as I

EVENT = ("node_id string, sequence bigint, captured_at string, prev_hash string, payload_hash string, signature string,"
         " payload string, signature_ok boolean, arrival bigint, received_at timestamp, batch_id string")
T0 = datetime(2024, 1, 1)


def canonical(d):
    return json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def chain(payloads, node="N1", start=1):
    """A well-linked log, hashed here independently of the operators."""
    rows, head = [], R.GENESIS
    for i, p in enumerate(payloads):
        body = canonical(p)
        header = {"node_id": node, "sequence": start + i, "captured_at": f"2024-01-01T00:{i:02d}:00Z", "prev_hash": head,
                  "payload_hash": hashlib.sha256(body.encode()).hexdigest()}
        signature = base64.b64encode(f"sig{i}".encode()).decode()
        head = hashlib.sha256(canonical(header).encode() + base64.b64decode(signature)).hexdigest()
        rows.append([node, start + i, header["captured_at"], header["prev_hash"], header["payload_hash"], signature, body, True, i, T0, "b"])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], EVENT)


def read(plate="NP-L:BA-1-CHA-1234", **extra):
    return {"kind": "plate_read", "camera_id": "CAM", "plate": plate, "confidence": "high", "track_id": 7, **extra}


def test_intact_chain_verifies(spark):
    rows = chain([read(note="बा \"quoted\"")] * 5, node='N"1')
    v = C.verify_chains(frame(spark, rows)).first()
    assert v.ok and (v.n_events, v.first_sequence, v.last_sequence) == (5, 1, 5)


def test_altered_event_is_named(spark):
    rows = chain([read()] * 6)
    rows[3][6] = rows[3][6].replace("1234", "9999")
    v = C.verify_chains(frame(spark, rows)).first()
    assert not v.ok and v.reason == "verification failed at sequence 4"


def test_removed_event_is_a_gap(spark):
    rows = chain([read()] * 6)
    del rows[2]
    assert C.verify_chains(frame(spark, rows)).first().reason == "sequence gap at 4 (expected 3)"


def test_pruned_chain_verifies_from_its_first_link(spark):
    rows = chain([read()] * 6)[2:]
    assert C.verify_chains(frame(spark, rows), start=None).first().ok
    assert C.verify_chains(frame(spark, rows)).first().reason == "verification failed at sequence 3"


def test_tampered_read_is_stored_unverified(spark, hasher):
    rows = chain([read()])
    rows[0][6] = rows[0][6].replace("1234", "9999")
    r = I.project_reads(C.with_verdict(frame(spark, rows)), hasher).first()
    assert r.plate_canonical.endswith("9999") and r.verified is False


def test_missing_signature_verdict_fails_closed(spark):
    rows = chain([read()])
    rows[0][7] = None
    assert C.with_verdict(frame(spark, rows)).first().verified is False


def test_resending_changes_nothing(spark):
    rows = chain([read()] * 3)
    again = [r[:8] + [100 + i, T0, "again"] for i, r in enumerate(rows)]
    both = frame(spark, rows + again)
    assert I.new_events(both).count() == 3
    assert I.new_events(both, frame(spark, rows[:2])).select("sequence").collect()[0].sequence == 3
    receipt = I.receipt(C.with_verdict(both))
    counts = {r.batch_id: (r.accepted, r.duplicates) for r in I.receipt_counts(receipt).collect()}
    assert counts == {"b": (3, 0), "again": (3, 3)}


def test_gap_reports_missing_events(spark):
    rows = [r for r in chain([read()] * 5) if r[1] not in (3, 4)]
    gap = C.arrival_gaps(frame(spark, rows)).first()
    assert (gap.expected, gap.received, gap.missing) == (3, 5, 2)
    heads = spark.createDataFrame([("N1", 9)], "node_id string, chain_sequence bigint")
    assert C.arrival_gaps(frame(spark, rows), heads).count() == 0


def test_defaults_of_a_bare_read(spark, hasher):
    rows = chain([{"kind": "plate_read", "plate": "NP-E:3-B-PA-1234"}, {"kind": "plate_read"}, {"kind": "party"}])
    events = C.with_verdict(frame(spark, rows))
    nodes = spark.createDataFrame([("N1", None, "SITE")], "node_id string, camera_id string, site_id string")
    r = I.project_reads(events, hasher, nodes=nodes).collect()
    assert len(r) == 1 and (r[0].camera_id, r[0].site_id, r[0].confidence, r[0].provisional) == ("N1", "SITE", "reject", False)
    assert (r[0].expires_at - r[0].captured_at).days == 365
    assert I.reads_without_plate(events).first().sequence == 2
    assert I.routed(events)[1].first().error == "unknown event kind 'party'"


def test_final_read_supersedes_provisional(spark, hasher):
    rows = chain([read(provisional=True), read(provisional=True, track_id=8), read(), read(provisional=True), read()])
    got = {r.sequence: r.superseded_by for r in I.with_superseded(I.project_reads(C.with_verdict(frame(spark, rows)), hasher)).collect()}
    assert got == {1: 3, 2: None, 3: None, 4: 5, 5: None}


def test_low_bands_go_to_review(spark, hasher):
    rows = chain([read(confidence="medium"), read(), read(confidence="low", provisional=True), read(confidence="odd")])
    got = [(r.sequence, r.reason) for r in I.review_items(I.project_reads(C.with_verdict(frame(spark, rows)), hasher)).orderBy("sequence").collect()]
    assert got == [(1, "confidence_medium"), (4, "confidence_odd")]


ENTRY = {"kind": "zone_entry", "camera_id": "CAM", "zone_id": "Z", "session_id": "S1", "track_id": 7, "entered_at": "2024-01-01T10:00:00Z"}
EXIT = {**ENTRY, "kind": "zone_exit", "exited_at": "2024-01-01T10:04:00Z", "dwell_seconds": 240.0, "close_reason": "exited"}
BACK = {"kind": "session_plate", "plate": "NP-L:BA-1-CHA-1234", "sessions": ["S1", "S9"]}


def test_session_fold_and_plate_backfill(spark, hasher):
    for order in ([ENTRY, EXIT, BACK], [BACK, ENTRY, EXIT]):
        s = I.zone_sessions(C.with_verdict(frame(spark, chain(order))), hasher).collect()
        assert len(s) == 1
        assert (s[0].dwell_seconds, s[0].close_reason, s[0].plate_canonical) == (240.0, "exited", "NP-L:BA-1-CHA-1234")
        assert s[0].exited_at == datetime(2024, 1, 1, 10, 4)


def test_open_session_has_no_exit(spark, hasher):
    s = I.zone_sessions(C.with_verdict(frame(spark, chain([ENTRY]))), hasher).first()
    assert s.exited_at is None and s.plate_hmac is None


def test_enrolment_never_overwrites_a_key(spark):
    nodes = spark.createDataFrame([("A", "k1")], "node_id string, public_key string")
    records = spark.createDataFrame([("A", "k2"), ("A", "k1"), ("B", "k3")], "node_id string, public_key string")
    stored, conflicts = I.enrol(records, nodes)
    assert sorted((r.node_id, r.public_key) for r in stored.collect()) == [("A", "k1"), ("B", "k3")]
    assert [(r.node_id, r.public_key) for r in conflicts.collect()] == [("A", "k2")]
