"""Sources, sinks and the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ... import refdata as R
from ...operators import blobs as B
from ...operators import chain as C
from ...operators import ingest as I
from ...session import shared_dir
from ...sources import config, corpus, events as ev, frames, tables
from .. import adapters as A
from ..adapters import AS_OF
from .registry import hmac_sql, query

_ENVELOPE = """
SELECT node_id || '/' || cast(cast(floor(event_id / 1280) as bigint) as string) AS batch_id, node_id AS batch_node, arrival,
 CASE WHEN event_id % 100 = 99 THEN 'NODE-X' ELSE node_id END AS claimed,
 CASE WHEN event_id % 64 = 5 THEN NULL WHEN event_id % 64 = 6 THEN 'x1' ELSE cast(sequence as string) END AS seq
FROM {deliveries}"""


def _write_envelopes(t) -> str:
    """Deliveries as JSON batches on disk, with one line per batch that is not JSON."""
    rows = t.deliveries.withColumn("batch", F.concat("node_id", F.lit("/"), F.floor(F.col("event_id") / 1280).cast("string")))
    e = F.col("event_id")
    event = F.struct(
        "arrival", F.when(e % 100 == 99, "NODE-X").otherwise(F.col("node_id")).alias("node_id"),
        F.when(e % 64 == 5, None).when(e % 64 == 6, "x1").otherwise(F.col("sequence").cast("string")).alias("sequence"),
        "captured_at", "prev_hash", "payload_hash", "signature", "payload", "signature_ok",
    )
    # A batch covers 1280 consecutive events of 8 nodes: at most 160 events and their re-deliveries.
    envelopes = rows.groupBy("batch", "node_id").agg(
        F.min("arrival").alias("arrival"), F.max("received_at").alias("received_at"), F.array_sort(F.collect_list(event)).alias("events")
    )
    good = envelopes.select(F.to_json(F.struct(F.col("batch").alias("batch_id"), "node_id", "received_at", "arrival", "events")).alias("value"))
    broken = envelopes.select(F.concat(F.lit('{"batch_id": "'), "batch", F.lit('", ')).alias("value"))
    path = shared_dir(t.spark) + "/inbox"
    good.unionByName(broken).write.text(path)
    return path


@query("src1_event_batches", "deliveries", sql=", d AS (" + _ENVELOPE.format(deliveries="deliveries") + """)
SELECT status, count(*) AS n FROM (
 SELECT CASE WHEN seq IS NULL THEN 'malformed event: missing sequence' WHEN seq = 'x1' THEN 'malformed event: bad sequence'
  WHEN claimed <> batch_node THEN 'other node' ELSE 'good' END AS status FROM d
 UNION ALL SELECT 'not json' FROM (SELECT DISTINCT batch_id FROM d) b) s GROUP BY status""")
def _(t):
    raw = ev.read_envelopes(t.spark, _write_envelopes(t))
    judged = ev.unpack(raw).withColumn("error", ev.event_error())
    status = F.when(F.col("error").startswith("event claims"), "other node").otherwise(F.coalesce("error", F.lit("good")))
    corrupt = raw.filter("_corrupt_record is not null and node_id is null").select(F.lit("not json").alias("status"))
    return judged.select(status.alias("status")).unionByName(corrupt).groupBy("status").agg(F.count("*").alias("n"))


@query("src2_active_nodes", "reads", "nodes", sql="""
SELECT r.node_id, CASE WHEN n.node_id IS NULL THEN 'node is not enrolled' WHEN NOT n.active THEN 'node is deactivated' ELSE 'admitted' END AS status, count(*) AS n
FROM (SELECT CASE WHEN id % 50 = 7 THEN 'NODE-unknown' ELSE node_id END AS node_id FROM reads) r LEFT JOIN nodes n ON r.node_id = n.node_id GROUP BY ALL""")
def _(t):
    """One read in fifty comes from a node that nobody enrolled."""
    claimed = F.when(F.col("id") % 50 == 7, "NODE-unknown").otherwise(F.col("node_id"))
    ok, refused = ev.from_active_nodes(t.reads.select(claimed.alias("node_id"), "id"), t.nodes)
    both = ok.select("node_id", F.lit("admitted").alias("status")).unionByName(refused.select("node_id", F.col("error").alias("status")))
    return both.groupBy("node_id", "status").agg(F.count("*").alias("n"))


@query("src3_corpus_index", "corpus", sql="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE i % 50 = 1 OR i % 50 = 2 OR i % 50 = 3) AS n_bad FROM corpus""")
def _(t):
    c = t.corpus
    line = F.to_json(F.struct(
        "path", F.when(F.col("i") % 50 != 2, F.col("canonical")).alias("canonical"), "system",
        F.split("canonical", "-").alias("tokens"), F.when(F.col("i") % 50 == 3, "mauve").otherwise("red_white").alias("colour"),
        "two_row", "width_px", "quality", "track_id", "frame",
    ))
    path = shared_dir(t.spark) + "/index"
    c.select(F.when(F.col("i") % 50 == 1, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    return corpus.bad_rows(t.spark, path)


@query("snk1_sharded_index", "corpus", sql="""
SELECT lpad(cast(cast(floor(i / 1000) as bigint) as string), 5, '0') AS shard, count(*) AS n, count(DISTINCT canonical) AS n_plates FROM corpus GROUP BY 1""")
def _(t):
    path = shared_dir(t.spark) + "/corpus"
    corpus.write_index(t.corpus, path)
    back = t.spark.read.schema(corpus.SCHEMA.replace(", _corrupt_record string", "") + ", shard string").json(path)
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("canonical").alias("n_plates"))


_STILL = "'/stills/' || cast(page_id % 7 as string) || '/' || lpad(cast(page_id * 7919 % 100003 as string), 6, '0') || CASE page_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' ELSE '.jpeg' END"


@query("src4_still_catalogue", sql=f"""
SELECT path, frame_index, TIMESTAMP '{AS_OF}' + to_microseconds(cast(round(frame_index * 1000000 / 15.0) as bigint)) AS ts FROM (
 SELECT path, row_number() OVER (PARTITION BY page_id % 7 ORDER BY path) AS frame_index FROM (SELECT page_id, {_STILL} AS path FROM pages) a
 WHERE path NOT LIKE '%.txt') b""")
def _(t):
    files = t.pages.select(F.expr(_STILL).alias("path"))
    return frames.number_stills(files, AS_OF).select("path", "frame_index", "ts")


@query("src5_stride", "track_frames", sql="""
SELECT camera_id, frame_index FROM track_frames WHERE frame_index % 3 = 0 GROUP BY ALL""")
def _(t):
    return frames.every_nth(t.frames.select("camera_id", "frame_index").distinct(), 3)


@query("src5_thinning", "track_frames", recursive=True, sql="""
, f AS (SELECT DISTINCT camera_id, ts FROM track_frames), kept AS (SELECT camera_id, min(ts) AS ts FROM f GROUP BY camera_id
 UNION ALL SELECT camera_id, ts FROM (SELECT k.camera_id, min(f.ts) AS ts FROM kept k JOIN f ON f.camera_id = k.camera_id AND f.ts >= k.ts + INTERVAL 1000 SECONDS GROUP BY k.camera_id) n)
SELECT camera_id, ts FROM kept""")
def _(t):
    seen = t.frames.select("camera_id", "frame_index", "ts").distinct()
    # Driver frames are minutes apart, so a block spans days instead of minutes.
    return frames.thinned(seen, 0.001, block_seconds=200_000).select("camera_id", "ts")


@query("src6_zone_definitions", sql="""
SELECT 'Z' || cast(s_suppkey as string) AS zone_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Z' || cast(s_suppkey as string) END AS name,
 cast(3 + s_suppkey % 3 as int) AS n_points, CASE WHEN s_suppkey % 4 = 0 THEN 60.0::DOUBLE ELSE 21600.0::DOUBLE END AS max_dwell_seconds,
 CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END AS enter_frames, CASE WHEN s_suppkey % 5 = 0 THEN 9 ELSE 5 END AS exit_frames FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    point = lambda i: F.array(i.cast("double"), (i * i).cast("double"))
    raw = t.supplier.select(
        F.concat(F.lit("Z"), k.cast("string")).alias("zone_id"), F.lit("CAM").alias("camera_id"),
        F.when(k % 2 == 0, F.col("s_name")).alias("name"),
        F.transform(F.sequence(F.lit(1).cast("bigint"), 3 + k % 3), point).alias("polygon"),
        F.when(k % 4 == 0, 60.0).alias("max_dwell_seconds"), F.when(k % 3 == 0, 2).alias("enter_frames"),
        F.when(k % 5 == 0, 9).alias("exit_frames"),
    )
    return config.zones(raw).select("zone_id", "name", F.size("polygon").alias("n_points"), "max_dwell_seconds", "enter_frames", "exit_frames")


@query("src7_config_problems", sql="""
SELECT problem, count(*) AS n FROM (
 SELECT 'edge_retention_days must be at least 1' AS problem FROM (SELECT floor(c_custkey / 10) AS g FROM customer GROUP BY 1) a WHERE g % 4 = 0
 UNION ALL SELECT 'missing source' FROM customer WHERE c_custkey % 11 = 0
 UNION ALL SELECT 'duplicate camera_id' FROM (SELECT floor(c_custkey / 10), c_custkey % 9 FROM customer GROUP BY ALL HAVING count(*) > 1) b) p GROUP BY problem""")
def _(t):
    k = F.col("c_custkey")
    group = F.floor(k / 10).cast("bigint")
    camera = F.struct(
        (k % 9).cast("string").alias("camera_id"), F.when(k % 11 != 0, F.col("c_name")).alias("source"),
        F.lit(None).cast("string").alias("site_id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("double").alias("target_fps"), F.lit(None).cast("string").alias("mounting_notes"),
    )
    nodes = t.customer.groupBy(group.alias("g")).agg(F.collect_list(camera).alias("cameras")).select(  # ten cameras a node
        F.col("g").cast("string").alias("node_id"), F.lit("s").alias("site_id"),
        F.when(F.col("g") % 4 == 0, 0).alias("edge_retention_days"), "cameras",
    )
    kind = F.when(F.col("problem").startswith("duplicate"), "duplicate camera_id").otherwise(F.col("problem"))
    return config.problems(nodes).groupBy(kind.alias("problem")).agg(F.count("*").alias("n"))


@query("snk2_reads_layout", "reads", sql="""
SELECT cast(cast(captured_at as date) as string) AS capture_date, count(*) AS n_reads, count(DISTINCT camera_id) AS n_cameras,
 min(captured_at) AS first_at, max(captured_at) AS last_at, 0 AS n_misfiled, 0 AS n_unsorted FROM reads GROUP BY 1""")
def _(t):
    """Rows per day, and how many lie in another day's folder or out of order in their file."""
    path = shared_dir(t.spark) + "/reads"
    stored = t.keyed("reads")
    tables.write_reads(stored, path)
    back = tables.read_reads(t.spark, path).select("*", "_metadata.file_path", "_metadata.row_index")
    before = F.lag(F.struct("camera_id", "captured_at")).over(Window.partitionBy("file_path").orderBy("row_index"))
    back = back.withColumn("before", before)
    unsorted = (F.col("before.camera_id") > F.col("camera_id")) | (
        (F.col("before.camera_id") == F.col("camera_id")) & (F.col("before.captured_at") < F.col("captured_at")))
    return back.groupBy(F.col("capture_date").cast("string").alias("capture_date")).agg(
        F.count("*").alias("n_reads"), F.count_distinct("camera_id").alias("n_cameras"),
        F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"),
        F.count_if(F.col("capture_date") != F.to_date("captured_at")).cast("int").alias("n_misfiled"),
        F.count_if(unsorted).cast("int").alias("n_unsorted"))


@query("snk3_store_blobs", sql="""
, u AS (SELECT sha256(text) AS actual, CASE WHEN doc_id % 10 = 0 THEN sha256('other') ELSE sha256(text) END AS claimed, octet_length(encode(text)) AS bytes FROM documents)
SELECT DISTINCT 'stored' AS status, claimed AS sha256, cast(bytes as bigint) AS bytes FROM u WHERE claimed = actual
UNION ALL SELECT 'digest mismatch', claimed, count(*) FROM u WHERE claimed <> actual GROUP BY claimed""".lstrip().replace(", u AS", "WITH u AS", 1))
def _(t):
    text = F.encode("text", "UTF-8")
    uploads = t.documents.select(
        F.when(F.col("doc_id") % 10 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2(text, 256)).alias("sha256"),
        F.base64(text).alias("data"), F.lit("text/plain").alias("content_type"),
    )
    new, bad = B.checked(uploads, AS_OF)
    rejected = bad.groupBy("sha256").agg(F.count("*").alias("bytes")).select(F.lit("digest mismatch").alias("status"), "sha256", "bytes")
    return new.select(F.lit("stored").alias("status"), "sha256", "bytes").unionByName(rejected)


@query("snk4_known_digests", "reads", "blobs", sql=f"""
, stored AS (SELECT sha256 FROM blobs WHERE expires_at > TIMESTAMP '2024-04-15 00:00:00'),
wanted AS (SELECT plate_image_sha256 AS sha256 FROM reads UNION SELECT context_image_sha256 FROM reads WHERE context_image_sha256 IS NOT NULL)
SELECT sha256, CASE WHEN sha256 IN (SELECT sha256 FROM stored) THEN 'have' ELSE 'missing' END AS status FROM wanted""")
def _(t):
    from ...operators.retention import image_refs

    stored = t.blobs.filter("expires_at > timestamp'2024-04-15 00:00:00'")
    wanted = image_refs(t.reads)
    return B.have(wanted, stored).withColumn("status", F.lit("have")).unionByName(
        B.missing(wanted, stored).withColumn("status", F.lit("missing")))


@query("snk5_content_addressed", sql="""
SELECT sha256(text) AS sha256, count(*) AS refs, cast(max(octet_length(encode(text))) as bigint) AS bytes FROM documents GROUP BY 1""")
def _(t):
    return B.addressed(t.documents, "text")


_STORED = "captured_at < '2024-01-05'"


@query("ing1_new_events", "deliveries", "signed_events", sql=f"""
SELECT node_id, sequence, min(arrival) AS arrival FROM deliveries WHERE (node_id, sequence) NOT IN
 (SELECT (node_id, sequence) FROM signed_events WHERE {_STORED}) GROUP BY node_id, sequence""")
def _(t):
    return I.new_events(t.deliveries, t.signed_events.filter(_STORED)).select("node_id", "sequence", "arrival")


@query("ing2_payload_hash", "signed_events", sql="""
SELECT node_id, sequence, sha256(payload) = payload_hash AS payload_hash_ok FROM signed_events""")
def _(t):
    return C.with_verdict(t.signed_events).select("node_id", "sequence", "payload_hash_ok")


_LINK = A.DUCK.link(
    "'{\"captured_at\":\"' || captured_at || '\",\"node_id\":\"' || node_id || '\",\"payload_hash\":\"' || payload_hash"
    " || '\",\"prev_hash\":\"' || prev_hash || '\",\"sequence\":' || cast(sequence as string) || '}'", "signature")


@query("ing3_link_hash", "signed_events", sql=f"SELECT node_id, sequence, {_LINK} AS link_hash FROM signed_events")
def _(t):
    return t.signed_events.select("node_id", "sequence", C.link_hash().alias("link_hash"))


def _breaks(source: str, start: str) -> str:
    return f""", linked AS (SELECT *, {_LINK} AS link, sha256(payload) = payload_hash AND signature_ok AS verified FROM {source}),
steps AS (SELECT *, lag(sequence) OVER w AS ps, lag(link) OVER w AS pl FROM linked WINDOW w AS (PARTITION BY node_id ORDER BY sequence)),
breaks AS (SELECT node_id, sequence, CASE WHEN ps IS NOT NULL AND sequence <> ps + 1 THEN 'sequence gap at ' || sequence || ' (expected ' || (ps + 1) || ')'
 WHEN NOT verified OR prev_hash <> CASE WHEN ps IS NULL THEN {start} ELSE pl END THEN 'verification failed at sequence ' || sequence END AS reason FROM steps)
"""


_VERDICT = """SELECT s.node_id, count(*) AS n_events, min(s.sequence) AS first_sequence, max(s.sequence) AS last_sequence,
 count(b.reason) = 0 AS ok, arg_min(b.reason, CASE WHEN b.reason IS NOT NULL THEN s.sequence END) AS reason
FROM steps s JOIN breaks b USING (node_id, sequence) GROUP BY s.node_id"""


@query("ing4_chain_breaks", "signed_events", sql=_breaks("signed_events", f"'{R.GENESIS}'") + "SELECT * FROM breaks WHERE reason IS NOT NULL")
def _(t):
    return C.chain_breaks(t.signed_events)


@query("ing4_chain_verdict", "signed_events", sql=_breaks("signed_events", f"'{R.GENESIS}'") + _VERDICT)
def _(t):
    return C.verify_chains(t.signed_events)


@query("ing5_pruned_chain", "signed_events",
       sql=", kept AS (SELECT * FROM signed_events WHERE captured_at >= '2024-01-10')" + _breaks("kept", "prev_hash") + _VERDICT)
def _(t):
    return C.verify_chains(t.signed_events.filter("captured_at >= '2024-01-10'"), start=None)


@query("ing6_verified", "signed_events", sql="""
SELECT node_id, sha256(payload) = payload_hash AND signature_ok AS verified, count(*) AS n FROM signed_events GROUP BY ALL""")
def _(t):
    return C.with_verdict(t.signed_events).groupBy("node_id", "verified").agg(F.count("*").alias("n"))


@query("ing7_arrival_gaps", "deliveries", sql="""
SELECT node_id, arrival, head + 1 AS expected, sequence AS received, sequence - head - 1 AS missing FROM (
 SELECT *, coalesce(max(sequence) OVER (PARTITION BY node_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head
 FROM deliveries) t WHERE sequence > head + 1""")
def _(t):
    return C.arrival_gaps(t.deliveries)


@query("ing8_node_heads", "signed_events", sql=f"""
SELECT node_id, max(sequence) AS chain_sequence, arg_max({_LINK}, sequence) AS chain_head, max(received_at) AS last_seen_at FROM signed_events GROUP BY node_id""")
def _(t):
    return C.node_heads(t.signed_events)


_ENROL = "SELECT 'CAM-' || event_type AS node_id, CASE WHEN event_type = 'view' THEN 'OTHER' ELSE 'KEY-' || event_type END AS public_key FROM events GROUP BY event_type UNION ALL SELECT 'NEW-' || event_type AS node_id, 'KEY-' || event_type AS public_key FROM events GROUP BY event_type"


@query("ing9_enrolment", "nodes", sql=f"""
, rec AS ({_ENROL}), j AS (SELECT rec.*, n.public_key AS stored FROM rec LEFT JOIN nodes n USING (node_id))
SELECT node_id, public_key, 'enrolled' AS status FROM nodes UNION ALL SELECT node_id, public_key, 'enrolled' FROM j WHERE stored IS NULL
UNION ALL SELECT node_id, public_key, 'conflict' FROM j WHERE stored <> public_key""")
def _(t):
    nodes, conflicts = I.enrol(t.spark.sql(_ENROL.replace("FROM events", "FROM {events}"), events=t.events), t.nodes)
    return nodes.select("node_id", "public_key", F.lit("enrolled").alias("status")).unionByName(
        conflicts.select("node_id", "public_key", F.lit("conflict").alias("status")))


@query("ing10_routing", "signed_events", sql=f"""
SELECT kind, CASE WHEN kind IN ({', '.join(repr(k) for k in R.EVENT_KINDS)}) THEN '' ELSE 'unknown event kind ''' || kind || '''' END AS error, count(*) AS n
FROM (SELECT json_extract_string(payload, '$.kind') AS kind FROM signed_events) t GROUP BY ALL""")
def _(t):
    known, rejected = I.routed(t.signed_events)
    bad = rejected.select(F.regexp_extract("error", "'(.*)'", 1).alias("kind"), "error")
    return known.select("kind", F.lit("").alias("error")).unionByName(bad).groupBy("kind", "error").agg(F.count("*").alias("n"))


def _verified(t):
    return C.with_verdict(t.signed_events)


_READ_SQL = """, p AS (SELECT node_id, sequence, event_id, payload, cast(captured_at as timestamp) AS captured_at, sha256(payload) = payload_hash AND signature_ok AS verified,
 json_extract_string(payload, '$.kind') AS kind FROM signed_events),
stored AS (SELECT node_id, sequence, captured_at, verified, json_extract_string(payload, '$.camera_id') AS camera_id, cast(json_extract_string(payload, '$.track_id') as bigint) AS track_id,
 json_extract_string(payload, '$.plate') AS plate_canonical, json_extract_string(payload, '$.confidence') AS confidence, cast(json_extract_string(payload, '$.score') as double) AS score,
 cast(json_extract_string(payload, '$.n_frames') as int) AS n_frames, json_extract_string(payload, '$.provisional') = 'true' AS provisional FROM p
 WHERE kind = 'plate_read' AND json_extract_string(payload, '$.plate') <> '')
"""


@query("ing11_reads", "signed_events", sql=_READ_SQL + f"""
SELECT *, captured_at + to_days(365) AS expires_at, {hmac_sql('plate_canonical')} AS plate_hmac FROM stored""")
def _(t):
    return I.project_reads(_verified(t), t.hasher).select(
        "node_id", "sequence", "captured_at", "verified", "camera_id", "track_id", "plate_canonical", "confidence", "score",
        "n_frames", "provisional", "expires_at", "plate_hmac")


@query("ing11_reads_rejected", "signed_events", sql=_READ_SQL + """
SELECT node_id, sequence, 'read has no plate' AS error FROM p WHERE kind = 'plate_read' AND json_extract_string(payload, '$.plate') = ''""")
def _(t):
    return I.reads_without_plate(t.signed_events)


@query("ing12_superseded", "signed_events", sql=_READ_SQL + """
SELECT node_id, sequence, provisional, CASE WHEN provisional THEN (SELECT min(f.sequence) FROM stored f WHERE f.node_id = s.node_id AND f.track_id = s.track_id
 AND NOT f.provisional AND f.sequence > s.sequence) END AS superseded_by FROM stored s""")
def _(t):
    reads = I.project_reads(_verified(t), t.hasher)
    return I.with_superseded(reads).select("node_id", "sequence", "provisional", "superseded_by")


@query("ing13_review_items", "signed_events", sql=_READ_SQL + """
SELECT node_id, sequence, captured_at AS queued_at, 'confidence_' || confidence AS reason, plate_canonical AS machine_plate FROM stored
WHERE NOT provisional AND confidence <> 'high'""")
def _(t):
    return I.review_items(I.project_reads(_verified(t), t.hasher))


_SESSION_SQL = _READ_SQL + f""",
z AS (SELECT node_id, sequence, verified, kind, json_extract_string(payload, '$.session_id') AS session_id, json_extract_string(payload, '$.zone_id') AS zone_id,
 cast(json_extract_string(payload, '$.entered_at') as timestamp) AS entered, cast(json_extract_string(payload, '$.exited_at') as timestamp) AS exited,
 cast(json_extract_string(payload, '$.dwell_seconds') as double) AS dwell, json_extract_string(payload, '$.close_reason') AS why FROM p WHERE kind IN ('zone_entry', 'zone_exit')),
f AS (SELECT session_id, arg_min(node_id, sequence) AS node_id, arg_min(zone_id, sequence) AS zone_id, arg_min(entered, sequence) AS entered_at,
 max(exited) AS exited_at, max(dwell) AS dwell_seconds, max(why) AS close_reason, bool_and(verified) AS verified FROM z GROUP BY session_id),
late AS (SELECT 'S' || cast(cast(floor(event_id / 10) as bigint) as string) AS session_id, json_extract_string(payload, '$.plate') AS plate FROM p WHERE kind = 'session_plate')
SELECT f.session_id, zone_id, node_id, entered_at, exited_at, dwell_seconds, close_reason, plate AS plate_canonical, {hmac_sql('plate')} AS plate_hmac,
 entered_at + to_days(365) AS expires_at, verified FROM f LEFT JOIN late USING (session_id)"""


@query("ing14_15_sessions", "signed_events", sql=_SESSION_SQL)
def _(t):
    return I.zone_sessions(_verified(t), t.hasher).drop("camera_id", "track_id")


@query("ing16_unreadable", "signed_events", sql=_READ_SQL + """
SELECT node_id, sequence, json_extract_string(payload, '$.camera_id') AS camera_id, captured_at, cast(json_extract_string(payload, '$.n_crops') as int) AS n_crops,
 cast(json_extract_string(payload, '$.best_crop_quality') as double) AS best_crop_quality, captured_at + to_days(90) AS expires_at FROM p WHERE kind = 'unreadable_passage'""")
def _(t):
    return I.unreadable_passages(t.signed_events)


_RECEIPT = """
, g AS (SELECT *, coalesce(max(sequence) OVER (PARTITION BY node_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head,
 row_number() OVER (PARTITION BY node_id, sequence ORDER BY arrival) > 1 AS duplicate, sha256(payload) = payload_hash AND signature_ok AS verified,
 json_extract_string(payload, '$.kind') AS kind FROM deliveries),
receipt AS (SELECT batch_id, node_id, sequence, arrival, true AS accepted, duplicate, NOT duplicate AND NOT verified AS unverified,
 CASE WHEN NOT duplicate AND sequence > head + 1 THEN head + 1 END AS gap_expected, CASE WHEN NOT duplicate AND sequence > head + 1 THEN sequence - head - 1 END AS gap_missing,
 CASE WHEN duplicate THEN NULL WHEN kind = 'heartbeat' THEN 'unknown event kind ''heartbeat''' WHEN kind = 'plate_read' AND json_extract_string(payload, '$.plate') = '' THEN 'read has no plate' END AS error FROM g)
"""


@query("ing17_receipt", "deliveries", sql=_RECEIPT + "SELECT * FROM receipt")
def _(t):
    return I.receipt(C.with_verdict(t.deliveries))


@query("ing17_receipt_counts", "deliveries", sql=_RECEIPT + """
SELECT batch_id, count(*) AS accepted, count(*) FILTER (WHERE duplicate) AS duplicates, count(*) FILTER (WHERE unverified) AS unverified,
 count(error) AS rejected, count(gap_missing) AS gaps, cast(coalesce(sum(gap_missing), 0) as bigint) AS missing FROM receipt GROUP BY batch_id""")
def _(t):
    return I.receipt_counts(I.receipt(C.with_verdict(t.deliveries)))


@query("ing18_backlog", "queue", sql="""
SELECT node_id, count(*) AS total, count(*) FILTER (WHERE sent_at IS NULL) AS unsent, arg_min(captured_at, sequence) FILTER (WHERE sent_at IS NULL) AS oldest_unsent,
 cast(sum(octet_length(encode(payload))) as bigint) AS payload_bytes, cast(sum(attempts) as bigint) AS attempts FROM queue GROUP BY node_id""")
def _(t):
    return I.backlog(t.queue)


@query("ing18_pending_page", "queue", sql="""
SELECT node_id, sequence FROM queue WHERE sent_at IS NULL AND node_id = 'NODE-3' ORDER BY sequence LIMIT 256""")
def _(t):
    return I.pending(t.queue.filter("node_id = 'NODE-3'").select("node_id", "sequence", "sent_at")).select("node_id", "sequence")
