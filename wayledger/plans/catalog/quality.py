"""Accuracy reports, corpus analytics, and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import refdata as R
from ...functions import ctc
from ...functions.once import once
from ...operators import evaluation as E
from ...operators import fusion as U
from ...operators import runs
from ...operators import zones as Z
from ...session import file_system, shared_dir, shuffles_dropped
from ...sources.tables import SCHEMAS
from ...streaming import job, live, sessions, verification
from .. import adapters as A
from . import intake, vision
from .registry import hmac_sql, query, values_sql

_WIDTH = "CASE WHEN width_px < 40 THEN '0-40px' WHEN width_px < 60 THEN '40-60px' WHEN width_px < 90 THEN '60-90px' WHEN width_px < 130 THEN '90-130px' ELSE '130px+' END"
_QUALITY = "CASE WHEN quality >= 0.7 THEN 'clean' WHEN quality >= 0.4 THEN 'moderate' ELSE 'degraded' END"


@query("evl1_2_strata", "eval_samples", sql=f"""
SELECT stratum, count(*) AS n, round(avg(cast(greedy_ok as int)), 9) AS greedy, round(avg(cast(grammar_ok as int)), 9) AS grammar, round(avg(cast(colour_ok as int)), 9) AS colour FROM (
 SELECT *, unnest(['ALL', 'system:' || system, 'width:' || {_WIDTH}, 'quality:' || {_QUALITY}, 'layout:' || CASE WHEN two_row THEN 'two-row' ELSE 'single-row' END]) AS stratum FROM eval_samples) t GROUP BY stratum""")
def _(t):
    out = E.stratified_accuracy(t.eval_samples)
    return out.select("stratum", "n", *[F.round(c, 9).alias(c) for c in ("greedy", "grammar", "colour")])


@query("evl3_calibration", "eval_samples", sql="""
SELECT confidence, count(*) AS n, round(avg(cast(colour_ok as int)), 9) AS accuracy, round(1 - avg(cast(colour_ok as int)), 9) AS error_rate FROM eval_samples GROUP BY confidence""")
def _(t):
    return E.calibration(t.eval_samples).withColumn("accuracy", F.round("accuracy", 9)).withColumn("error_rate", F.round("error_rate", 9))


_TRUTH = A.key("cast(substr(track_id, 2) as bigint)")
_CHARS = "replace(substr({}, 6), '-', '')"


def _token_rows(t):
    """First-ranked decodings of every frame as characters, next to the track's own plate."""
    rows = t.candidates.filter("rank = 0").withColumn("plate", F.expr(_TRUTH))
    chars = lambda c: F.split(F.expr(_CHARS.format(c)), "")
    return rows.select("track_id", "frame", "quality", "score", "plate", "canonical", chars("plate").alias("truth"), chars("canonical").alias("predicted"))


@query("evl4_greedy_metrics", "candidates", sql=f"""
SELECT round(avg(cast(a = b as int)), 9) AS exact_match, round(sum(levenshtein(a, b)) / sum(length(a)), 9) AS token_error_rate, round(avg(cast(frame % 3 = frame % 4 as int)), 9) AS colour_accuracy,
 round(avg(abs(quality - score)), 8) AS quality_mae, count(*) AS n FROM (SELECT *, {_CHARS.format(_TRUTH)} AS a, {_CHARS.format('canonical')} AS b FROM candidates WHERE rank = 0) t""")
def _(t):
    rows = _token_rows(t).withColumn("colour", F.col("frame") % 3).withColumn("predicted_colour", F.col("frame") % 4).withColumn("predicted_quality", F.col("score"))
    m = E.greedy_metrics(rows)
    return m.select(*[F.round(c, 9).alias(c) for c in ("exact_match", "token_error_rate", "colour_accuracy")], F.round("quality_mae", 8).alias("quality_mae"), "n")


@query("evl5_edit_distance", "candidates", sql=f"""
SELECT track_id, frame, levenshtein({_CHARS.format(_TRUTH)}, {_CHARS.format('canonical')}) AS distance FROM candidates WHERE rank = 0""")
def _(t):
    return _token_rows(t).select("track_id", "frame", ctc.token_edit_distance(F.col("predicted"), F.col("truth")).cast("bigint").alias("distance"))


@query("evl6_track_fusion", "candidates", sql=vision.FUSED_SQL + f"""
, per AS (SELECT track_id, max(cast(canonical = {_TRUTH} as int)) AS any_ok, arg_min(cast(canonical = {_TRUTH} as int), frame) AS first_ok FROM candidates WHERE rank = 0 GROUP BY track_id)
SELECT count(*) AS n_tracks, round(avg(cast(f.canonical = {_TRUTH} as int)), 9) AS fused, round(avg(any_ok), 9) AS oracle_best_frame, round(avg(first_ok), 9) AS first_frame FROM per JOIN fused f USING (track_id)""")
def _(t):
    rows = _token_rows(t).select("track_id", "frame", F.col("plate").alias("truth"), (F.col("plate") == F.col("canonical")).alias("ok"))
    out = E.track_report(rows, U.fuse(t.candidate_rows))
    return out.select("n_tracks", *[F.round(c, 9).alias(c) for c in ("fused", "oracle_best_frame", "first_frame")])


_HASH = "cast('0x' || substr(md5('{seed}:' || {key}), 1, 12) as bigint) / 281474976710656.0"


@query("evl7_split", "corpus", sql=f"""
, units AS (SELECT DISTINCT track_id FROM corpus), ranked AS (SELECT track_id, row_number() OVER (ORDER BY {_HASH.format(seed=3, key='track_id')}, track_id) AS r, count(*) OVER () AS n FROM units)
SELECT path, CASE WHEN r <= greatest(1, floor(n * 0.05)) THEN 'val' ELSE 'train' END AS split FROM corpus JOIN ranked USING (track_id)""")
def _(t):
    return E.split_corpus(t.corpus, 0.05, seed=3).select("path", "split")


@query("evl8_tracks_in_order", "corpus", sql="SELECT track_id, frame, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS position FROM corpus")
def _(t):
    return E.tracks_in_order(t.corpus, ["track_id"]).select("track_id", "frame", "position")


@query("evl9_legality", "candidates", sql=f"""
SELECT CASE WHEN a = b THEN 'correct' WHEN regexp_matches(b, '^[1-7](A|B|C1?|D|E|F|G|H[12]?|I[1-3]?|J[1-5]?|K)[A-Z][A-Z][0-9]{{1,4}}$') THEN 'wrong_legal' ELSE 'not_a_plate' END AS outcome, count(*) AS n
FROM (SELECT {_CHARS.format(_TRUTH)} AS a, {_CHARS.format('canonical')} AS b FROM candidates WHERE rank = 0) t GROUP BY 1""")
def _(t):
    return E.legality(_token_rows(t))


_GRID = values_sql([("NP-L", z[1], c[1]) for z in R.ZONES for c in R.CLASSES]
                   + [("NP-E", str(p), c) for p, _ in R.PROVINCES for c in R.EMBOSSED_SIZE if c != "J"], "system", "region", "vehicle_class")


@query("evl10_missing_structures", "corpus", sql=f"""
, have AS (SELECT substr(canonical, 1, 4) AS system, split_part(substr(canonical, 6), '-', 1) AS region, split_part(substr(canonical, 6), '-', CASE WHEN system = 'embossed' THEN 2 ELSE 3 END) AS vehicle_class FROM corpus)
SELECT * FROM {_GRID} WHERE (system, region, vehicle_class) NOT IN (SELECT (system, region, vehicle_class) FROM have)""")
def _(t):
    return E.missing_structures(t.corpus)


_ZW = values_sql(list(R.ZONE_WEIGHTS.items()), "zone", "zw")
_CW = values_sql(list(R.CLASS_WEIGHTS.items()), "class", "cw")


@query("evl11_reweighted", "corpus", sql=f"""
, w AS (SELECT path, canonical, {_HASH.format(seed=5, key='path')} AS u, zw * cw AS weight FROM corpus JOIN (SELECT * FROM {_ZW}) z ON canonical LIKE 'NP-L:%' AND split_part(substr(canonical, 6), '-', 1) = z.zone
 JOIN (SELECT * FROM {_CW}) c ON split_part(substr(canonical, 6), '-', 3) = c.class)
SELECT path, canonical FROM w ORDER BY -ln(greatest(u, 1e-15)) / weight, path LIMIT 500""")
def _(t):
    return E.reweighted(t.corpus, 500, "path", seed=5).select("path", "canonical")


@query("evl12_manifest", "corpus", sql="""
SELECT count(*) AS count, count(DISTINCT track_id) AS tracks, count(frame) AS frames, count(*) FILTER (WHERE grid_seeded) AS grid_seeded, bool_and(font_authentic) AS fonts_authentic FROM corpus""")
def _(t):
    return E.manifest(t.corpus)


@query("evl13_track_shapes", "corpus", sql="""
, d AS (SELECT *, width_px - lag(width_px) OVER (PARTITION BY track_id ORDER BY frame) AS dw FROM corpus)
SELECT track_id, count(*) AS n_frames, coalesce(bool_and(dw >= 0), true) OR coalesce(bool_and(dw <= 0), true) AS monotone, arg_max(frame, quality * 1000000 - frame / 100.0) AS best_frame,
 arg_max(frame, quality * 1000000 - frame / 100.0) = max(frame) AS best_is_last, round(max(quality) - min(quality), 9) AS quality_spread FROM d GROUP BY track_id""")
def _(t):
    return E.track_shapes(t.corpus).withColumn("quality_spread", F.round("quality_spread", 9))


# -- streaming -----------------------------------------------------------------


def _event_stream(t):
    return t.spark.readStream.schema(SCHEMAS["events"]).parquet(f"{t.sf_dir.rstrip('/')}/events.parque*")


def _stream(t, name: str):
    return t.spark.sql(A.SOURCES[name](A.SPARK), events=_event_stream(t))


def _in_lots(t, rows, n: int, path: str, fmt: str = "parquet"):
    """Append ``rows`` to a folder in ``n`` lots by their number ``lot``, the next one when asked for; gives the number of each.

    The rows are worked out and written once, each task its own files of each lot, which are moved in when their lot is
    asked for. No file holds more than ``_FILE_ROWS``. Text is compressed. A stream that is drained after each lot takes
    it as one micro-batch (``_ALL``).
    """
    kept = shared_dir(t.spark) + "/lots"
    writer = rows.write.partitionBy("lot").option("maxRecordsPerFile", _FILE_ROWS).format(fmt)
    with shuffles_dropped(t.spark):
        (writer.option("compression", "gzip") if fmt == "text" else writer).save(kept)
    system, inbox = file_system(t.spark, path)
    system.mkdirs(inbox)
    for k in range(n):
        lot = file_system(t.spark, f"{kept}/lot={k}")[1]
        names = [f.getPath().getName() for f in system.listStatus(lot)] if system.exists(lot) else []
        for name in names:
            # Files of one task have the same name in each lot.
            system.rename(file_system(t.spark, f"{kept}/lot={k}/{name}")[1], file_system(t.spark, f"{path}/lot-{k}-{name}")[1])
        if not names:  # a lot without rows is a micro-batch without rows
            rows.drop("lot").filter(F.lit(False)).write.mode("append").format(fmt).save(path)
        yield k


#: Rows of a file that a lot is cut into: one task reads it.
_FILE_ROWS = 100_000
#: Files of a micro-batch that takes whatever is there.
_ALL = 1_000_000


def _files_per_batch(t, folder: str, n: int) -> int:
    """How many files make about ``n`` micro-batches of a folder: their number does not grow with the input."""
    system, path = file_system(t.spark, folder)
    files = sum(f.isFile() and not f.getPath().getName().startswith(("_", ".")) for f in system.listStatus(path))
    return max(1, -(-files // n))


def _delivered(t) -> str:
    """Signed events as JSON batches of a node, at most 100 events each, mixed over three lots of files."""
    event = F.struct("arrival", "node_id", F.col("sequence").cast("string").alias("sequence"), "captured_at", "prev_hash", "payload_hash",
                     "signature", "payload", "signature_ok")
    rows = t.signed_events.withColumn("batch_id", F.concat_ws("/", "node_id", F.floor(F.col("sequence") / 100).cast("string")))
    batches = rows.withColumn("arrival", F.col("sequence")).groupBy("batch_id", "node_id").agg(
        F.max("received_at").alias("received_at"), F.min("arrival").alias("arrival"), F.array_sort(F.collect_list(event)).alias("events"))
    path = shared_dir(t.spark) + "/inbox"
    lines = batches.select(F.to_json(F.struct("batch_id", "node_id", "received_at", "arrival", "events")).alias("value"))
    list(_in_lots(t, once(lines, lot=F.pmod(F.xxhash64("value"), F.lit(3)).cast("int")), 3, path, "text"))
    return path


@query("ing11_stream_job", "signed_events", "watchlist", sql=intake._READ_SQL + f"""
SELECT s.*, captured_at + to_days(365) AS expires_at, {hmac_sql('plate_canonical')} AS plate_hmac,
 CASE WHEN provisional THEN (SELECT min(f.sequence) FROM stored f WHERE f.node_id = s.node_id AND f.track_id = s.track_id AND NOT f.provisional AND f.sequence > s.sequence) END AS superseded_by,
 CASE WHEN verified THEN (SELECT count(*) FROM watchlist w WHERE w.plate_canonical = s.plate_canonical AND w.active AND (w.expires_at IS NULL OR w.expires_at > TIMESTAMP '{A.AS_OF}')) ELSE 0 END AS n_hits
FROM stored s""")
def _(t):
    """Reads of the whole job, streamed in several micro-batches and then again under a new checkpoint, with their hits."""
    inbox, root = _delivered(t), shared_dir(t.spark)
    at_once = _files_per_batch(t, inbox, 3)
    for begin in ("first", "second"):
        job.start(t.spark, inbox, root, f"{root}/{begin}", t.hasher, watchlist=t.keyed("watchlist"), as_of=A.AS_OF, files_per_batch=at_once).awaitTermination()
    have = job.tables(t.spark, root, t.hasher)
    hits = have["hits"].groupBy(F.col("read_id").alias("id")).agg(F.count("*").alias("n_hits"))
    return have["reads"].join(hits, "id", "left").select(
        "node_id", "sequence", "captured_at", "verified", "camera_id", "track_id", "plate_canonical", "confidence", "score", "n_frames",
        "provisional", "expires_at", "plate_hmac", "superseded_by", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"))


@query("ing14_stream_sessions", "signed_events", sql=intake._SESSION_SQL)
def _(t):
    """Sessions kept up over micro-batches that hold exits before entries and plates before both, then all of it again under a new checkpoint."""
    inbox, root = _delivered(t), shared_dir(t.spark)
    at_once = _files_per_batch(t, inbox, 3)
    for begin in ("first", "second"):
        job.start(t.spark, inbox, root, f"{root}/{begin}", t.hasher, files_per_batch=at_once).awaitTermination()
    return job.tables(t.spark, root, t.hasher)["sessions"].drop("camera_id", "track_id")


@query("qry8_stream_rollup", "reads", sql=f"""
SELECT date_trunc('hour', captured_at) AS bucket, camera_id, site_id, count(*) AS n_reads, count(*) FILTER (WHERE confidence = 'high') AS n_high,
 count(DISTINCT {hmac_sql('plate_canonical')}) AS n_distinct_plates FROM reads WHERE NOT provisional GROUP BY ALL""")
def _(t):
    """All hours, though each gets reads from several micro-batches."""
    reads = once(t.reads, plate_hmac=t.hasher.hash(F.col("plate_canonical")))
    out = shared_dir(t.spark)
    for _ in _in_lots(t, once(reads, lot=F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")), 3, f"{out}/inbox"):
        stream = t.spark.readStream.schema(reads.schema).parquet(f"{out}/inbox")
        live.start_rollup(t.spark, stream, f"{out}/reads", f"{out}/rollup", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rollup").drop("day")


@query("qry3_stream_feed", "reads", sql="SELECT id, captured_at, plate_canonical, confidence FROM reads WHERE NOT provisional AND camera_id = 'CAM-view'")
def _(t):
    feed = live.final_reads(_stream(t, "reads"), "CAM-view").select("id", "captured_at", "plate_canonical", "confidence")
    return live.run_to_table(feed, shared_dir(t.spark))


@query("scr1_stream_hits", "reads", "watchlist", sql=f"""
SELECT r.id AS read_id, w.id AS watchlist_id, r.confidence = 'high' AS actionable FROM reads r JOIN watchlist w USING (plate_canonical)
WHERE r.verified AND w.active AND (w.expires_at IS NULL OR w.expires_at > TIMESTAMP '{A.AS_OF}')""")
def _(t):
    reads = once(_stream(t, "reads"), plate_hmac=t.hasher.hash(F.col("plate_canonical")))
    hits = live.live_hits(reads, t.keyed("watchlist"), A.AS_OF).select("read_id", "watchlist_id", "actionable")
    return live.run_to_table(hits, shared_dir(t.spark))


@query("ing1_stream_ingest", "deliveries", sql=", d AS (" + intake._ENVELOPE.replace("AS seq", "AS seq, sequence, sha256(payload) = payload_hash AND signature_ok AS ok").format(deliveries="deliveries") + """),
once AS (SELECT batch_node, sequence, bool_and(ok) AS ok FROM d WHERE seq IS NOT NULL AND seq <> 'x1' AND claimed = batch_node GROUP BY ALL)
SELECT batch_node AS node_id, count(*) AS n_events, count(*) FILTER (WHERE ok) AS n_verified FROM once GROUP BY 1""")
def _(t):
    """Several micro-batches, then all deliveries again under a new checkpoint: each event is stored once."""
    inbox, out = intake._write_envelopes(t), shared_dir(t.spark)
    at_once = _files_per_batch(t, inbox, 4)
    for start in ("first", "second"):
        live.start_ingest(t.spark, inbox, f"{out}/events", f"{out}/{start}", files_per_batch=at_once).awaitTermination()
    live.compact(t.spark, f"{out}/events")
    stored = t.spark.read.parquet(f"{out}/events")
    return stored.groupBy("node_id").agg(F.count("*").alias("n_events"), F.count_if("verified").alias("n_verified"))


@query("src1_stream_rejects", "deliveries", sql=", d AS (" + intake._ENVELOPE.format(deliveries="deliveries") + """)
SELECT status, count(*) AS n FROM (
 SELECT CASE WHEN seq IS NULL THEN 'malformed event: missing sequence' WHEN seq = 'x1' THEN 'malformed event: bad sequence' ELSE 'other node' END AS status FROM d
  WHERE seq IS NULL OR seq = 'x1' OR claimed <> batch_node
 UNION ALL SELECT 'not json' FROM (SELECT DISTINCT batch_id FROM d) b) s GROUP BY status""")
def _(t):
    """What the stream refuses, with its reason."""
    inbox, out = intake._write_envelopes(t), shared_dir(t.spark)
    at_once = _files_per_batch(t, inbox, 4)
    live.start_ingest(t.spark, inbox, f"{out}/events", f"{out}/checkpoint", files_per_batch=at_once, rejects_path=f"{out}/rejects").awaitTermination()
    status = F.when(F.col("error").startswith("event claims"), "other node").otherwise(F.col("error"))
    return t.spark.read.parquet(f"{out}/rejects").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _frame_stream(t):
    live_tables = A.Tables(t.spark, t.sf_dir)
    live_tables._built["events"] = _event_stream(t)
    return live_tables.frames


@query("trk2_stream_passages", "track_frames", sql="""
, g AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY camera_id, track_id ORDER BY ts) >= 3600000000, true) THEN 1 ELSE 0 END AS opens FROM track_frames),
p AS (SELECT *, sum(opens) OVER (PARTITION BY camera_id, track_id ORDER BY ts) AS n FROM g)
SELECT camera_id, track_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS frames_seen FROM p GROUP BY camera_id, track_id, n
HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 SECONDS FROM track_frames)""")
def _(t):
    """Passages whose idle limit the watermark has passed."""
    return live.run_to_table(live.passages(_frame_stream(t), 3600.0), shared_dir(t.spark))


@query("zon4_stream_transitions", "track_frames", sql=vision._TRANS.replace("frame_index - lag(frame_index) OVER k > 1,", "frame_index - lag(frame_index) OVER k > 1 OR epoch_us(ts) - epoch_us(lag(ts) OVER k) > 60000000,").replace(
    "lead(frame_index) OVER k - frame_index > 1,", "lead(frame_index) OVER k - frame_index > 1 OR epoch_us(lead(ts) OVER k) - epoch_us(ts) > 60000000,") + """
, taken AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 SECONDS AS mark FROM track_frames)
SELECT t.camera_id, t.track_id, t.zone_id, t.kind, t.at_frame, t.at_time AS at FROM trans t, taken WHERE kind <> 'lost' AND at_time <= mark
UNION ALL SELECT t.camera_id, t.track_id, t.zone_id, t.kind, t.at_frame, NULL FROM trans t, taken WHERE kind = 'lost' AND (
 EXISTS (SELECT 1 FROM m WHERE m.camera_id = t.camera_id AND m.track_id = t.track_id AND m.zone_id = t.zone_id AND m.frame_index > t.at_frame - 1 AND m.ts <= mark)
 OR (SELECT max(ts) FROM m WHERE m.camera_id = t.camera_id AND m.track_id = t.track_id AND m.zone_id = t.zone_id AND m.frame_index = t.at_frame - 1) + INTERVAL 60 SECONDS < mark)""")
def _(t):
    """Frames come shuffled within 8 seconds and over five micro-batches with a restart after each; those after the last watermark still wait."""
    rows = t.frames.select("camera_id", "track_id", "frame_index", "ts", "box")
    span = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    low, width = (span[0] or 0), max(((span[1] or 0) - (span[0] or 0)) // 5 + 1, 9_000_000)
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("track_id", "frame_index"), F.lit(8_000_000))
    out = shared_dir(t.spark)
    for _ in _in_lots(t, once(rows, lot=F.least(F.floor((arrival - low) / width), F.lit(4)).cast("int")), 5, f"{out}/inbox"):
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{out}/inbox")
        done = live.run_to_table(live.zone_transitions(Z.memberships(stream, t.zones)), out)
    return done


def _restarted(t, build, rows, by, n: int, out: str, name: str = "frames"):
    """Run a stream over ``n`` lots of files in a folder, each a micro-batch with a restart after it."""
    sessions.use_state_store(t.spark)
    for _ in _in_lots(t, once(rows, lot=by), n, f"{out}/{name}"):
        done = live.run_to_table(build(), f"{out}/of-{name}")
    return done


def _slice_of(rows, arrival, n: int):
    """Number of the lot, of ``n``, that a row arrives in; each spans at least nine seconds."""
    low, high = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    width = max(((high or 0) - (low or 0)) // n + 1, 9_000_000)
    return F.greatest(F.least(F.floor((arrival - (low or 0)) / width), F.lit(n - 1)), F.lit(0)).cast("int")


@query("zon6_stream_sessions", "track_frames", sql=vision._SESSIONS + f"""
, mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 SECONDS AS mark FROM track_frames),
plated AS (SELECT camera_id, track_id, {A.key("track_id")} AS plate FROM track_frames WHERE track_id % 4 <> 0 GROUP BY ALL)
SELECT s.camera_id, s.track_id, s.zone_id, s.entry_frame, s.entered_at, s.exit_frame, s.exited_at, s.close_reason,
 round((epoch_us(exited_at) - epoch_us(entered_at)) / 1000000.0, 3) AS dwell_seconds, plate
FROM sessions s JOIN mark ON s.exited_at <= mark LEFT JOIN plated p ON s.camera_id = p.camera_id AND s.track_id = p.track_id""")
def _(t):
    """Frames come shuffled within 8 seconds, in six lots with a restart after each; plates come in behind their tracks."""
    rows = t.frames.select("camera_id", "track_id", "frame_index", "ts", "box")
    plates = t.frames.filter("track_id % 4 <> 0").groupBy("camera_id", "track_id").agg(
        (F.max("ts") + F.expr("INTERVAL 20 MINUTES")).alias("ts")).withColumn("plate", F.expr(A.key("track_id")))
    out = shared_dir(t.spark)
    read = lambda df, name: t.spark.readStream.schema(df.schema).parquet(f"{out}/{name}")
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("track_id", "frame_index"), F.lit(8_000_000))
    done = _restarted(t, lambda: sessions.closed_sessions(read(rows, "frames"), t.zones), rows, _slice_of(rows, arrival, 6), 6, out)
    known = _restarted(t, lambda: read(plates, "plates"), plates, _slice_of(plates, F.unix_micros("ts"), 2), 2, out, "plates")
    return sessions.plated(done, known)


@query("trk3_stream_triggers", "track_frames", sql=vision._PASSAGE.replace("PARTITION BY camera_id, track_id ORDER BY frame_index) > 1, true)",
    "PARTITION BY camera_id, track_id ORDER BY frame_index) > 1 OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index)) > 21600000000, true)") + """
, r AS (SELECT *, row_number() OVER k AS seen, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (k ROWS UNBOUNDED PRECEDING) AS crops FROM q WINDOW k AS (PARTITION BY camera_id, track_id, passage_start ORDER BY frame_index)),
mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 SECONDS AS mark FROM track_frames)
SELECT camera_id, track_id, passage_start, min(frame_index) AS trigger_frame FROM r, mark WHERE seen >= 8 AND crops >= 3 AND ts <= mark GROUP BY ALL""")
def _(t):
    """One row a passage, told while it is open, over six lots with a restart after each."""
    rows = t.frames.select("camera_id", "track_id", "frame_index", "ts", (F.col("value") > 20).alias("has_crop"))
    out = shared_dir(t.spark)
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("track_id", "frame_index"), F.lit(8_000_000))

    def build():
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{out}/frames")
        return sessions.provisional_triggers(stream, idle_frames=1, idle_seconds=21_600.0)

    return _restarted(t, build, rows, _slice_of(rows, arrival, 6), 6, out)


@query("ing7_stream_gaps", "deliveries", sql="""
SELECT node_id, arrival, head + 1 AS expected, sequence AS received, sequence - head - 1 AS missing FROM (
 SELECT *, coalesce(max(sequence) OVER (PARTITION BY node_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head
 FROM deliveries) t WHERE sequence > head + 1""")
def _(t):
    """Gaps of nodes that deliver in turns, told batch by batch from stored heads, with a restart and with all batches again."""
    return _run_log(t)[1].select("node_id", "arrival", "expected", "received", "missing")


@query("ing8_stream_heads", "deliveries", sql="""
SELECT node_id, n_events, first_sequence, last_sequence, n_gaps, n_missing FROM (
 SELECT node_id, count(DISTINCT sequence) AS n_events, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM deliveries GROUP BY node_id) a
JOIN (SELECT node_id, count(*) FILTER (step > 1) AS n_gaps, cast(coalesce(sum(step - 1) FILTER (step > 1), 0) as bigint) AS n_missing FROM (
 SELECT node_id, sequence - lag(sequence) OVER (PARTITION BY node_id ORDER BY sequence) AS step FROM (SELECT DISTINCT node_id, sequence FROM deliveries) u) s GROUP BY node_id) b USING (node_id)""")
def _(t):
    """What the stored runs and heads say of each node; events that come again, late or in a new run, are in no run twice."""
    log, _ = _run_log(t)
    stored, heads = live.known(t.spark, log)
    gaps = runs.missing(stored).groupBy("node_id").agg(F.count("*").alias("n_gaps"), F.sum(F.col("gap_to") - F.col("gap_from") + 1).alias("n_missing"))
    held = t.spark.read.parquet(log).groupBy("node_id").agg(F.count("*").alias("n_events"))
    per = stored.groupBy("node_id").agg(F.min("low").alias("first_sequence")).join(heads, "node_id").join(held, "node_id")
    return per.join(gaps, "node_id", "left").select("node_id", "n_events", "first_sequence", F.col("chain_sequence").alias("last_sequence"),
                                                    F.coalesce("n_gaps", F.lit(0)).cast("bigint").alias("n_gaps"), F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"))


@query("ing4_stream_verdict", "signed_events", sql=intake._breaks("signed_events", f"'{intake.R.GENESIS}'") + intake._VERDICT)
def _(t):
    """Chains verified batch by batch from stored segments: late events, a restart, and all batches again."""
    log, _ = _run_log(t, verification.start)
    return verification.verdicts(t.spark, log)


def _run_log(t, start=live.start_ingest):
    """(folder of the log, its gaps): deliveries as envelopes of a node in three lots by arrival, streamed with a
    restart after each and then all again under a new checkpoint."""
    event = F.struct("arrival", "node_id", F.col("sequence").cast("string").alias("sequence"), "captured_at", "prev_hash", "payload_hash", "signature",
                     "payload", "signature_ok")
    rows = t.deliveries
    last = (rows.agg(F.max("arrival")).first()[0] or 0) + 1
    # An envelope's arrival is its event's: arrivals inside one would follow on each other.
    sent = rows.select(F.concat_ws("/", "batch_id", F.col("arrival").cast("string")).alias("batch_id"), "node_id", "received_at", "arrival", F.array(event).alias("events"))
    out = shared_dir(t.spark)
    lines = sent.select(F.to_json(F.struct("batch_id", "node_id", "received_at", "arrival", "events")).alias("value"), F.floor(F.col("arrival") * 3 / last).cast("int").alias("lot"))
    for _ in _in_lots(t, lines, 3, f"{out}/inbox", "text"):
        start(t.spark, f"{out}/inbox", f"{out}/events", f"{out}/first", files_per_batch=_ALL).awaitTermination()
    start(t.spark, f"{out}/inbox", f"{out}/events", f"{out}/second", files_per_batch=_ALL).awaitTermination()
    return f"{out}/events", t.spark.read.parquet(f"{out}/events/{live.GAPS}")
