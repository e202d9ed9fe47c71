"""Track fusion, zones, tracks and crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import refdata as R
from ...functions import ctc, geometry as G
from ...functions.plates import fields_of
from ...operators import crops as K
from ...operators import fusion as U
from ...operators import tracks as T
from ...operators import zones as Z
from .. import adapters as A
from .registry import query, values_sql

_COLOURS_SQL = values_sql([(c, i + 1, o) for i, (c, o) in enumerate([*R.COLOUR_OWNERSHIP.items(), (R.EMBOSSED_COLOUR, "")])], "colour", "i", "owner")
_CELLS = """WITH cells AS (SELECT cast(label as string) AS track_id, vec_id, cast(vec_id % 10 + 1 as double) / 10.0 AS q, cast(unnest(embedding) as double) AS lp, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
"""


@query("fus1_frame_weights", sql="SELECT vec_id AS frame, round(pow(least(greatest(cast(vec_id % 14 - 1 as double) / 10.0, 0), 1), 2), 9) AS weight FROM embeddings")
def _(t):
    q = (F.col("vec_id") % 14 - 1) / 10.0
    return t.embeddings.select(F.col("vec_id").alias("frame"), F.round(U.frame_weight(q), 9).alias("weight"))


@query("fus2_pooled_posteriors", sql=_CELLS + """
, mixed AS (SELECT track_id, i // 8 AS t, i % 8 AS v, sum(q * q * lp) / sum(q * q) AS x FROM cells GROUP BY ALL),
peak AS (SELECT *, max(x) OVER (PARTITION BY track_id, t) AS m FROM mixed)
SELECT track_id, cast(t as int) AS t, cast(v as int) AS v, round(x - m - ln(sum(exp(x - m)) OVER (PARTITION BY track_id, t)), 8) AS log_prob FROM peak""")
def _(t):
    return U.pooled_posteriors(t.evidence).withColumn("log_prob", F.round("log_prob", 8))


_POOLED = _CELLS + f""", usable AS (SELECT track_id, vec_id, q * q AS w, colour, abs(lp) * 6 AS p FROM cells JOIN {_COLOURS_SQL} ON cells.i = t.i - 1 WHERE vec_id % 6 <> 0),
pooled AS (SELECT track_id, colour, sum(w * p) / sum(w) AS p FROM usable GROUP BY ALL)
"""


@query("fus3_pooled_colour", sql=_POOLED + "SELECT track_id, colour, round(p, 9) AS p FROM pooled")
def _(t):
    return U.pooled_colour(t.evidence).withColumn("p", F.round("p", 9))


@query("fus3_12_best_colour", sql=_POOLED + """
SELECT track_id, colour, p, CASE WHEN p >= 0.6 THEN CASE WHEN colour = 'white_black' THEN 'embossed' ELSE 'devanagari' END END AS system_hint
FROM (SELECT track_id, arg_max(colour, p) AS colour, round(max(p), 9) AS p FROM pooled GROUP BY track_id) b""")
def _(t):
    return U.best_colour(U.pooled_colour(t.evidence)).withColumn("p", F.round("p", 9))


_ZMAP = values_sql([(z[1], z[0]) for z in R.ZONES], "roman", "deva")
_CMAP = values_sql([(c[1], c[0]) for c in R.CLASSES], "roman", "deva")
_SCORED = """, scored AS (SELECT *, pow(least(greatest(quality, 0), 1), 2) AS w, pow(least(greatest(quality, 0), 1), 2) * score * pow(0.5, rank) AS cw,
 split_part(substr(canonical, 6), '-', 1) AS p1, split_part(substr(canonical, 6), '-', 2) AS p2, split_part(substr(canonical, 6), '-', 3) AS p3, split_part(substr(canonical, 6), '-', 4) AS p4 FROM candidates)
"""


def _fields(zone: str, lot: str, klass: str, serial_l: str, serial_e: str) -> str:
    cols = "track_id, cw, score"
    return f""", fields AS (SELECT {cols}, 'zone' AS field, {zone} AS value FROM scored WHERE system = 'devanagari'
 UNION ALL SELECT {cols}, 'lot', {lot} FROM scored WHERE system = 'devanagari' UNION ALL SELECT {cols}, 'class', {klass} FROM scored WHERE system = 'devanagari'
 UNION ALL SELECT {cols}, 'serial', {serial_l} FROM scored WHERE system = 'devanagari' UNION ALL SELECT {cols}, 'province', p1 FROM scored WHERE system = 'embossed'
 UNION ALL SELECT {cols}, 'class_letter', substr(p2, 1, 1) FROM scored WHERE system = 'embossed' UNION ALL SELECT {cols}, 'subclass', substr(p2, 2, 1) FROM scored WHERE system = 'embossed' AND length(p2) > 1
 UNION ALL SELECT {cols}, 'series', p3 FROM scored WHERE system = 'embossed' UNION ALL SELECT {cols}, 'serial', {serial_e} FROM scored WHERE system = 'embossed'),
votes AS (SELECT track_id, field, value, sum(cw * greatest(score, 1e-6)) AS votes FROM fields GROUP BY ALL)
"""


_DEVA_FIELDS = _fields(f"(SELECT deva FROM {_ZMAP} WHERE roman = p1)", A.deva("p2"), f"(SELECT deva FROM {_CMAP} WHERE roman = p3)", A.deva("p4"), "p4")


@query("fus4_field_votes", "candidates", sql=_SCORED + _DEVA_FIELDS + "SELECT track_id, field, value, round(votes, 8) AS votes FROM votes")
def _(t):
    return U.field_votes(U.plate_votes(t.candidate_rows)).withColumn("votes", F.round("votes", 8))


@query("fus4_plate_votes", "candidates", sql=_SCORED + "SELECT track_id, canonical, system, round(sum(cw), 8) AS votes FROM scored GROUP BY ALL")
def _(t):
    return U.plate_votes(t.candidate_rows).select("track_id", "canonical", "system", F.round("votes", 8).alias("votes"))


_POOLED_PLATES = """, pooled_plates AS (SELECT track_id, max(canonical) AS canonical, 0.4::DOUBLE AS score FROM candidates WHERE rank = 0 GROUP BY track_id)
"""


@query("fus5_votes_with_pooled", "candidates", sql=_SCORED + _POOLED_PLATES + """
, total AS (SELECT track_id, sum(w) AS total_w FROM scored WHERE rank = 0 GROUP BY track_id)
SELECT track_id, canonical, round(sum(cw), 8) AS votes FROM (SELECT track_id, canonical, cw FROM scored
 UNION ALL SELECT p.track_id, p.canonical, total_w * score FROM pooled_plates p JOIN total USING (track_id)) x GROUP BY ALL""")
def _(t):
    rows = t.candidate_rows
    pooled = rows.filter("rank = 0").groupBy("track_id").agg(F.max("canonical").alias("canonical")).withColumn("score", F.lit(0.4))
    system = F.when(F.col("canonical").startswith("NP-L"), "devanagari").otherwise("embossed")
    parsed = fields_of(pooled, "canonical", F.col("score")).select(
        "track_id", F.lit(0).alias("rank"), system.alias("system"), "canonical", "score", F.lit("reject").alias("confidence"), "fields")
    return U.plate_votes(rows, parsed).groupBy("track_id", "canonical").agg(F.round(F.sum("votes"), 8).alias("votes"))


FUSED_SQL = _SCORED + _fields("p1", "p2", "p3", "'L' || p4", "'E' || p4") + """
, whole AS (SELECT track_id, canonical, system, sum(cw) AS votes, arg_min(score, frame * 10 + rank) AS first_score, arg_min(confidence, frame * 10 + rank) AS first_conf FROM scored GROUP BY ALL),
sys AS (SELECT track_id, arg_max(system, v) AS system FROM (SELECT track_id, system, sum(votes) AS v FROM whole GROUP BY ALL) a GROUP BY track_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, canonical DESC) AS r FROM whole) a WHERE r = 1),
win AS (SELECT track_id, field, value, votes / total AS support FROM (SELECT *, sum(votes) OVER (PARTITION BY track_id, field) AS total,
 row_number() OVER (PARTITION BY track_id, field ORDER BY votes DESC, value DESC) AS r FROM votes) a WHERE r = 1),
slots AS (SELECT track_id, max(value) FILTER (WHERE field = 'zone') AS zone, max(value) FILTER (WHERE field = 'lot') AS lot, max(value) FILTER (WHERE field = 'class') AS class,
 max(value) FILTER (WHERE field = 'serial') AS serial, max(value) FILTER (WHERE field = 'province') AS province, max(value) FILTER (WHERE field = 'class_letter') AS letter,
 max(value) FILTER (WHERE field = 'subclass') AS subclass, max(value) FILTER (WHERE field = 'series') AS series,
 avg(support) FILTER (WHERE field IN ('zone', 'lot', 'class', 'serial')) AS mean_l, avg(support) FILTER (WHERE field IN ('province', 'class_letter', 'subclass', 'series', 'serial')) AS mean_e
 FROM win GROUP BY track_id),
made AS (SELECT s.track_id, s.system, CASE WHEN s.system = 'devanagari' THEN mean_l ELSE mean_e END AS mean_support,
 CASE WHEN s.system = 'devanagari' THEN CASE WHEN serial LIKE 'L%' THEN 'NP-L:' || zone || '-' || lot || '-' || class || '-' || substr(serial, 2) END
 ELSE CASE WHEN serial LIKE 'E%' AND regexp_matches(letter || coalesce(subclass, ''), '^(A|B|C1?|D|E|F|G|H[12]?|I[1-3]?|J[1-5]?|K)$')
  THEN 'NP-E:' || province || '-' || letter || coalesce(subclass, '') || '-' || series || '-' || substr(serial, 2) END END AS assembled FROM sys s JOIN slots USING (track_id)),
chosen AS (SELECT m.track_id, coalesce(assembled, b.canonical) AS canonical, CASE WHEN assembled IS NOT NULL THEN m.system ELSE b.system END AS system, assembled IS NOT NULL AS assembled,
 CASE WHEN assembled IS NOT NULL THEN mean_support ELSE first_score END AS plate_score,
 CASE WHEN assembled IS NULL THEN first_conf WHEN mean_support >= 0.9 THEN 'high' WHEN mean_support >= 0.75 THEN 'medium' WHEN mean_support >= 0.5 THEN 'low' ELSE 'reject' END AS band FROM made m JOIN best b USING (track_id)),
agree AS (SELECT s.track_id, count(*) AS n_frames, avg(cast(s.canonical = c.canonical as int)) AS agreement FROM scored s JOIN chosen c USING (track_id) WHERE s.rank = 0 AND s.w > 0 GROUP BY s.track_id),
alt AS (SELECT track_id, string_agg(canonical, ',' ORDER BY r) AS alternatives FROM (SELECT w.track_id, w.canonical, row_number() OVER (PARTITION BY w.track_id ORDER BY w.votes DESC, w.canonical DESC) AS r
 FROM whole w JOIN chosen c USING (track_id) WHERE w.canonical <> c.canonical) a WHERE r <= 2 GROUP BY track_id),
fused AS (SELECT c.track_id, c.canonical, c.system, c.assembled, plate_score, n_frames, agreement, coalesce(alternatives, '') AS alternatives, ln(greatest(coalesce(w.votes, 1e-9), 1e-9)) AS score,
 CASE WHEN n_frames <= 1 THEN CASE WHEN band = 'high' THEN 'medium' ELSE band END WHEN agreement >= 0.8 AND n_frames >= 3 AND band = 'medium' THEN 'high'
  WHEN agreement < 0.5 AND band = 'high' THEN 'medium' WHEN agreement < 0.35 THEN 'low' ELSE band END AS confidence
 FROM chosen c JOIN agree USING (track_id) LEFT JOIN whole w ON w.track_id = c.track_id AND w.canonical = c.canonical LEFT JOIN alt ON alt.track_id = c.track_id)
"""


@query("fus6_7_8_fused_reads", "candidates", sql=FUSED_SQL + """
SELECT track_id, canonical, system, confidence, round(plate_score, 7) AS plate_score, round(score, 7) AS score, n_frames, round(agreement, 7) AS agreement, alternatives, assembled FROM fused""")
def fused(t):
    return U.fuse(t.candidate_rows).select(
        "track_id", "canonical", "system", "confidence", F.round("plate_score", 7).alias("plate_score"), F.round("score", 7).alias("score"),
        "n_frames", F.round("agreement", 7).alias("agreement"), F.array_join("alternatives", ",").alias("alternatives"), "assembled")


@query("fus9_greedy_tokens", sql=_CELLS + """
, best AS (SELECT vec_id, i // 8 AS t, arg_max(i % 8, lp) AS k FROM cells GROUP BY ALL), steps AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS p FROM best)
SELECT e.vec_id AS frame, coalesce(string_agg(cast(k as string), ',' ORDER BY t) FILTER (WHERE k <> 0 AND (p IS NULL OR k <> p)), '') AS tokens FROM embeddings e LEFT JOIN steps USING (vec_id) GROUP BY 1""")
def _(t):
    return t.evidence.select("frame", F.array_join(ctc.greedy_indices(F.col("log_probs")).cast("array<string>"), ",").alias("tokens"))


@query("fus10_token_scores", sql="SELECT vec_id AS frame, round(exp(list_avg(embedding)), 6) AS score FROM embeddings".replace(
    "list_avg(embedding)", "list_avg(list_transform(embedding, lambda x: cast(x as double)))"))
def _(t):
    return t.embeddings.select(F.col("vec_id").alias("frame"), F.round(ctc.geometric_mean_score(F.col("embedding").cast("array<double>")), 6).alias("score"))


@query("fus11_reranked", "candidates", sql=f"""
, own AS (SELECT *, CASE WHEN system = 'devanagari' THEN split_part(substr(canonical, 6), '-', 3) END AS letter,
 {', '.join(f"cast((frame + {i}) % {i + 3} as double) / {i + 3} AS p{i}" for i in range(6))} FROM candidates),
scored AS (SELECT o.*, round(ln(score), 6) + CASE WHEN c.owner IS NULL OR p0 + p1 + p2 + p3 + p4 + p5 <= 0 THEN 0 ELSE ln(greatest(CASE c.owner {' '.join(f"WHEN '{o}' THEN p{i}" for i, o in enumerate(R.COLOUR_OWNERSHIP.values()))} END
 / (p0 + p1 + p2 + p3 + p4 + p5), 1e-3)) END AS total FROM own o LEFT JOIN {values_sql([(c[1], c[2]) for c in R.CLASSES], "letter", "owner").replace("AS t", "AS c")} ON o.letter = c.letter)
SELECT track_id, frame, canonical, rank, round(total, 8) AS total, row_number() OVER (PARTITION BY track_id, frame ORDER BY total DESC, canonical, rank) - 1 AS new_rank FROM scored""")
def _(t):
    posterior = F.create_map(*[x for i, c in enumerate(R.COLOUR_OWNERSHIP) for x in (
        F.lit(c), ((F.col("frame") + i) % (i + 3)).cast("double") / (i + 3))])
    rows = t.candidates.withColumn("log_prob", F.round(F.log("score"), 6)).withColumn("colour", posterior)
    return U.reranked(rows).select("track_id", "frame", "canonical", "rank", F.round("total", 8).alias("total"), F.col("new_rank").cast("bigint").alias("new_rank"))


def _edges() -> str:
    rows = []
    for name, ring, enter, leave in (("square", A.SQUARE, 2, 2), ("triangle", A.TRIANGLE, 3, 4)):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            rows.append((name, float(x1), float(y1), float(x2), float(y2), enter, leave))
    return values_sql(rows, "zone_id", "x1", "y1", "x2", "y2", "enter_frames", "exit_frames")


_MEMBERS = f""", boxes AS (SELECT camera_id, track_id, frame_index, ts, x - w / 2 AS bx1, cast(y as double) - 30 AS by1, x + w / 2 AS bx2, cast(y as double) AS by2, value, event_id, j FROM track_frames),
m AS (SELECT camera_id, track_id, frame_index, ts, zone_id, enter_frames, exit_frames, sum(CASE WHEN (y1 > by2) <> (y2 > by2)
 AND (bx1 + bx2) / 2.0 < (x2 - x1) * (by2 - y1) / (y2 - y1 + 1e-12) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM boxes, (SELECT * REPLACE (x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2) FROM {_edges()}) e GROUP BY ALL)
"""
_TRANS = _MEMBERS + """, a AS (SELECT *, coalesce(frame_index - lag(frame_index) OVER k > 1, true) AS starts, coalesce(inside <> lag(inside) OVER k, true) AS flips, coalesce(lead(frame_index) OVER k - frame_index > 1, true) AS ends
 FROM m WINDOW k AS (PARTITION BY camera_id, track_id, zone_id ORDER BY frame_index)),
b AS (SELECT *, sum(CASE WHEN starts OR flips THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, track_id, zone_id ORDER BY frame_index) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, zone_id, run ORDER BY frame_index) AS len FROM b),
d AS (SELECT *, CASE WHEN inside AND len >= enter_frames THEN true WHEN NOT inside AND len >= exit_frames THEN false WHEN starts THEN false END AS signal FROM c),
e AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY camera_id, track_id, zone_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS latch FROM d),
f AS (SELECT *, CASE WHEN starts THEN false ELSE lag(latch) OVER (PARTITION BY camera_id, track_id, zone_id ORDER BY frame_index) END AS before FROM e),
trans AS (SELECT camera_id, track_id, zone_id, 'entry' AS kind, frame_index AS at_frame, ts AS at_time FROM f WHERE latch AND NOT before
 UNION ALL SELECT camera_id, track_id, zone_id, 'exit', frame_index, ts FROM f WHERE NOT latch AND before
 UNION ALL SELECT camera_id, track_id, zone_id, 'lost', frame_index + 1, NULL FROM f WHERE latch AND ends)
"""
_SESSIONS = _TRANS + f""", cams AS (SELECT camera_id, frame_index, min(ts) AS ts FROM track_frames GROUP BY ALL),
line AS (SELECT t.* REPLACE (coalesce(at_time, cams.ts) AS at_time) FROM trans t LEFT JOIN cams ON t.camera_id = cams.camera_id AND t.at_frame = cams.frame_index WHERE kind <> 'lost' OR cams.ts IS NOT NULL),
pairs AS (SELECT *, lead(kind) OVER k AS end_kind, lead(at_frame) OVER k AS end_frame, lead(at_time) OVER k AS end_at FROM line WINDOW k AS (PARTITION BY camera_id, track_id, zone_id ORDER BY at_frame, kind = 'entry')),
late AS (SELECT p.camera_id, p.track_id, p.zone_id, p.at_frame, min(c.frame_index) AS timeout_frame, arg_min(c.ts, c.frame_index) AS timeout_at FROM pairs p JOIN cams c ON p.camera_id = c.camera_id
 AND c.ts > p.at_time + to_seconds({int(A.DWELL)}) AND (p.end_frame IS NULL OR c.frame_index < p.end_frame) WHERE p.kind = 'entry' GROUP BY ALL),
sessions AS (SELECT p.camera_id, p.track_id, p.zone_id, p.at_frame AS entry_frame, p.at_time AS entered_at, coalesce(timeout_frame, end_frame) AS exit_frame, coalesce(timeout_at, end_at) AS exited_at,
 CASE WHEN timeout_frame IS NOT NULL THEN 'timed_out' WHEN end_kind = 'exit' THEN 'exited' WHEN end_kind = 'lost' THEN 'track_lost' END AS close_reason
 FROM pairs p LEFT JOIN late l ON p.camera_id = l.camera_id AND p.track_id = l.track_id AND p.zone_id = l.zone_id AND p.at_frame = l.at_frame WHERE p.kind = 'entry')
"""


@query("zon1_2_3_memberships", "track_frames", sql=_MEMBERS + "SELECT camera_id, track_id, frame_index, zone_id, inside FROM m")
def _(t):
    return Z.memberships(t.frames, t.zones).select("camera_id", "track_id", "frame_index", "zone_id", "inside")


@query("zon4_5_transitions", "track_frames", sql=_TRANS + "SELECT * FROM trans")
def _(t):
    rows = Z.transitions(Z.memberships(t.frames, t.zones), t.zones)
    return rows.drop("max_dwell_seconds").withColumnRenamed("at", "at_time")


@query("zon6_7_sessions", "track_frames", sql=_SESSIONS + """
SELECT *, round((epoch_us(exited_at) - epoch_us(entered_at)) / 1000000.0, 3) AS dwell_seconds FROM sessions""")
def _(t):
    return Z.sessions(t.frames, t.zones)


@query("zon8_session_plates", "track_frames", sql=_SESSIONS + f"""
SELECT s.camera_id, s.track_id, zone_id, entry_frame, plate FROM sessions s LEFT JOIN (SELECT camera_id, track_id, CASE WHEN track_id % 4 <> 0 THEN {A.key('track_id')} END AS plate FROM track_frames GROUP BY ALL) p
 ON s.camera_id = p.camera_id AND s.track_id = p.track_id""")
def _(t):
    plates = t.frames.select("camera_id", "track_id").distinct().filter("track_id % 4 <> 0").withColumn("plate", F.expr(A.key("track_id")))
    return Z.attach_plates(Z.sessions(t.frames, t.zones), plates).select("camera_id", "track_id", "zone_id", "entry_frame", "plate")


@query("zon9_directions", "track_frames", sql=_MEMBERS + """
, ends AS (SELECT *, first_value(bx1) OVER k AS ax1, first_value(by1) OVER k AS ay1, first_value(bx2) OVER k AS ax2, first_value(by2) OVER k AS ay2 FROM boxes
 WINDOW k AS (PARTITION BY camera_id, track_id ORDER BY frame_index ROWS 63 PRECEDING)),
moves AS (SELECT *, (bx1 + bx2) / 2 - (ax1 + ax2) / 2 AS dx, (by1 + by2) / 2 - (ay1 + ay2) / 2 AS dy FROM ends)
SELECT camera_id, track_id, frame_index, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-3 THEN round(dx / sqrt(dx * dx + dy * dy), 9) END AS dir_x,
 CASE WHEN sqrt(dx * dx + dy * dy) > 1e-3 THEN round(dy / sqrt(dx * dx + dy * dy), 9) END AS dir_y FROM moves""")
def _(t):
    return T.directions(t.frames).withColumn("dir_x", F.round("dir_x", 9)).withColumn("dir_y", F.round("dir_y", 9))


@query("trk1_link_candidates", "track_frames", sql=_MEMBERS + """
, pairs AS (SELECT b.camera_id, b.frame_index, a.track_id AS prev_track_id, b.track_id, greatest(least(a.bx2, b.bx2) - greatest(a.bx1, b.bx1), 0) * greatest(least(a.by2, b.by2) - greatest(a.by1, b.by1), 0) AS inter,
 (a.bx2 - a.bx1) * (a.by2 - a.by1) AS s1, (b.bx2 - b.bx1) * (b.by2 - b.by1) AS s2 FROM boxes a JOIN boxes b ON a.camera_id = b.camera_id AND a.frame_index + 1 = b.frame_index)
SELECT camera_id, frame_index, prev_track_id, track_id, round(inter / greatest(s1 + s2 - inter, 1e-6), 9) AS iou FROM pairs WHERE inter / greatest(s1 + s2 - inter, 1e-6) >= 0.3""")
def _(t):
    return T.link_candidates(t.frames).withColumn("iou", F.round("iou", 9))


# A short idle limit, so that the missed frames of the adapter open passages.
_PASSAGE = """, g AS (SELECT *, CASE WHEN coalesce(frame_index - lag(frame_index) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) > 1, true) THEN 1 ELSE 0 END AS opens FROM track_frames),
p AS (SELECT *, sum(opens) OVER (PARTITION BY camera_id, track_id ORDER BY frame_index) AS n FROM g),
q AS (SELECT *, min(frame_index) OVER (PARTITION BY camera_id, track_id, n) AS passage_start FROM p)
"""


@query("trk2_passages", "track_frames", sql=_PASSAGE + """
SELECT camera_id, track_id, passage_start, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS frames_seen, max(frame_index) AS last_frame FROM q GROUP BY ALL""")
def _(t):
    return T.passages(t.frames, idle_frames=1)


@query("trk3_provisional_triggers", "track_frames", sql=_PASSAGE + """
, r AS (SELECT *, row_number() OVER k AS seen, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (k ROWS UNBOUNDED PRECEDING) AS crops FROM q WINDOW k AS (PARTITION BY camera_id, track_id, passage_start ORDER BY frame_index))
SELECT camera_id, track_id, passage_start, min(frame_index) AS trigger_frame FROM r WHERE seen >= 8 AND crops >= 3 GROUP BY ALL""")
def _(t):
    return T.provisional_triggers(t.frames.withColumn("has_crop", F.col("value") > 20), idle_frames=1)


@query("trk4_read_payloads", "candidates", sql=FUSED_SQL + """
, pas AS (SELECT 'T' || cast(cast(floor(event_id / 40) as bigint) as string) AS track_id, 'C' || cast(cast(floor(event_id / 4000) as bigint) as string) AS camera_id, min(ts) AS first_seen, max(ts) AS last_seen,
 count(*) FILTER (WHERE value > 10) AS n_crops, max(value / 500) FILTER (WHERE value > 10) AS best FROM events GROUP BY ALL),
u AS (SELECT *, CASE WHEN cast(substr(track_id, 2) as bigint) % 5 <> 0 THEN n_crops END AS n FROM pas)
SELECT u.camera_id, u.track_id, CASE WHEN n IS NOT NULL THEN 'plate_read' ELSE 'unreadable_passage' END AS kind, CASE WHEN n IS NOT NULL THEN canonical END AS plate, CASE WHEN n IS NOT NULL THEN confidence END AS confidence,
 CASE WHEN n IS NOT NULL THEN round(plate_score, 4) END AS score, n IS NOT NULL AND confidence = 'high' AS actionable, CASE WHEN n IS NOT NULL THEN n_frames END AS n_frames, CASE WHEN n IS NOT NULL THEN round(agreement, 4) END AS agreement,
 coalesce(n, 0) AS n_crops, CASE WHEN n IS NOT NULL THEN round(best, 4) END AS best_crop_quality, first_seen, last_seen FROM u LEFT JOIN fused USING (track_id)""")
def _(t):
    track = F.floor(F.col("event_id") / 40).cast("bigint")
    per = t.events.groupBy(F.concat(F.lit("T"), track.cast("string")).alias("track_id"),
                           F.concat(F.lit("C"), F.floor(F.col("event_id") / 4000).cast("string")).alias("camera_id")).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(F.col("value") > 10).alias("n_crops"),
        F.max(F.when(F.col("value") > 10, F.col("value") / 500)).alias("best_quality"))
    crops = per.filter(F.substring("track_id", 2, 20).cast("bigint") % 5 != 0).select(
        "track_id", "n_crops", "best_quality", G.box(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("plate_box"))
    out = T.read_payloads(U.fuse(t.candidate_rows), crops, per.select("camera_id", "track_id", "first_seen", "last_seen"))
    return out.drop("plate_box")


@query("trk5_camera_counters", "track_frames", "signed_events", sql="""
, e AS (SELECT 'CAM' || cast(cast(floor(event_id / 1000) as bigint) as string) AS camera_id, json_extract_string(payload, '$.kind') AS kind, coalesce(json_extract_string(payload, '$.provisional'), 'false') = 'true' AS provisional FROM signed_events),
s AS (SELECT camera_id, count(DISTINCT frame_index) AS frames, count(*) AS detections, count(DISTINCT track_id) AS tracks_started FROM track_frames GROUP BY camera_id)
SELECT s.*, c.* EXCLUDE (camera_id) FROM s JOIN (SELECT camera_id, count(*) FILTER (WHERE kind = 'plate_read' AND NOT provisional) AS reads, count(*) FILTER (WHERE kind = 'plate_read' AND provisional) AS provisional,
 count(*) FILTER (WHERE kind = 'zone_entry') AS zone_entries, count(*) FILTER (WHERE kind = 'zone_exit') AS zone_exits, count(*) FILTER (WHERE kind = 'unreadable_passage') AS unreadable FROM e GROUP BY camera_id) c USING (camera_id)""")
def _(t):
    events = t.signed_events.select(
        F.concat(F.lit("CAM"), F.floor(F.col("event_id") / 1000).cast("string")).alias("camera_id"),
        F.get_json_object("payload", "$.kind").alias("kind"), F.coalesce(F.get_json_object("payload", "$.provisional"), F.lit("false")).cast("boolean").alias("provisional"))
    return T.camera_counters(t.frames, events)


@query("trk6_plate_regions", "track_frames", sql=_MEMBERS + """
, r AS (SELECT event_id, j, bx1 + (bx2 - bx1) * 0.15 AS rx1, by1 + (by2 - by1) * 0.62 AS ry1, bx2 - (bx2 - bx1) * 0.15 AS rx2, by2 - (by2 - by1) * 0.04 AS ry2 FROM boxes),
c AS (SELECT *, trunc(greatest(0, rx1 - (rx2 - rx1) * 0.06)) AS cx1, trunc(greatest(0, ry1 - (ry2 - ry1) * 0.06)) AS cy1, trunc(least(400, rx2 + (rx2 - rx1) * 0.06)) AS cx2, trunc(least(300, ry2 + (ry2 - ry1) * 0.06)) AS cy2 FROM r)
SELECT event_id, cast(j as int) AS j, round(rx1, 6) AS rx1, round(ry2, 6) AS ry2, CASE WHEN cx2 - cx1 >= 4 AND cy2 - cy1 >= 4 THEN cast(cx1 as double) END AS cx1,
 CASE WHEN cx2 - cx1 >= 4 AND cy2 - cy1 >= 4 THEN cast(cy2 as double) END AS cy2 FROM c""")
def _(t):
    r = t.frames.withColumn("r", G.fallback_plate_region(F.col("box"))).withColumn("c", G.padded_crop(F.col("r"), F.lit(400), F.lit(300)))
    return r.select("event_id", F.col("j").cast("int").alias("j"), F.round("r.x1", 6).alias("rx1"), F.round("r.y2", 6).alias("ry2"), F.col("c.x1").alias("cx1"), F.col("c.y2").alias("cy2"))


_RAMP = "least(greatest((l_quantity * 3 - {a}) / {b}, 0), 1)"


@query("crp1_crop_quality", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, round((0.45 * {_RAMP.format(a='24.0', b='86.0')} + 0.35 * (l_discount * 10) + 0.20 * least(greatest(1 - l_tax, 0), 1))
 * CASE WHEN l_partkey % 1900 < 76.8 OR l_partkey % 1900 + l_quantity * 3 > 1843.2 THEN 0.55 ELSE 1.0 END * {_RAMP.format(a='18.0', b='10.0')}, 9) AS quality FROM lineitem""")
def _(t):
    x = (F.col("l_partkey") % 1900).cast("double")
    b = G.box(x, F.lit(100.0), x + F.col("l_quantity") * 3, F.lit(140.0))
    q = K.crop_quality(b, F.col("l_discount") * 10, 1 - F.col("l_tax"), F.lit(1920.0), F.lit(1080.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(q, 9).alias("quality"))


_CLAMP = "least(greatest(({x} - {low}) / {span}, 0), 1)"


@query("crp2_selected_crops", "track_frames", recursive=True, sql=_MEMBERS.split(",\nm AS")[0] + f"""
, graded AS (SELECT camera_id || '/' || cast(track_id AS VARCHAR) AS track_id, frame_index,
 ({_CLAMP.format(x='greatest(bx2 - bx1, 0)', low='24.0::DOUBLE', span='86.0::DOUBLE')} * 0.45::DOUBLE + ((value % 10) / 10) * 0.35::DOUBLE
  + least(greatest(0.5::DOUBLE + (event_id % 50) / 100, 0), 1) * 0.20::DOUBLE)
 * CASE WHEN bx1 < 76.8 OR by1 < 43.2 OR bx2 > 1843.2 OR by2 > 1036.8 THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END
 * {_CLAMP.format(x='greatest(bx2 - bx1, 0)', low='18.0::DOUBLE', span='10.0::DOUBLE')} AS quality FROM boxes),
pools AS (SELECT track_id, list(struct_pack(f := cast(frame_index AS BIGINT), q := quality) ORDER BY frame_index) AS pool FROM graded WHERE quality >= 0.05::DOUBLE GROUP BY 1),
rounds AS (
 SELECT track_id, pool, cast([] AS STRUCT(f BIGINT, q DOUBLE)[]) AS chosen, 0 AS n FROM pools WHERE len(pool) > 8
 UNION ALL
 SELECT track_id, list_filter(pool, lambda c: c.f <> best.f), list_append(chosen, struct_pack(f := best.f, q := best.q)), n + 1 FROM (
  SELECT *, list_sort(list_transform(pool, lambda c: struct_pack(v := -list_reduce(list_prepend(c.q, list_transform(chosen,
   lambda s: CASE WHEN abs(s.f - c.f) < 6 THEN 1.0::DOUBLE - 0.6::DOUBLE * (1.0::DOUBLE - abs(s.f - c.f) / 6.0::DOUBLE) ELSE 1.0::DOUBLE END)),
   lambda x, y: x * y), f := c.f, q := c.q)))[1] AS best FROM rounds WHERE n < 8) r)
SELECT track_id, c.f AS frame_index, c.q AS quality FROM (
 SELECT track_id, unnest(pool) AS c FROM pools WHERE len(pool) <= 8 UNION ALL SELECT track_id, unnest(chosen) FROM rounds WHERE n = 8) t""")
def _(t):
    """The greedy choice, round by round."""
    f = t.frames
    q = K.crop_quality(F.col("box"), (F.col("value") % 10) / 10, F.lit(0.5) + (F.col("event_id") % 50) / 100, F.lit(1920.0), F.lit(1080.0))
    rows = f.select(F.concat_ws("/", "camera_id", F.col("track_id").cast("string")).alias("track_id"), "frame_index", q.alias("quality"))
    return K.select_crops(rows)


@query("crp3_layout", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 97 / l_quantity < 2.7 AS two_row,
 round(((l_partkey % 97 + 1 + sqrt(pow(l_partkey % 97 + 1, 2) + 4)) / 2) / ((l_quantity + (l_quantity + 2)) / 2), 9) AS aspect FROM lineitem""")
def _(t):
    w, h = (F.col("l_partkey") % 97).cast("double"), F.col("l_quantity")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    quad = F.array(pt(zero, zero), pt(w + 1.0, zero), pt(w + 1.0, h + 2.0), pt(zero, h))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.is_two_row(w, h).alias("two_row"), F.round(G.quad_aspect(quad), 9).alias("aspect"))
