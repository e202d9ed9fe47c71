"""Screening, anomalies and investigative queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import refdata as R
from ...functions import geometry as G
from ...operators import anomalies as N
from ...operators import screening as S
from .. import investigate as Q
from .. import adapters as A
from ..adapters import AS_OF
from .registry import query, values_sql

# The plate the single-plate searches ask for: the one integer 7 stands for.
TARGET = 7
TARGET_SQL = A.key(str(TARGET))


def target(t) -> str:
    plate = F.expr(TARGET_SQL)
    return t.hasher.hash(plate)


@query("scr1_hits", "reads", "watchlist", sql=f"""
SELECT r.id AS read_id, w.id AS watchlist_id, w.category, r.plate_canonical, r.captured_at, r.confidence, r.provisional, r.confidence = 'high' AS actionable
FROM reads r JOIN watchlist w USING (plate_canonical) WHERE r.verified AND w.active AND (w.expires_at IS NULL OR w.expires_at > TIMESTAMP '{AS_OF}')""")
def _(t):
    return S.screen(t.keyed("reads"), t.keyed("watchlist"), AS_OF).drop("plate_hmac", "camera_id")


FLAGSHIP_SQL = f"""
SELECT w.category, count(*) AS n_hits, count(*) FILTER (WHERE r.confidence = 'high') AS n_actionable, count(DISTINCT r.plate_canonical) AS n_plates
FROM (SELECT x.id, x.expected AS plate_canonical, y.confidence, y.verified FROM plate_texts x JOIN reads y USING (id)) r
JOIN watchlist w USING (plate_canonical)
WHERE r.verified AND w.active AND (w.expires_at IS NULL OR w.expires_at > TIMESTAMP '{AS_OF}') GROUP BY w.category"""


@query("scr1_hits_per_category", "plate_texts", "reads", "watchlist", sql=FLAGSHIP_SQL)
def hits_per_category(t):
    """Free spellings to keys, to pseudonyms, to watch-list hits per category."""
    from ...functions.plates import with_canonical

    e = t.events
    texts = with_canonical(
        t.spark.sql(A.plate_texts(A.SPARK).replace("SELECT event_id AS id,", f"SELECT event_id AS id, event_id % 50 <> 0 AS verified, {A.BAND} AS confidence, ts AS captured_at,"), events=e),
        "text", "plate_canonical",
    ).filter("plate_canonical is not null")
    reads = texts.withColumn("plate_hmac", t.hasher.hash(F.col("plate_canonical"))).withColumn(
        "camera_id", F.lit("")).withColumn("provisional", F.lit(False))
    hits = S.screen(reads, t.keyed("watchlist"), AS_OF)
    return hits.groupBy("category").agg(
        F.count("*").alias("n_hits"), F.count_if("actionable").alias("n_actionable"), F.count_distinct("plate_hmac").alias("n_plates"))


@query("scr2_new_entries", "plate_texts", sql="""
SELECT id, CASE WHEN expected IS NULL THEN 'not a valid Nepali plate' WHEN id % 8 = 1 THEN 'a watch-list entry requires a reason' END AS error,
 CASE WHEN expected IS NOT NULL AND id % 8 <> 1 THEN expected END AS plate_canonical FROM plate_texts""")
def _(t):
    requests = t.plate_texts.select("id", F.col("text").alias("plate"), F.when(F.col("id") % 8 == 1, "  ").otherwise("stolen vehicle").alias("reason"))
    ok, bad = S.add_entries(requests, t.hasher)
    return ok.select("id", F.lit(None).cast("string").alias("error"), "plate_canonical").unionByName(
        bad.select("id", "error", F.lit(None).cast("string").alias("plate_canonical")))


@query("scr3_backfill", "reads", "watchlist", sql=f"""
SELECT r.id AS read_id, w.id AS watchlist_id, w.category, r.plate_canonical, r.captured_at, r.confidence, false AS actionable
FROM reads r JOIN watchlist w USING (plate_canonical) WHERE r.verified AND NOT r.provisional AND r.captured_at >= TIMESTAMP '{AS_OF}' - to_days(10)""")
def _(t):
    return S.backfill(t.keyed("reads"), t.keyed("watchlist"), AS_OF, days=10)


_ACK = """, ack AS (SELECT hit_id, arg_max(actor, at_time) AS acknowledged_by, max(at_time) AS acknowledged_at FROM acknowledgements GROUP BY hit_id)
"""


@query("scr4_hit_list", "hits", "acknowledgements", sql=_ACK + """
SELECT h.id, h.matched_at, h.confidence, h.actionable, r.plate_canonical AS plate, r.camera_id, r.captured_at, w.category
FROM hits h LEFT JOIN ack ON h.id = ack.hit_id LEFT JOIN reads r ON h.read_id = r.id LEFT JOIN watchlist w ON h.watchlist_id = w.id
WHERE acknowledged_at IS NULL ORDER BY h.matched_at DESC, h.id DESC LIMIT 500""")
def _(t):
    return S.hit_list(S.acknowledged(t.hits, t.acknowledgements), t.reads, t.watchlist)


@query("scr5_acknowledged", "hits", "acknowledgements", sql=_ACK + """
SELECT h.id, ack.acknowledged_by, ack.acknowledged_at FROM hits h LEFT JOIN ack ON h.id = ack.hit_id""")
def _(t):
    return S.acknowledged(t.hits, t.acknowledgements).select("id", "acknowledged_by", "acknowledged_at")


@query("scr6_active_entries", "watchlist", sql="""
SELECT id, plate_canonical, category, added_at FROM watchlist WHERE active ORDER BY added_at DESC, id DESC LIMIT 500""")
def _(t):
    return S.active_entries(t.watchlist).select("id", "plate_canonical", "category", "added_at")


_COLOUR = values_sql(list(R.COLOUR_OWNERSHIP.items()), "colour", "implied")
_VEHICLE = values_sql([(s, v) for s, vs in R.SIZE_VEHICLES.items() for v in vs], "size_class", "vehicle")


@query("ano1_colour_mismatch", "reads", sql=f"""
SELECT r.id, 'colour_class_mismatch' AS kind, observed_colour, implied AS colour_implies, ownership AS class_letter_implies
FROM reads r JOIN {_COLOUR} ON observed_colour = colour WHERE plate_system = 'devanagari' AND ownership <> 'unknown' AND implied <> ownership""")
def _(t):
    d = F.col("detail")
    return N.colour_mismatches(t.keyed("reads")).select(
        F.col("read_ids")[0].alias("id"), "kind", d["observed_colour"].alias("observed_colour"),
        d["colour_implies"].alias("colour_implies"), d["class_letter_implies"].alias("class_letter_implies"))


@query("ano2_vehicle_mismatch", "reads", sql=f"""
SELECT id, size_class AS plate_size_class, observed_vehicle_type FROM reads WHERE size_class IN ('motorcycle', 'light', 'heavy')
 AND (size_class, observed_vehicle_type) NOT IN (SELECT (size_class, vehicle) FROM {_VEHICLE})""")
def _(t):
    d = F.col("detail")
    return N.vehicle_mismatches(t.keyed("reads")).select(
        F.col("read_ids")[0].alias("id"), d["plate_size_class"].alias("plate_size_class"), d["observed_vehicle_type"].alias("observed_vehicle_type"))


_KM = ("2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude))"
       " * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))")
_MOVES = f""", trusted AS (SELECT r.id, plate_canonical, node_id, captured_at, latitude, longitude FROM reads r JOIN nodes n USING (node_id)
 WHERE confidence = 'high' AND verified AND NOT provisional),
moves AS (SELECT o.id AS other_id, r.id AS read_id, r.plate_canonical, o.node_id AS from_node, r.node_id AS to_node, r.captured_at, {_KM.format(a='r', b='o')} AS km,
 (epoch_us(r.captured_at) - epoch_us(o.captured_at)) / 1000000.0 AS dt FROM trusted r JOIN trusted o
 ON r.plate_canonical = o.plate_canonical AND r.node_id <> o.node_id AND o.captured_at <= r.captured_at AND o.captured_at >= r.captured_at - INTERVAL 24 HOURS),
impossible AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY dt, other_id) AS rn FROM moves WHERE dt >= 60 AND km / (dt / 3600.0) > 160) x WHERE rn = 1)
"""


@query("ano3_impossible_movement", "reads", "nodes", sql=_MOVES + """
SELECT read_id, other_id, plate_canonical, from_node, to_node, captured_at, round(km, 2) AS distance_km, round(dt, 1) AS interval_seconds, round(km / (dt / 3600.0), 1) AS implied_speed_kmh FROM impossible""")
def _(t):
    return N.impossible_pairs(t.keyed("reads"), t.nodes).drop("plate_hmac")


@query("ano4_registry_mismatch", "reads", "registry", sql="""
SELECT r.id, cast(substr(r.plate_canonical, 6, 1) as int) AS plate_province, g.registered_province FROM reads r JOIN registry g USING (plate_canonical)
WHERE r.plate_system = 'embossed' AND cast(substr(r.plate_canonical, 6, 1) as int) <> g.registered_province""")
def _(t):
    d = F.col("detail")
    return N.registry_mismatches(t.keyed("reads"), t.keyed("registry")).select(
        F.col("read_ids")[0].alias("id"), d["plate"].cast("int").alias("plate_province"), d["registry"].cast("int").alias("registered_province"))


_ALL = _MOVES + f""", good AS (SELECT * FROM reads WHERE verified AND NOT provisional),
found AS (SELECT 'colour_class_mismatch' AS kind, 'warning' AS severity, r.plate_canonical, r.captured_at AS detected_at, r.id AS read_id FROM good r JOIN {_COLOUR} ON observed_colour = colour
 WHERE plate_system = 'devanagari' AND ownership <> 'unknown' AND implied <> ownership
UNION ALL SELECT 'plate_vehicle_mismatch', 'warning', plate_canonical, captured_at, id FROM good WHERE size_class IN ('motorcycle', 'light', 'heavy')
 AND (size_class, observed_vehicle_type) NOT IN (SELECT (size_class, vehicle) FROM {_VEHICLE})
UNION ALL SELECT 'registry_mismatch', 'warning', r.plate_canonical, r.captured_at, r.id FROM good r JOIN registry g USING (plate_canonical)
 WHERE r.plate_system = 'embossed' AND cast(substr(r.plate_canonical, 6, 1) as int) <> g.registered_province
UNION ALL SELECT 'impossible_movement', 'alert', plate_canonical, captured_at, read_id FROM impossible)
"""


def _all(t):
    return N.all_anomalies(t.keyed("reads"), t.nodes, t.keyed("registry"))


@query("ano5_all_anomalies", "reads", "nodes", "registry", sql=_ALL + "SELECT kind, severity, plate_canonical, detected_at, read_id FROM found")
def _(t):
    return _all(t).select("kind", "severity", "plate_canonical", "detected_at", F.element_at("read_ids", -1).alias("read_id"))


@query("ano6_distances", sql="""
SELECT event_id AS id, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(value / 10 - 27.7) / 2), 2) + cos(radians(27.7)) * cos(radians(value / 10)) * pow(sin(radians(1.5) / 2), 2))), 6) AS km FROM events""")
def _(t):
    km = G.haversine_km(F.lit(27.7), F.lit(83.0), F.col("value") / 10, F.lit(84.5))
    return t.events.select(F.col("event_id").alias("id"), F.round(km, 6).alias("km"))


@query("ano7_open_anomalies", "reads", "nodes", "registry", sql=_ALL + """
SELECT kind, severity, plate_canonical, detected_at, read_id FROM found ORDER BY detected_at DESC, kind, read_id DESC LIMIT 500""")
def _(t):
    rows = _all(t).withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    return N.open_anomalies(rows).select("kind", "severity", "plate_canonical", "detected_at", F.element_at("read_ids", -1).alias("read_id"))


_COLS = ", ".join(Q.SUMMARY)


@query("qry1_sightings", "reads", sql=f"""
SELECT {_COLS} FROM reads WHERE plate_canonical = {TARGET_SQL} AND captured_at >= TIMESTAMP '2024-01-03 00:00:00' AND captured_at <= TIMESTAMP '2024-01-28 00:00:00'
ORDER BY captured_at DESC, id DESC LIMIT 200""")
def _(t):
    return Q.sightings(t.keyed("reads"), target(t), "2024-01-03 00:00:00", "2024-01-28 00:00:00").select(*Q.SUMMARY)


@query("qry2_partial_plate", "reads", sql=f"""
SELECT {_COLS} FROM reads WHERE contains(plate_canonical, 'CHA-05') AND captured_at >= TIMESTAMP '2024-01-02 00:00:00' ORDER BY captured_at DESC, id DESC LIMIT 1000""")
def _(t):
    return Q.partial(t.reads, " cha-05 ", "2024-01-02 00:00:00", limit=5000).select(*Q.SUMMARY)


@query("qry3_live_feed", "reads", sql=f"""
SELECT {_COLS} FROM reads WHERE NOT provisional AND camera_id = 'CAM-view' AND captured_at >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 600 MINUTES
ORDER BY captured_at DESC, id DESC LIMIT 200""")
def _(t):
    return Q.live_feed(t.reads, "2024-01-30 23:00:00", minutes=600, camera_id="CAM-view").select(*Q.SUMMARY)


@query("qry4_zone_sessions", "zone_sessions", sql="""
SELECT session_id, zone_id, plate_canonical, entered_at, exited_at, dwell_seconds, close_reason, exited_at IS NULL AS open FROM zone_sessions
WHERE zone_id = '2-HIGH' AND exited_at IS NULL AND entered_at >= TIMESTAMP '1996-01-01 00:00:00' ORDER BY entered_at DESC, session_id DESC LIMIT 1000""")
def _(t):
    return Q.find_sessions(t.zone_sessions, zone_id="2-HIGH", open_only=True, since="1996-01-01 00:00:00", limit=1000).drop("expires_at")


@query("qry4_sessions_of_plate", "zone_sessions", sql=f"""
SELECT session_id, zone_id, entered_at, exited_at IS NULL AS open FROM zone_sessions WHERE plate_canonical = {TARGET_SQL} ORDER BY entered_at DESC, session_id DESC LIMIT 200""")
def _(t):
    return Q.find_sessions(t.keyed("zone_sessions"), plate_hmac=target(t)).select("session_id", "zone_id", "entered_at", "open")


@query("qry5_convoy", "reads", sql=f"""
, final AS (SELECT * FROM reads WHERE NOT provisional), a AS (SELECT * FROM final WHERE plate_canonical = {TARGET_SQL} ORDER BY captured_at DESC, id DESC LIMIT 1000)
SELECT r.plate_canonical AS plate, count(*) AS encounters, count(DISTINCT r.camera_id) AS distinct_cameras FROM a JOIN final r ON a.camera_id = r.camera_id
 AND r.captured_at BETWEEN a.captured_at - INTERVAL 900 SECONDS AND a.captured_at + INTERVAL 900 SECONDS AND r.plate_canonical <> a.plate_canonical
GROUP BY 1 HAVING count(DISTINCT r.camera_id) >= 2 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 50""")
def _(t):
    return Q.convoy(t.keyed("reads"), target(t), window_seconds=900)


@query("qry6_occupancy", "zone_sessions", sql="SELECT zone_id, count(*) FILTER (WHERE exited_at IS NULL) AS n_open FROM zone_sessions GROUP BY zone_id")
def _(t):
    return Q.occupancy(t.zone_sessions, t.zone_sessions)


@query("qry7_statistics", "reads", "zone_sessions", "reviews", "nodes", "registry", sql=_ALL + f""",
recent AS (SELECT * FROM reads WHERE NOT provisional AND captured_at >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOURS)
SELECT 240 AS window_hours, count(*) AS reads, count(*) FILTER (WHERE confidence = 'high') AS high_confidence, count(*) FILTER (WHERE NOT verified) AS unverified,
 count(DISTINCT plate_canonical) AS distinct_plates, (SELECT count(*) FROM zone_sessions WHERE exited_at IS NULL) AS open_sessions,
 (SELECT count(*) FROM reviews WHERE reviewed_at IS NULL) AS pending_review, (SELECT count(*) FROM found) AS open_anomalies FROM recent""")
def _(t):
    anomalies = _all(t).withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    return Q.statistics(t.keyed("reads"), t.zone_sessions, t.reviews, anomalies, AS_OF, hours=240)


@query("qry8_hourly_rollup", "reads", sql="""
SELECT date_trunc('hour', captured_at) AS bucket, camera_id, site_id, count(*) AS n_reads, count(*) FILTER (WHERE confidence = 'high') AS n_high,
 count(DISTINCT plate_canonical) AS n_distinct_plates FROM reads WHERE NOT provisional GROUP BY ALL""")
def _(t):
    return Q.hourly_rollup(t.keyed("reads"))


@query("qry9_review_queue", "reviews", sql="""
SELECT v.read_id, v.reason, v.machine_plate, v.queued_at, r.camera_id, r.captured_at, r.confidence FROM reviews v LEFT JOIN reads r ON v.read_id = r.id
WHERE v.reviewed_at IS NULL ORDER BY v.queued_at, v.read_id LIMIT 200""")
def _(t):
    return Q.review_queue(t.reviews, t.reads, limit=200).select(
        "read_id", "reason", "machine_plate", "queued_at", "camera_id", "captured_at", "confidence")


_DONE = """, done AS (SELECT v.read_id, v.reason, v.machine_plate, CASE WHEN s.corrected_text IS NOT NULL THEN false ELSE s.confirmed END AS confirmed, s.expected AS corrected_plate,
 s.reviewer AS reviewed_by, s.at_time AS reviewed_at FROM reviews v LEFT JOIN (SELECT * FROM submissions WHERE corrected_text IS NULL OR expected IS NOT NULL) s USING (read_id))
"""


@query("qry10_apply_reviews", "reviews", "submissions", sql=_DONE + "SELECT * FROM done")
def _(t):
    return Q.apply_reviews(t.reviews, t.submissions)[0].drop("queued_at")


@query("qry10_rejected_reviews", "submissions", sql="SELECT read_id, corrected_text FROM submissions WHERE corrected_text IS NOT NULL AND expected IS NULL")
def _(t):
    return Q.apply_reviews(t.reviews, t.submissions)[1].select("read_id", "corrected_text")


@query("qry11_review_precision", "reviews", "submissions", sql=_DONE + """
SELECT r.confidence, r.camera_id, count(*) AS n_reviewed, round(avg(cast(d.confirmed as int)), 9) AS "precision" FROM done d JOIN reads r ON d.read_id = r.id WHERE d.confirmed IS NOT NULL GROUP BY ALL""")
def _(t):
    return Q.review_precision(Q.apply_reviews(t.reviews, t.submissions)[0], t.reads).withColumn("precision", F.round("precision", 9))


@query("qry11_training_labels", "reviews", "submissions", sql=_DONE + "SELECT read_id, machine_plate, corrected_plate FROM done WHERE corrected_plate IS NOT NULL")
def _(t):
    return Q.training_labels(Q.apply_reviews(t.reviews, t.submissions)[0])


_PROV = values_sql([(z[1], z[3]) for z in R.ZONES], "zone", "province")


@query("qry13_by_province", "reads", sql=f"""
SELECT province, zone, count(*) AS n_reads, cast(grouping(province, zone) as bigint) AS level FROM (
 SELECT coalesce(p.province, cast(substr(plate_canonical, 6, 1) as int)) AS province, coalesce(p.zone, 'embossed') AS zone
 FROM (SELECT plate_canonical, CASE WHEN plate_system = 'embossed' THEN '-' ELSE plate_system END AS s, regexp_extract(plate_canonical, '^NP-L:([A-Z]+)-', 1) AS z FROM reads) r
 LEFT JOIN (SELECT zone, province FROM {_PROV}) p ON r.z = p.zone) x GROUP BY ROLLUP (province, zone)"""
       .replace("cast(substr(plate_canonical, 6, 1) as int)", "try_cast(substr(plate_canonical, 6, 1) as int)"))
def _(t):
    return Q.by_province(t.reads)
