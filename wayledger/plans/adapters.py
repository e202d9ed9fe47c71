"""Domain tables derived from the driver's tables.

Each adapter is one SELECT that means the same in Spark SQL and in the checker's SQL; the few
functions that are spelled differently come from a dialect. Spark gets DataFrames, the checker
gets common table expressions. Every adapter reads its whole source table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.once import once
from ..functions.plates import fields_of
from ..functions.pseudonym import PlateHasher
from ..sources.tables import SCHEMAS, load

# A published test key: pseudonyms of the driver's made-up plates protect nobody.
TEST_KEY = "wayledger-test-key-for-made-up-plates-0123456789"
AS_OF = "2024-02-01 00:00:00"
SWEEP_AS_OF = "2025-01-15 00:00:00"


class SparkSql:
    def sha(self, x): return f"sha2({x}, 256)"
    def b64(self, x): return f"base64(encode({x}, 'UTF-8'))"
    def iso(self, x): return f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    def days(self, x): return f"make_dt_interval(cast({x} as int))"
    def seconds(self, x): return f"make_dt_interval(0, 0, 0, cast({x} as int))"
    def series(self, n): return f"explode(sequence(0, {n} - 1))"
    def link(self, header, sig): return f"sha2(concat(encode({header}, 'UTF-8'), unbase64({sig})), 256)"
    def text(self, x): return f"encode({x}, 'UTF-8')"


class DuckSql:
    def sha(self, x): return f"sha256({x})"
    def b64(self, x): return f"to_base64(encode({x}))"
    def iso(self, x): return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%fZ')"
    def days(self, x): return f"to_days(cast({x} as integer))"
    def seconds(self, x): return f"to_seconds(cast({x} as integer))"
    def series(self, n): return f"unnest(range(0, {n}))"
    def link(self, header, sig): return f"sha256(encode({header}) || from_base64({sig}))"
    def text(self, x): return f"encode({x})"


SPARK, DUCK = SparkSql(), DuckSql()

_ZONES = ",".join(z[1] for z in R.ZONES)
_CLASSES = ",".join(c[1] for c in R.CLASSES)
_OWNERS = ",".join(c[2] for c in R.CLASSES)
_SIZES = ",".join(c[3] for c in R.CLASSES)
_ZONES_DEVA = ",".join(z[0] for z in R.ZONES)
_CLASSES_DEVA = ",".join(c[0].replace(".", "") for c in R.CLASSES)
_EMBOSSED = "A,B,C,D,E,F,G,H,I,J1,K"
_EMBOSSED_SIZES = ",".join(R.EMBOSSED_SIZE[c] for c in _EMBOSSED.split(","))


def pick(items: str, index: str) -> str:
    return f"split_part('{items}', ',', cast({index} + 1 as int))"


def _s(x: str) -> str:
    return f"cast({x} as string)"


def is_embossed(u: str) -> str:
    return f"({u}) % 3 = 0"


def serial(u: str) -> str:
    return f"lpad({_s(f'({u}) * 37 % 10000')}, 4, '0')"


def key(u: str) -> str:
    """Canonical plate of an integer."""
    return (
        f"CASE WHEN {is_embossed(u)} THEN 'NP-E:' || {_s(f'({u}) % 7 + 1')} || '-' || {pick(_EMBOSSED, f'({u}) % 11')}"
        f" || '-PA-' || {serial(u)} ELSE 'NP-L:' || {pick(_ZONES, f'({u}) % 14')} || '-' || {_s(f'({u}) % 10')}"
        f" || '-' || {pick(_CLASSES, f'({u}) % 13')} || '-' || {serial(u)} END"
    )


def owner(u: str) -> str:
    return f"CASE WHEN {is_embossed(u)} THEN 'unknown' ELSE {pick(_OWNERS, f'({u}) % 13')} END"


def size(u: str) -> str:
    return f"CASE WHEN {is_embossed(u)} THEN {pick(_EMBOSSED_SIZES, f'({u}) % 11')} ELSE {pick(_SIZES, f'({u}) % 13')} END"


def system(u: str) -> str:
    return f"CASE WHEN {is_embossed(u)} THEN 'embossed' ELSE 'devanagari' END"


def deva(x: str) -> str:
    return f"translate({x}, '0123456789', '{R.DEVA_DIGITS}')"


BAND = "CASE WHEN value < 2 THEN 'reject' WHEN value < 6 THEN 'low' WHEN value < 15 THEN 'medium' ELSE 'high' END"


def reads(d) -> str:
    u = "user_id"
    return f"""
SELECT event_id AS id, 'CAM-' || event_type AS node_id, 'CAM-' || event_type AS camera_id,
 'SITE-' || substr(event_type, 1, 1) AS site_id, event_id AS sequence, ts AS captured_at,
 ts + {d.days('365')} AS expires_at, cast(floor(event_id / 40) as bigint) AS track_id,
 {key(u)} AS plate_canonical, {system(u)} AS plate_system, {owner(u)} AS ownership, {size(u)} AS size_class,
 {BAND} AS confidence, event_id % 7 = 0 AS provisional, event_id % 50 <> 0 AS verified, value AS score,
 cast(event_id % 9 + 1 as int) AS n_frames, event_id % 77 <> 0 AS signature_ok,
 {pick(','.join([*R.COLOURS, 'unknown']), 'event_id % 8')} AS observed_colour,
 {pick('motorcycle,car,truck,bus,scooter,van', 'event_id % 6')} AS observed_vehicle_type,
 {d.sha("'img-' || " + _s("cast(floor(event_id / 10) as bigint)"))} AS plate_image_sha256,
 CASE WHEN event_id % 3 = 0 THEN {d.sha("'ctx-' || " + _s("cast(floor(event_id / 30) as bigint)"))} END AS context_image_sha256
FROM {{events}}"""


def blobs(d) -> str:
    """One plate image per ten events and one context image per thirty, shared by reads."""
    return f"""
SELECT {d.sha("'img-' || " + _s("k"))} AS sha256, bytes, first_ts + {d.days('90')} AS expires_at
FROM (SELECT cast(floor(event_id / 10) as bigint) AS k, min(ts) AS first_ts, cast(count(*) * 1000 as bigint) AS bytes FROM {{events}} GROUP BY floor(event_id / 10)) a
UNION ALL
SELECT {d.sha("'ctx-' || " + _s("k"))} AS sha256, bytes, first_ts + {d.days('90')} AS expires_at
FROM (SELECT cast(floor(event_id / 30) as bigint) AS k, min(ts) AS first_ts, cast(count(*) * 5000 as bigint) AS bytes FROM {{events}} GROUP BY floor(event_id / 30)) b"""


def watchlist(d) -> str:
    return f"""
SELECT c_custkey AS id, {key('c_custkey')} AS plate_canonical, c_mktsegment AS category, c_acctbal > 0 AS active,
 c_name AS reason, TIMESTAMP '2023-12-01 00:00:00' + {d.days('c_custkey % 30')} AS added_at,
 CASE WHEN c_custkey % 3 = 0 THEN cast(NULL as timestamp) WHEN c_custkey % 3 = 1 THEN TIMESTAMP '2024-06-01 00:00:00'
 ELSE TIMESTAMP '2024-01-15 00:00:00' END AS expires_at
FROM {{customer}}"""


def zone_sessions(d) -> str:
    return f"""
SELECT 'S' || {_s('o_orderkey')} AS session_id, o_orderpriority AS zone_id, {key('o_custkey')} AS plate_canonical,
 o_orderdate AS entered_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + {d.seconds('o_orderkey * 7 % 900')} END AS exited_at,
 CASE WHEN o_orderstatus <> 'O' THEN cast(o_orderkey * 7 % 900 as double) END AS dwell_seconds,
 CASE o_orderstatus WHEN 'F' THEN 'exited' WHEN 'P' THEN 'track_lost' END AS close_reason,
 o_orderdate + {d.days('365')} AS expires_at
FROM {{orders}}"""


def nodes(d) -> str:
    lat = "CASE event_type WHEN 'click' THEN 27.70 WHEN 'view' THEN 28.21 WHEN 'error' THEN 26.45 WHEN 'signup' THEN 28.05 ELSE 27.66 END"
    lon = "CASE event_type WHEN 'click' THEN 85.32 WHEN 'view' THEN 83.99 WHEN 'error' THEN 87.27 WHEN 'signup' THEN 81.62 ELSE 85.43 END"
    return f"""
SELECT 'CAM-' || event_type AS node_id, cast({lat} as double) AS latitude, cast({lon} as double) AS longitude,
 'KEY-' || event_type AS public_key, event_type <> 'signup' AS active
FROM (SELECT event_type FROM {{events}} GROUP BY event_type) t"""


def registry(d) -> str:
    return f"""
SELECT {key('c_custkey')} AS plate_canonical, cast(c_nationkey % 7 + 1 as int) AS registered_province FROM {{customer}}"""


def plate_texts(d) -> str:
    """Free spellings of a plate next to the key each must parse to (null for a bad one)."""
    u = "user_id"
    z, lot, c, s = pick(_ZONES, f"{u} % 14"), _s(f"{u} % 10"), pick(_CLASSES, f"{u} % 13"), serial(u)
    p, e = _s(f"{u} % 7 + 1"), pick(_EMBOSSED, f"{u} % 11")
    zd, cd = pick(_ZONES_DEVA, f"{u} % 14"), pick(_CLASSES_DEVA, f"{u} % 13")
    legacy = f"""CASE event_id % 6 WHEN 0 THEN 'NP-L:' || {z} || '-' || {lot} || '-' || {c} || '-' || {s}
 WHEN 1 THEN '  ' || {z} || ' ' || {lot} || ' ' || {c} || ' ' || {s} WHEN 2 THEN lower({z} || '-' || {lot} || '-' || {c} || '-' || {s})
 WHEN 3 THEN {zd} || ' ' || {deva(lot)} || ' ' || {cd} || ' ' || {deva(s)}
 WHEN 4 THEN {z} || '.' || {deva(lot)} || '/' || {c} || '|' || {deva(s)} ELSE 'QX ' || {lot} || ' ' || {c} || ' ' || {s} END"""
    embossed = f"""CASE event_id % 6 WHEN 0 THEN 'NP-E:' || {p} || '-' || {e} || '-PA-' || {s} WHEN 1 THEN {p} || ' ' || {e} || ' PA ' || {s}
 WHEN 2 THEN lower('nep ' || {p} || {e} || ' pa ' || {s}) WHEN 3 THEN 'NEP' || {p} || {e} || 'PA' || {s}
 WHEN 4 THEN ' ' || {p} || '.' || {e} || '_PA·' || {s} ELSE '8 ' || {e} || ' PA ' || {s} END"""
    return f"""
SELECT event_id AS id, user_id, CASE WHEN {is_embossed(u)} THEN {embossed} ELSE {legacy} END AS text,
 CASE WHEN event_id % 6 <> 5 THEN {key(u)} END AS expected,
 {pick(','.join([*R.COLOURS, 'unknown']), 'event_id % 8')} AS observed_colour
FROM {{events}}"""


_KINDS = "plate_read,plate_read,plate_read,plate_read,plate_read,zone_entry,zone_exit,session_plate,unreadable_passage,heartbeat"


def signed_events(d) -> str:
    """Hash-chained log: 8 nodes in turns of ten events, links made over pairs of events."""
    cam = "'\"camera_id\":\"CAM-' || event_type || '\"'"
    sid = f"'S' || {_s('cast(floor(event_id / 10) as bigint)')}"
    track = _s("cast(floor(event_id / 40) as bigint)")
    read = (
        f"'{{{{' || {cam} || ',\"confidence\":\"' || {BAND} || '\",\"kind\":\"plate_read\",\"n_frames\":' || {_s('event_id % 9 + 1')}"
        f" || ',\"plate\":\"' || CASE WHEN event_id % 40 = 3 THEN '' ELSE {key('user_id')} END || '\",\"plate_image_sha256\":\"'"
        f" || {d.sha(_s('user_id'))} || '\",\"provisional\":' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END"
        f" || ',\"score\":0.' || {_s('event_id % 9 + 1')} || ',\"track_id\":' || {track} || '}}}}'"
    )
    zone = (
        f"'{{{{' || {cam} || CASE WHEN event_id % 10 = 6 THEN ',\"close_reason\":\"exited\",\"dwell_seconds\":' || {_s('event_id % 900')} || '.5' ELSE '' END"
        f" || ',\"entered_at\":\"' || {d.iso('ts')} || '\"' || CASE WHEN event_id % 10 = 6 THEN ',\"exited_at\":\"' || {d.iso('ts + ' + d.seconds('event_id % 900'))} || '\"' ELSE '' END"
        f" || ',\"kind\":\"' || CASE WHEN event_id % 10 = 5 THEN 'zone_entry' ELSE 'zone_exit' END || '\",\"session_id\":\"' || {sid}"
        f" || '\",\"track_id\":' || {track} || ',\"zone_id\":\"Z' || {_s('user_id % 5')} || '\"}}}}'"
    )
    plate = (
        f"'{{{{' || {cam} || ',\"confidence\":\"high\",\"kind\":\"session_plate\",\"plate\":\"' || {key('user_id')}"
        f" || '\",\"sessions\":[\"' || {sid} || '\",\"S-none\"]}}}}'"
    )
    unread = (
        f"'{{{{\"best_crop_quality\":0.' || {_s('event_id % 9 + 1')} || ',' || {cam} || ',\"kind\":\"unreadable_passage\",\"n_crops\":'"
        f" || {_s('event_id % 5')} || '}}}}'"
    )
    other = "'{{{{\"kind\":\"heartbeat\"}}}}'".replace("{{{{", "{{").replace("}}}}", "}}")
    payload = f"CASE WHEN event_id % 10 < 5 THEN {read} WHEN event_id % 10 < 7 THEN {zone} WHEN event_id % 10 = 7 THEN {plate} WHEN event_id % 10 = 8 THEN {unread} ELSE {other} END"
    payload = payload.replace("{{{{", "{{").replace("}}}}", "}}")

    def header(p: str, prev: str) -> str:
        return (
            f"'{{{{\"captured_at\":\"' || {p}captured_at || '\",\"node_id\":\"' || node_id || '\",\"payload_hash\":\"' || {p}payload_hash"
            f" || '\",\"prev_hash\":\"' || {prev} || '\",\"sequence\":' || {_s(p + 'sequence')} || '}}}}'"
        ).replace("{{{{", "{{").replace("}}}}", "}}")

    w = "OVER (PARTITION BY floor(event_id / 2) ORDER BY event_id)"
    return f"""
SELECT event_id, node_id, sequence, captured_at, payload, payload_hash, signature, signature_ok,
 CASE WHEN p_captured_at IS NULL THEN '{R.GENESIS}' ELSE {d.link(header('p_', f"'{R.GENESIS}'"), 'p_signature')} END AS prev_hash,
 received_at, user_id, event_type
FROM (
 SELECT *, lag(captured_at) {w} AS p_captured_at, lag(payload_hash) {w} AS p_payload_hash,
  lag(signature) {w} AS p_signature, lag(sequence) {w} AS p_sequence
 FROM (
  SELECT *, {d.sha("payload || CASE WHEN event_id % 50 = 0 THEN 'x' ELSE '' END")} AS payload_hash FROM (
   SELECT event_id, user_id, event_type, 'NODE-' || {_s('cast(floor(event_id / 10) as bigint) % 8')} AS node_id,
    cast(floor(event_id / 80) as bigint) * 10 + event_id % 10 + 1 + cast(floor(event_id / 5000) as bigint) * 3 AS sequence,
    {d.iso('ts')} AS captured_at, {payload} AS payload, {d.b64("'sig-' || " + _s('event_id'))} AS signature,
    event_id % 77 <> 0 AS signature_ok, ts + {d.seconds('event_id % 120')} AS received_at
   FROM {{events}}) a) b) c"""


def deliveries(d) -> str:
    """The log as it arrives: some events late, some twice."""
    cols = "node_id, sequence, captured_at, payload, payload_hash, signature, signature_ok, prev_hash, received_at, event_id"
    batch = f"'B' || {_s('cast(floor(event_id / 128) as bigint)')}"
    return f"""
SELECT {cols}, {batch} AS batch_id, event_id * 4 + CASE WHEN event_id % 50 = 7 THEN 402 ELSE 0 END AS arrival FROM {{signed_events}}
UNION ALL
SELECT {cols}, {batch} || 'R' AS batch_id, event_id * 4 + 81 AS arrival FROM {{signed_events}} WHERE event_id % 20 = 3"""


def queue(d) -> str:
    """Delivery queue of the nodes: older events are acknowledged, some were never sent."""
    return f"""
SELECT event_id, node_id, sequence, captured_at, payload, received_at AS queued_at,
 CASE WHEN event_id % 9 <> 0 THEN received_at + {d.seconds('60')} END AS sent_at, event_id % 4 AS attempts
FROM {{signed_events}}"""


def access_log(d) -> str:
    """Two rows per query where it completed: the start and the outcome."""
    at = f"TIMESTAMP '2024-01-01 00:00:00' + {d.seconds('conv_id * 600 + turn * 7')}"
    base = f"""'Q' || {_s('conv_id')} || '-' || {_s('turn')} AS query_id, 'user' || {_s('conv_id % 20')} AS actor,
 CASE role WHEN 'user' THEN 'investigator' WHEN 'assistant' THEN 'operator' ELSE 'auditor' END AS role,
 {pick('read.search,read.live,watchlist.write,audit.read', 'turn % 4')} AS action, 'conv ' || {_s('conv_id')} AS target, text AS reason"""
    return f"""
SELECT {base}, {at} AS at_time, 'started' AS result, cast(NULL as bigint) AS n_records FROM {{conversations}}
UNION ALL
SELECT {base}, {at} + {d.seconds('2')} AS at_time, CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'invalid_plate' END AS result,
 cast(length(text) % 100 as bigint) AS n_records FROM {{conversations}} WHERE turn % 3 <> 2"""


def track_frames(d) -> str:
    """Three vehicles per camera frame, each crossing the view in fifty frames; some are missed."""
    return f"""
SELECT camera_id, frame_index, ts, cast(floor(frame_index / 50) as bigint) * 3 + j AS track_id, x, y, w, value, event_id, j
FROM (
 SELECT event_id, 'CAM' || {_s('cast(floor(event_id / 1000) as bigint)')} AS camera_id, event_id % 1000 AS frame_index, ts, value, j,
  (event_id % 50) * 8 + value % 10 - j * 20 AS x, 50 + j * 12 + user_id % 25 AS y, 40 + value % 30 AS w
 FROM (SELECT event_id, user_id, ts, value, {d.series('3')} AS j FROM {{events}}) a) b
WHERE (event_id * 7 + j * 5) % 23 <> 0"""


def candidates(d) -> str:
    """Two ranked decodings per frame of a track; most frames agree on the track's plate."""
    track = "cast(floor(event_id / 40) as bigint)"
    u0 = f"({track} + CASE WHEN user_id % 5 = 0 THEN 42 WHEN user_id % 7 = 0 THEN 1 ELSE 0 END)"
    u1 = f"({track} + CASE WHEN user_id % 2 = 0 THEN 42 ELSE 0 END)"
    return f"""
SELECT 'T' || {_s('track')} AS track_id, event_id AS frame, rank, quality, canonical, system, score,
 CASE WHEN score >= 0.75 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'reject' END AS confidence
FROM (
 SELECT {track} AS track, event_id, 0 AS rank, (value % 10 + 0.5) / 10.5 AS quality, {key(u0)} AS canonical, {system(u0)} AS system,
  0.3 + (value % 7) / 10 AS score FROM {{events}}
 UNION ALL
 SELECT {track} AS track, event_id, 1 AS rank, (value % 10 + 0.5) / 10.5 AS quality, {key(u1)} AS canonical, {system(u1)} AS system,
  0.1 + (value % 3) / 10 AS score FROM {{events}}) a"""


def eval_samples(d) -> str:
    return f"""
SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'devanagari' ELSE 'embossed' END AS system, cast(d.n_chars % 200 as int) AS width_px,
 cast(d.doc_id % 100 as double) / 100 AS quality, d.doc_id % 2 = 0 AS two_row, coalesce(l.quality, 0) = 1 AS greedy_ok,
 coalesce(l.quality, 0) = 1 OR d.doc_id % 10 = 0 AS grammar_ok, coalesce(l.quality, 0) = 1 OR d.doc_id % 5 = 0 AS colour_ok,
 CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'reject' WHEN l.doc_id IS NULL THEN 'low' WHEN d.n_chars > 1000 THEN 'medium' ELSE 'high' END AS confidence
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id"""


def corpus(d) -> str:
    return f"""
SELECT event_id AS i, 'images/' || lpad({_s('cast(floor(event_id / 1000) as bigint)')}, 5, '0') || '/' || lpad({_s('event_id')}, 8, '0') || '.jpg' AS path,
 {key('user_id')} AS canonical, {system('user_id')} AS system, 'T' || {_s('cast(floor(event_id / 12) as bigint)')} AS track_id,
 event_id % 12 AS frame, cast(floor(20 + value * 2) as int) AS width_px, value / 500 AS quality, user_id % 3 = 2 AS two_row,
 event_id % 14 = 0 AS grid_seeded, event_id % 97 <> 96 AS font_authentic
FROM {{events}}"""


def hits(d) -> str:
    return f"""
SELECT r.id * 100000 + w.id % 100000 AS id, r.id AS read_id, w.id AS watchlist_id, r.captured_at + {d.seconds('1')} AS matched_at, r.confidence,
 r.confidence = 'high' AS actionable
FROM {{reads}} r JOIN {{watchlist}} w ON r.plate_canonical = w.plate_canonical WHERE r.verified AND w.active"""


def acknowledgements(d) -> str:
    return f"""
SELECT id AS hit_id, 'user' || {_s('id % 9')} AS actor, matched_at + {d.seconds('30')} AS at_time FROM {{hits}} WHERE id % 3 = 0
UNION ALL
SELECT id AS hit_id, 'chief' AS actor, matched_at + {d.seconds('90')} AS at_time FROM {{hits}} WHERE id % 6 = 0"""


def reviews(d) -> str:
    return """
SELECT id AS read_id, captured_at AS queued_at, 'confidence_' || confidence AS reason, plate_canonical AS machine_plate,
 cast(NULL as boolean) AS confirmed, cast(NULL as string) AS corrected_plate, cast(NULL as string) AS reviewed_by,
 cast(NULL as timestamp) AS reviewed_at
FROM {reads} WHERE confidence <> 'high' AND NOT provisional"""


def submissions(d) -> str:
    """Review outcomes: confirmations, corrections in free spelling, and corrections that do not parse."""
    return f"""
SELECT id AS read_id, id % 2 = 0 AS confirmed, CASE WHEN id % 5 = 1 THEN lower(substr(plate_canonical, 6)) WHEN id % 5 = 2 THEN 'not a plate' END AS corrected_text,
 CASE WHEN id % 5 = 1 THEN plate_canonical END AS expected, 'rev' || {_s('id % 4')} AS reviewer, captured_at + {d.seconds('3600')} AS at_time
FROM {{reads}} WHERE confidence <> 'high' AND NOT provisional AND id % 4 <> 0"""


SOURCES = {
    f.__name__: f for f in (
        reads, blobs, watchlist, zone_sessions, nodes, registry, plate_texts, signed_events, deliveries, queue, access_log,
        track_frames, candidates, eval_samples, corpus, hits, acknowledgements, reviews, submissions,
    )
}
_REF = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def dependencies(name: str) -> list[str]:
    return sorted(set(_REF.findall(SOURCES[name](DUCK))))


def ctes(*names: str) -> str:
    """``WITH`` clause holding the named adapters and what they depend on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in SCHEMAS or name in order:
            return
        for dep in dependencies(name):
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        text = SOURCES[name](DUCK)
        text = text.format(**{dep: dep for dep in dependencies(name)})
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """Raw and derived tables of one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # Results are compared as UTC instants.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.hasher = PlateHasher(TEST_KEY)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in SCHEMAS:
                self._built[name] = load(self.spark, self.sf_dir, name)
            elif name in SOURCES:
                deps = {dep: getattr(self, dep) for dep in dependencies(name)}
                built = self.spark.sql(SOURCES[name](SPARK), **deps)
                # ``at`` is a keyword for the checker, so the shared text says ``at_time``.
                self._built[name] = built.withColumnRenamed("at_time", "at")
            else:
                raise AttributeError(name)
        return self._built[name]

    def keyed(self, name: str) -> DataFrame:
        """A table with the pseudonym of its plate, as stored tables have it."""
        return once(getattr(self, name), plate_hmac=self.hasher.hash(F.col("plate_canonical")))

    @cached_property
    def frames(self) -> DataFrame:
        """Track frames with typed ids and boxes."""
        return self.track_frames.select(
            "camera_id", F.col("frame_index").cast("bigint").alias("frame_index"), "ts",
            F.col("track_id").cast("bigint").alias("track_id"),
            F.struct(
                (F.col("x") - F.col("w") / 2).alias("x1"), (F.col("y") - 30.0).alias("y1"),
                (F.col("x") + F.col("w") / 2).alias("x2"), F.col("y").cast("double").alias("y2"),
            ).alias("box"),
            "value", "event_id", "j",
        )

    @cached_property
    def zones(self) -> DataFrame:
        """A square and a triangle per camera."""
        square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in SQUARE])
        triangle = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in TRIANGLE])
        kinds = F.array(
            F.struct(F.lit("square").alias("n"), square.alias("p"), F.lit(2).alias("a"), F.lit(2).alias("b")),
            F.struct(F.lit("triangle").alias("n"), triangle.alias("p"), F.lit(3).alias("a"), F.lit(4).alias("b")),
        )
        cams = self.frames.select("camera_id").distinct()
        return cams.select("camera_id", F.explode(kinds).alias("z")).select(
            "camera_id", F.col("z.n").alias("zone_id"), F.col("z.p").alias("polygon"), F.lit(DWELL).alias("max_dwell_seconds"),
            F.col("z.a").alias("enter_frames"), F.col("z.b").alias("exit_frames"),
        )

    @cached_property
    def candidate_rows(self) -> DataFrame:
        """Ranked decodings with their fields, scored as the candidate is."""
        return fields_of(self.candidates, "canonical", F.col("score"))

    @cached_property
    def evidence(self) -> DataFrame:
        """Frame evidence: embeddings cut into eight timesteps of eight classes."""
        grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(
            F.col("embedding").cast("array<double>"), t * 8 + 1, F.lit(8)))
        mass = [(c, F.abs(F.col("embedding")[i].cast("double")) * 6) for i, c in enumerate(R.COLOURS)]
        return self.embeddings.select(
            F.col("label").cast("string").alias("track_id"), F.col("vec_id").alias("frame"),
            ((F.col("vec_id") % 10 + 1) / 10.0).alias("quality"), grid.alias("log_probs"),
            F.create_map(*[x for c, m in mass for x in (F.lit(c), m)]).alias("colour"),
            (F.col("vec_id") % 6 != 0).alias("colour_reliable"),
        )


SQUARE = [(100, 20), (300, 20), (300, 80), (100, 80)]
TRIANGLE = [(60, 30), (340, 50), (200, 110)]
DWELL = 600.0
