"""Access log, retention, holds, erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import refdata as R
from ...operators import governance as V
from ...operators import retention as E
from ...operators import upkeep
from ...session import shared_dir
from .. import adapters as A
from ..adapters import SWEEP_AS_OF
from .registry import query, values_sql

_FOLD = """, fold AS (SELECT query_id, min(at_time) AS at_time, any_value(actor) AS actor, any_value(role) AS role, any_value(action) AS action, any_value(target) AS target, any_value(reason) AS reason,
 coalesce(max(result) FILTER (WHERE result <> 'started'), 'started') AS result, max(n_records) AS n_records FROM access_log GROUP BY query_id)
"""
_FOLD_COLS = ["query_id", "actor", "role", "action", "target", "reason", "result", "n_records"]


@query("gov1_folded_log", "access_log", sql=_FOLD + f"SELECT {', '.join(_FOLD_COLS)} FROM fold")
def _(t):
    return V.folded_log(t.access_log).select(*_FOLD_COLS)


_ALLOWED = values_sql([(a, r) for a, rs in R.PERMISSIONS.items() for r in rs], "action", "role")
_NEEDS = ", ".join(f"'{a}'" for a in R.REASON_REQUIRED)


@query("gov2_compliance", "access_log", sql=f"""
, judged AS (SELECT query_id, actor, role, action, (action, role) NOT IN (SELECT (action, role) FROM {_ALLOWED}) AS denied,
 action IN ({_NEEDS}) AND length(trim(reason, ' ' || chr(10) || chr(9) || chr(13))) < 8 AS short FROM access_log WHERE result = 'started')
SELECT query_id, denied, short AND NOT denied AS missing_reason FROM judged""")
def _(t):
    return V.compliance(t.access_log.filter("result = 'started'")).select("query_id", "denied", "missing_reason")


@query("gov3_unfinished", "access_log", sql=_FOLD + "SELECT query_id, actor, action FROM fold WHERE result = 'started'")
def _(t):
    return V.unfinished(t.access_log).select("query_id", "actor", "action")


@query("qry12_audit_trail", "access_log", sql=_FOLD + """
SELECT query_id, role, action, result FROM fold WHERE actor = 'user3' AND at_time >= TIMESTAMP '2024-01-01 00:30:00' ORDER BY at_time DESC, query_id DESC LIMIT 1000""")
def _(t):
    log = V.folded_log(t.access_log)
    return V.audit_trail(log, "user3", F.to_timestamp(F.lit("2024-01-01 00:30:00")), limit=1000).select("query_id", "role", "action", "result")


def _tables(t) -> dict:
    reads = t.keyed("reads")
    return {
        "reads": reads, "sessions": t.keyed("zone_sessions"),
        "unreadable": t.reads.filter("confidence = 'reject'").select(
            "id", (F.col("captured_at") + F.make_dt_interval(days=F.lit(R.UNREADABLE_DAYS))).alias("expires_at")),
        "hits": t.hits, "reviews": t.reviews, "blobs": t.blobs, "access_log": t.access_log,
    }


_EXPIRED = f"expires_at <= TIMESTAMP '{SWEEP_AS_OF}'"
_REFS = f"""SELECT plate_image_sha256 AS sha256 FROM reads WHERE expires_at > TIMESTAMP '{SWEEP_AS_OF}'
 UNION SELECT context_image_sha256 FROM reads WHERE expires_at > TIMESTAMP '{SWEEP_AS_OF}' AND context_image_sha256 IS NOT NULL"""
_USES = ("reads", "zone_sessions", "hits", "reviews", "blobs", "access_log")


@query("ret1_sweep_counts", *_USES, sql=f"""
, gone AS (SELECT id FROM reads WHERE {_EXPIRED}), refs AS ({_REFS})
SELECT 'reads' AS table_name, count(*) AS n_deleted FROM gone UNION ALL SELECT 'sessions', count(*) FROM zone_sessions WHERE {_EXPIRED}
UNION ALL SELECT 'unreadable', count(*) FROM reads WHERE confidence = 'reject' AND captured_at + to_days(90) <= TIMESTAMP '{SWEEP_AS_OF}'
UNION ALL SELECT 'hits', count(*) FROM hits WHERE read_id IN (SELECT id FROM gone) UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE read_id IN (SELECT id FROM gone)
UNION ALL SELECT 'blobs', count(*) FROM blobs WHERE {_EXPIRED} AND sha256 NOT IN (SELECT sha256 FROM refs)
UNION ALL SELECT 'audit', count(*) FROM access_log WHERE at_time <= TIMESTAMP '{SWEEP_AS_OF}' - to_days(2555)""")
def _(t):
    return E.sweep_counts(_tables(t), SWEEP_AS_OF)


@query("ret1_sweep_kept", *_USES, sql=f"""
, gone AS (SELECT id FROM reads WHERE {_EXPIRED}), refs AS ({_REFS})
SELECT 'reads' AS table_name, cast(id as string) AS key FROM reads WHERE NOT {_EXPIRED} UNION ALL SELECT 'sessions', session_id FROM zone_sessions WHERE NOT {_EXPIRED}
UNION ALL SELECT 'hits', cast(id as string) FROM hits WHERE read_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'reviews', cast(read_id as string) FROM reviews WHERE read_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'blobs', sha256 FROM blobs WHERE NOT ({_EXPIRED} AND sha256 NOT IN (SELECT sha256 FROM refs))""")
def _(t):
    kept = E.sweep(_tables(t), SWEEP_AS_OF)
    keys = {"reads": "id", "sessions": "session_id", "hits": "id", "reviews": "read_id", "blobs": "sha256"}
    out = None
    for name, k in keys.items():
        part = kept[name].select(F.lit(name).alias("table_name"), F.col(k).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def _keys(tables, keys):
    out = None
    for name, k in keys.items():
        part = tables[name].select(F.lit(name).alias("table_name"), F.col(k).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


@query("ret1_applied", *_USES, "watchlist", sql=f"""
, held AS (SELECT DISTINCT plate_canonical FROM watchlist WHERE category = 'MACHINERY'),
gone AS (SELECT id FROM reads WHERE {_EXPIRED} AND plate_canonical NOT IN (SELECT plate_canonical FROM held)),
refs AS (SELECT plate_image_sha256 AS sha256 FROM reads WHERE id NOT IN (SELECT id FROM gone) UNION SELECT context_image_sha256 FROM reads WHERE id NOT IN (SELECT id FROM gone) AND context_image_sha256 IS NOT NULL)
SELECT 'reads' AS table_name, cast(id as string) AS key FROM reads WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'sessions', session_id FROM zone_sessions WHERE NOT {_EXPIRED} OR coalesce(plate_canonical IN (SELECT plate_canonical FROM held), false)
UNION ALL SELECT 'hits', cast(id as string) FROM hits WHERE read_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'reviews', cast(read_id as string) FROM reviews WHERE read_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'blobs', sha256 FROM blobs WHERE NOT ({_EXPIRED} AND sha256 NOT IN (SELECT sha256 FROM refs))""")
def _(t):
    """Stored tables after holds were written into them and a sweep was carried out."""
    root = shared_dir(t.spark)
    upkeep.store(_tables(t), root)
    upkeep.apply_holds(t.spark, root, E.hold_for_case(t.keyed("watchlist").filter(_HELD), SWEEP_AS_OF))
    upkeep.apply_sweep(t.spark, root, SWEEP_AS_OF)
    return _keys(upkeep.stored(t.spark, root), {"reads": "id", "sessions": "session_id", "hits": "id", "reviews": "read_id", "blobs": "sha256"})


@query("ret2_removable_blobs", "reads", "blobs", sql=f"""
, refs AS ({_REFS}) SELECT sha256 FROM blobs WHERE {_EXPIRED} AND sha256 NOT IN (SELECT sha256 FROM refs)""")
def _(t):
    return E.removable_blobs(t.blobs, t.reads, SWEEP_AS_OF)


@query("ret3_overdue", "reads", "zone_sessions", "blobs", sql=f"""
SELECT *, n_overdue = 0 AS healthy FROM (SELECT 'reads' AS table_name, count(*) FILTER (WHERE {_EXPIRED}) AS n_overdue FROM reads
UNION ALL SELECT 'sessions', count(*) FILTER (WHERE {_EXPIRED}) FROM zone_sessions UNION ALL SELECT 'blobs', count(*) FILTER (WHERE {_EXPIRED}) FROM blobs
UNION ALL SELECT 'unreadable', count(*) FILTER (WHERE confidence = 'reject' AND captured_at + to_days(90) <= TIMESTAMP '{SWEEP_AS_OF}') FROM reads) t""")
def _(t):
    rows = _tables(t)
    return E.overdue({n: rows[n] for n in ("reads", "sessions", "blobs", "unreadable")}, SWEEP_AS_OF)


# Cases hold the plates of customers of one market segment.
_HELD = "category = 'MACHINERY'"


@query("ret4_legal_hold", "reads", "watchlist", sql=f"""
, held AS (SELECT DISTINCT plate_canonical FROM watchlist WHERE {_HELD})
SELECT id, CASE WHEN h.plate_canonical IS NOT NULL THEN TIMESTAMP '{SWEEP_AS_OF}' + to_days(365) ELSE expires_at END AS expires_at, h.plate_canonical IS NOT NULL AS held
FROM reads LEFT JOIN held h USING (plate_canonical)""")
def _(t):
    holds = E.hold_for_case(t.keyed("watchlist").filter(_HELD), SWEEP_AS_OF)
    return E.with_holds(t.keyed("reads"), holds).select("id", "expires_at", "held")


def _requests(t):
    w = t.keyed("watchlist").filter("category = 'BUILDING'")
    done = F.col("id") % 4 == 0
    return w.select(
        F.col("id").alias("request_id"), "plate_hmac", F.when(done, "done").otherwise("pending").alias("status"),
        F.when(done, F.lit(7).cast("bigint")).alias("reads_deleted"), F.when(done, F.lit(1).cast("bigint")).alias("sessions_deleted"),
        F.when(done, F.to_timestamp(F.lit("2024-01-20 00:00:00"))).alias("executed_at"),
    )


_TODO = ", req AS (SELECT id AS request_id, plate_canonical, id % 4 = 0 AS done FROM watchlist WHERE category = 'BUILDING'), todo AS (SELECT DISTINCT plate_canonical FROM req WHERE NOT done)\n"


@query("ret5_erasure_report", "reads", "zone_sessions", "watchlist", sql=_TODO + f"""
SELECT request_id, CASE WHEN done THEN 7 ELSE (SELECT count(*) FROM reads r WHERE r.plate_canonical = req.plate_canonical) END AS reads_deleted,
 CASE WHEN done THEN 1 ELSE (SELECT count(*) FROM zone_sessions s WHERE s.plate_canonical = req.plate_canonical) END AS sessions_deleted,
 CASE WHEN done THEN TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '{SWEEP_AS_OF}' END AS executed_at, 'done' AS status FROM req""")
def _(t):
    return E.erasure_report(_tables(t), _requests(t), SWEEP_AS_OF).drop("plate_hmac")


@query("ret5_erasure_kept", "reads", "zone_sessions", "hits", "reviews", "watchlist", sql=_TODO + """
, gone AS (SELECT id FROM reads WHERE plate_canonical IN (SELECT plate_canonical FROM todo))
SELECT 'reads' AS table_name, cast(id as string) AS key FROM reads WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'sessions', session_id FROM zone_sessions WHERE plate_canonical NOT IN (SELECT plate_canonical FROM todo)
UNION ALL SELECT 'hits', cast(id as string) FROM hits WHERE read_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'reviews', cast(read_id as string) FROM reviews WHERE read_id NOT IN (SELECT id FROM gone)""")
def _(t):
    kept = E.erase(_tables(t), _requests(t))
    keys = {"reads": "id", "sessions": "session_id", "hits": "id", "reviews": "read_id"}
    out = None
    for name, k in keys.items():
        part = kept[name].select(F.lit(name).alias("table_name"), F.col(k).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


@query("ret5_applied", "reads", "zone_sessions", "hits", "reviews", "watchlist", sql=_TODO + """
, gone AS (SELECT id FROM reads WHERE plate_canonical IN (SELECT plate_canonical FROM todo))
SELECT 'reads' AS table_name, cast(id as string) AS key FROM reads WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'sessions', session_id FROM zone_sessions WHERE coalesce(plate_canonical NOT IN (SELECT plate_canonical FROM todo), true)
UNION ALL SELECT 'hits', cast(id as string) FROM hits WHERE read_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'reviews', cast(read_id as string) FROM reviews WHERE read_id NOT IN (SELECT id FROM gone)""")
def _(t):
    """Stored tables after the pending requests were carried out."""
    root = shared_dir(t.spark)
    upkeep.store(_tables(t), root)
    upkeep.apply_erasure(t.spark, root, _requests(t), SWEEP_AS_OF)
    return _keys(upkeep.stored(t.spark, root), {"reads": "id", "sessions": "session_id", "hits": "id", "reviews": "read_id"})


@query("ret5_orphaned_images", "reads", "watchlist", sql=_TODO + """
, refs AS (SELECT plate_canonical, CASE WHEN id % 3 = 0 THEN sha256(plate_canonical) ELSE plate_image_sha256 END AS sha256 FROM reads
 UNION SELECT plate_canonical, context_image_sha256 FROM reads WHERE context_image_sha256 IS NOT NULL)
SELECT sha256 FROM refs GROUP BY sha256 HAVING bool_and(plate_canonical IN (SELECT plate_canonical FROM todo))""")
def _(t):
    """Every third read has an image that only reads of its plate share."""
    own = F.when(F.col("id") % 3 == 0, F.sha2(F.encode("plate_canonical", "UTF-8"), 256)).otherwise(F.col("plate_image_sha256"))
    return E.orphaned_images(t.keyed("reads").withColumn("plate_image_sha256", own), _requests(t))


_PRUNE_AS_OF = "2024-01-25 00:00:00"


@query("ret6_prune_events", "queue", sql=f"""
SELECT node_id, sequence FROM queue WHERE NOT (sent_at IS NOT NULL AND queued_at < TIMESTAMP '{_PRUNE_AS_OF}' - to_days(7))""")
def _(t):
    return E.prune_events(t.queue, _PRUNE_AS_OF).select("node_id", "sequence")


@query("ret6_prune_blobs", "queue", sql=f"""
SELECT DISTINCT json_extract_string(payload, '$.plate_image_sha256') AS sha256 FROM queue
WHERE NOT (sent_at IS NOT NULL AND queued_at < TIMESTAMP '{_PRUNE_AS_OF}' - to_days(7)) AND json_extract_string(payload, '$.plate_image_sha256') IS NOT NULL""")
def _(t):
    blobs = E.payload_refs(t.queue)
    return E.prune_blobs(blobs, E.prune_events(t.queue, _PRUNE_AS_OF))


@query("ret7_payload_refs", "signed_events", sql="""
SELECT DISTINCT json_extract_string(payload, '$.plate_image_sha256') AS sha256 FROM signed_events WHERE json_extract_string(payload, '$.plate_image_sha256') IS NOT NULL""")
def _(t):
    return E.payload_refs(t.signed_events)


@query("ret8_stored_reads", "reads", sql="""
, g AS (SELECT *, lag(sequence) OVER (PARTITION BY node_id ORDER BY sequence) AS ps FROM reads)
SELECT node_id, count(*) AS n_reads, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) FILTER (WHERE NOT signature_ok) AS signature_failures,
 count(*) FILTER (WHERE sequence <> ps + 1) AS n_gaps FROM g GROUP BY node_id""")
def _(t):
    from ...operators.chain import verify_stored_reads

    return verify_stored_reads(t.reads)


@query("ret8_stored_gaps", "reads", sql="""
SELECT node_id, ps + 1 AS gap_from, sequence - 1 AS gap_to FROM (SELECT *, lag(sequence) OVER (PARTITION BY node_id ORDER BY sequence) AS ps FROM reads) g WHERE sequence <> ps + 1""")
def _(t):
    from ...operators.chain import stored_gaps

    return stored_gaps(t.reads)


@query("ret9_expiry_policy", "signed_events", sql="""
SELECT CASE WHEN kind = 'plate_read' THEN 'reads' ELSE 'unreadable' END AS table_name,
 max(CASE WHEN kind = 'plate_read' THEN cast(captured_at as timestamp) + to_days(100) ELSE cast(captured_at as timestamp) + to_days(30) END) AS last_expiry, count(*) AS n
FROM (SELECT captured_at, payload, json_extract_string(payload, '$.kind') AS kind FROM signed_events) t
WHERE (kind = 'plate_read' AND json_extract_string(payload, '$.plate') <> '') OR kind = 'unreadable_passage' GROUP BY 1""")
def _(t):
    from ...operators.chain import with_verdict
    from ...operators.ingest import RetentionPolicy, project_reads, unreadable_passages

    policy = RetentionPolicy(reads_days=100, unreadable_days=30)
    a = project_reads(with_verdict(t.signed_events), t.hasher, policy).select(F.lit("reads").alias("table_name"), "expires_at")
    b = unreadable_passages(t.signed_events, policy).select(F.lit("unreadable").alias("table_name"), "expires_at")
    return a.unionByName(b).groupBy("table_name").agg(F.max("expires_at").alias("last_expiry"), F.count("*").alias("n"))
