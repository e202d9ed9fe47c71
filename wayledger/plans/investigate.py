"""Investigative queries over reads and sessions.

The functions are plain plans; :class:`Investigator` runs them behind permission, purpose
and an access-log row written before any data is touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.plates import with_canonical
from ..functions.pseudonym import PlateHasher
from ..operators import governance as gov
from ..operators.screening import at
from ..session import materialise

#: Characters that a partial plate must have.
MIN_FRAGMENT = 3
#: Bytes below which a file of the access log is merged with others.
SMALL_FILE = 32 << 20


class InvalidSearch(ValueError):
    """A search that cannot run; ``code`` goes to the access log."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


SUMMARY = [
    "id", "captured_at", "camera_id", "site_id", "plate_canonical", "confidence", "score", "verified",
]


def _newest(rows: DataFrame, limit: int, time: str = "captured_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(min(limit, R.MAX_LIMIT))


def sightings(reads: DataFrame, plate_hmac: str | Column, since=None, until=None, limit: int = 200) -> DataFrame:
    """All reads of one pseudonym, newest first; both time bounds are inclusive."""
    rows = reads.filter(F.col("plate_hmac") == plate_hmac)
    if since is not None:
        rows = rows.filter(F.col("captured_at") >= at(since))
    if until is not None:
        rows = rows.filter(F.col("captured_at") <= at(until))
    return _newest(rows, limit)


def partial(reads: DataFrame, fragment: str, since=None, limit: int = 200) -> DataFrame:
    """Reads whose plate contains the fragment literally; at least three characters."""
    wanted = fragment.strip().upper()
    if len(wanted) < MIN_FRAGMENT:
        raise InvalidSearch("fragment_too_short", f"{len(wanted)} characters would match too many plates: give {MIN_FRAGMENT} or more")
    from_time = F.lit(True) if since is None else F.col("captured_at") >= at(since)
    return _newest(reads.filter(from_time & F.col("plate_canonical").contains(wanted)), limit)


def live_feed(reads: DataFrame, as_of, minutes: int = 15, camera_id: str | None = None, limit: int = 200) -> DataFrame:
    rows = reads.filter(
        (F.col("captured_at") >= at(as_of) - F.make_dt_interval(mins=F.lit(minutes))) & ~F.col("provisional")
    )
    if camera_id:
        rows = rows.filter(F.col("camera_id") == camera_id)
    return _newest(rows, limit)


def find_sessions(
    sessions: DataFrame, zone_id: str | None = None, plate_hmac=None, open_only: bool = False,
    since=None, limit: int = 200,
) -> DataFrame:
    rows = sessions
    if zone_id:
        rows = rows.filter(F.col("zone_id") == zone_id)
    if plate_hmac is not None:
        rows = rows.filter(F.col("plate_hmac") == plate_hmac)
    if open_only:
        rows = rows.filter("exited_at is null")
    if since is not None:
        rows = rows.filter(F.col("entered_at") >= at(since))
    return _newest(rows.withColumn("open", F.col("exited_at").isNull()), limit, "entered_at", "session_id")


def convoy(
    reads: DataFrame, plate_hmac: str | Column, window_seconds: int = 120, min_shared: int = 2, limit: int = 50
) -> DataFrame:
    """Other plates seen with the target at several cameras within the window.

    Anchors are the target's newest reads, at most ``MAX_LIMIT``: that bound makes them the
    broadcast side, so reads of a busy camera are never shuffled. The time bucket keeps each
    read from meeting every anchor of its camera; counts are pre-aggregated before the shuffle.
    """
    if not (10 <= window_seconds <= 900 and 1 <= min_shared <= 20):
        raise ValueError("window must be 10-900 s and min_shared 1-20")
    final = reads.filter(~F.col("provisional"))
    w = window_seconds * 1_000_000
    bucket = F.floor(F.unix_micros("captured_at") / F.lit(w)).cast("bigint")
    anchors = (
        final.filter(F.col("plate_hmac") == plate_hmac)
        .orderBy(F.col("captured_at").desc(), F.col("id").desc()).limit(R.MAX_LIMIT)
        .select("camera_id", F.unix_micros("captured_at").alias("_t"),
                F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    )
    others = final.filter(F.col("plate_hmac") != plate_hmac).withColumn("_bucket", bucket)
    met = others.join(F.broadcast(anchors), ["camera_id", "_bucket"]).filter(
        F.abs(F.unix_micros("captured_at") - F.col("_t")) <= w
    )
    per_camera = met.groupBy("plate_hmac", "camera_id").agg(
        F.count("*").alias("n"), F.min("plate_canonical").alias("plate")
    )
    return (
        per_camera.groupBy("plate_hmac")
        .agg(F.min("plate").alias("plate"), F.sum("n").alias("encounters"), F.count("*").alias("distinct_cameras"))
        .filter(F.col("distinct_cameras") >= min_shared)
        .orderBy(F.col("distinct_cameras").desc(), F.col("encounters").desc(), "plate").limit(limit)
        .select("plate", "encounters", "distinct_cameras")
    )


def occupancy(sessions: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Open sessions per zone; with ``zones`` given, empty zones show as 0."""
    counts = sessions.filter("exited_at is null").groupBy("zone_id").agg(F.count("*").alias("n_open"))
    if zones is None:
        return counts
    return zones.select("zone_id").distinct().join(counts, "zone_id", "left").fillna(0, ["n_open"])


def statistics(
    reads: DataFrame, sessions: DataFrame, reviews: DataFrame, anomalies: DataFrame, as_of, hours: int = 24
) -> DataFrame:
    """Dashboard counts in one row. No plate leaves this function.

    Each source is reduced to one row of counters; the rows are added up, so no cross join.
    """
    recent = reads.filter(
        (F.col("captured_at") >= at(as_of) - F.make_dt_interval(hours=F.lit(hours))) & ~F.col("provisional")
    )
    counters = ["reads", "high_confidence", "unverified", "distinct_plates", "open_sessions", "pending_review", "open_anomalies"]

    def part(df: DataFrame, **aggs: Column) -> DataFrame:
        one = df.agg(*[c.alias(n) for n, c in aggs.items()])
        return one.select(*[F.col(n) if n in aggs else F.lit(0).cast("bigint").alias(n) for n in counters])

    rows = part(
        recent, reads=F.count("*"), high_confidence=F.count_if(F.col("confidence") == "high"),
        unverified=F.count_if(~F.col("verified")), distinct_plates=F.count_distinct("plate_hmac"),
    ).unionByName(part(sessions, open_sessions=F.count_if(F.col("exited_at").isNull())))
    rows = rows.unionByName(part(reviews, pending_review=F.count_if(F.col("reviewed_at").isNull())))
    rows = rows.unionByName(part(anomalies, open_anomalies=F.count_if(F.col("reviewed_at").isNull())))
    return rows.agg(*[F.sum(c).alias(c) for c in counters]).select(F.lit(hours).alias("window_hours"), *counters)


def hourly_rollup(reads: DataFrame) -> DataFrame:
    """Final reads per hour, camera and site."""
    return (
        reads.filter(~F.col("provisional"))
        .groupBy(F.date_trunc("hour", "captured_at").alias("bucket"), "camera_id", "site_id")
        .agg(
            F.count("*").alias("n_reads"), F.count_if(F.col("confidence") == "high").alias("n_high"),
            F.count_distinct("plate_hmac").alias("n_distinct_plates"),
        )
    )


_HOUR_KEY = ["bucket", "camera_id", "site_id", "plate_hmac"]


def hourly_keys(reads: DataFrame) -> DataFrame:
    """Final reads per hour, camera, site and pseudonym, with their ``day``: parts of the roll-up."""
    return (
        reads.filter(~F.col("provisional"))
        .groupBy(F.date_trunc("hour", "captured_at").alias("bucket"), "camera_id", "site_id", "plate_hmac")
        .agg(F.count("*").alias("n_reads"), F.count_if(F.col("confidence") == "high").alias("n_high"))
        .withColumn("day", F.to_date("bucket"))
    )


def merged_keys(keys: DataFrame) -> DataFrame:
    """Keys of several batches as one row a key."""
    return keys.groupBy("day", *_HOUR_KEY).agg(F.sum("n_reads").alias("n_reads"), F.sum("n_high").alias("n_high"))


def rollup_of_keys(keys: DataFrame) -> DataFrame:
    """The rows of :func:`hourly_rollup` of stored keys, with ``day``; plates that several batches saw count once."""
    return merged_keys(keys).groupBy("day", *_HOUR_KEY[:3]).agg(
        F.sum("n_reads").alias("n_reads"), F.sum("n_high").alias("n_high"), F.count("plate_hmac").alias("n_distinct_plates"))


def review_queue(reviews: DataFrame, reads: DataFrame, limit: int = 50) -> DataFrame:
    """Oldest unreviewed items with their read; the page is cut before the join."""
    page = reviews.filter("reviewed_at is null").orderBy("queued_at", "read_id").limit(min(limit, R.MAX_LIMIT))
    r = reads.select(F.col("id").alias("read_id"), "camera_id", "captured_at", "confidence")
    found = r.join(F.broadcast(page.select("read_id").distinct()), "read_id", "left_semi")
    return page.join(found, "read_id", "left")


def apply_reviews(items: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(items, rejected submissions)``: a correction must parse and unconfirms the item."""
    keyed = with_canonical(submissions, "corrected_text", "corrected_plate")
    given = F.coalesce("corrected_text", F.lit("")) != ""
    bad = given & F.col("corrected_plate").isNull()
    latest = keyed.filter(~bad).groupBy("read_id").agg(
        F.max_by(F.struct(
            F.when(given, False).otherwise(F.col("confirmed")).alias("confirmed"),
            F.when(given, F.col("corrected_plate")).alias("corrected_plate"),
            F.col("reviewer").alias("reviewed_by"),
            F.col("at").alias("reviewed_at"),
        ), "at").alias("r")
    ).select("read_id", "r.*")
    base = items.drop("confirmed", "corrected_plate", "reviewed_by", "reviewed_at")
    return base.join(latest, "read_id", "left"), keyed.filter(bad).drop("corrected_plate")


def review_precision(items: DataFrame, reads: DataFrame) -> DataFrame:
    """Share of reviewed reads confirmed, per band and camera."""
    r = reads.select(F.col("id").alias("read_id"), "confidence", "camera_id")
    done = items.filter("confirmed is not null").join(r, "read_id")
    return done.groupBy("confidence", "camera_id").agg(
        F.count("*").alias("n_reviewed"), F.avg(F.col("confirmed").cast("double")).alias("precision")
    )


def training_labels(items: DataFrame) -> DataFrame:
    """Corrected reads, as labels for real imagery."""
    return items.filter("corrected_plate is not null").select("read_id", "machine_plate", "corrected_plate")


def by_province(reads: DataFrame) -> DataFrame:
    """Reads per province and zone with subtotals; embossed plates name their province."""
    from ..functions.plates import lookup

    zone = F.nullif(F.regexp_extract("plate_canonical", "^NP-L:([A-Z]+)-", 1), F.lit(""))
    number = F.nullif(F.regexp_extract("plate_canonical", "^NP-E:([1-7])-", 1), F.lit(""))
    province = F.coalesce(lookup({z[1]: z[3] for z in R.ZONES}, zone), number.cast("int"))
    placed = reads.select(province.alias("province"), F.coalesce(zone, F.lit("embossed")).alias("zone"))
    return placed.rollup("province", "zone").agg(F.count("*").alias("n_reads"), F.grouping_id().alias("level"))


class Investigator:
    """The governed route to read data: authorise, log, then plan the query.

    ``audit_path`` is an append-only Parquet folder. A query that fails before completing
    keeps its ``started`` row; invalid searches are completed with a reason code.
    """

    def __init__(self, spark: SparkSession, hasher: PlateHasher, tables: dict[str, DataFrame], audit_path: str):
        self.spark, self.hasher, self.tables, self.audit_path = spark, hasher, tables, audit_path

    def _log(self, query_id, who, action, target, reason, result="started", n=None) -> None:
        gov.log_row(self.spark, query_id, who, action, target, reason, result, n).coalesce(1).write.mode(
            "append"
        ).parquet(self.audit_path)

    def _run(self, who: gov.Principal, action: str, reason, target: str, plan: Callable[[], DataFrame]) -> DataFrame:
        stated = gov.authorise(who, action, reason)
        query_id = uuid.uuid4().hex
        self._log(query_id, who, action, target, stated)
        try:
            rows = plan()
        except InvalidSearch as exc:
            self._log(query_id, who, action, target, stated, exc.code, 0)
            raise
        # Written once, for the count and the caller: whole however long, in the order of the plan, and in no cache.
        taken = materialise(rows)
        self._log(query_id, who, action, target, stated, "ok", taken.count())
        return taken

    def compact_log(self) -> int:
        """Merge the log's files below ``SMALL_FILE`` bytes; returns how many were merged.

        Files that have grown to that size stay as they are, so a call does not rewrite the history.
        Entries written meanwhile stay.
        """
        from ..sources import rewrite

        log = self.spark.read.schema(gov.LOG_SCHEMA).parquet(self.audit_path)
        found = log.select("_metadata.file_path", "_metadata.file_size").distinct().filter(F.col("file_size") < SMALL_FILE)
        small = [r[0] for r in found.collect()]  # file names only
        if len(small) > 1:
            rewrite.replace(self.spark, self.audit_path, small, self.spark.read.schema(gov.LOG_SCHEMA).parquet(*small).hint("rebalance"))
        return len(small)

    def _key(self, plate: str) -> str:
        one = with_canonical(self.spark.createDataFrame([(plate,)], "p string"), "p")
        key = one.select(self.hasher.hash(F.col("canonical"))).first()[0]
        if key is None:
            raise InvalidSearch("invalid_plate", f"{plate!r} is not a valid Nepali plate")
        return key

    def find_plate(self, who, plate: str, reason: str, **window) -> DataFrame:
        return self._run(who, "read.search", reason, f"plate={plate}",
                         lambda: sightings(self.tables["reads"], self._key(plate), **window))

    def find_partial(self, who, fragment: str, reason: str, **window) -> DataFrame:
        return self._run(who, "read.search", reason, f"partial={fragment}",
                         lambda: partial(self.tables["reads"], fragment, **window))

    def camera_feed(self, who, as_of, **options) -> DataFrame:
        return self._run(who, "read.live", None, f"camera={options.get('camera_id') or 'all'}",
                         lambda: live_feed(self.tables["reads"], as_of, **options))

    def zone_sessions(self, who, reason: str, plate: str | None = None, **options) -> DataFrame:
        def plan() -> DataFrame:
            key = self._key(plate) if plate else None
            return find_sessions(self.tables["sessions"], plate_hmac=key, **options)

        return self._run(who, "session.search", reason,
                         f"zone={options.get('zone_id') or 'all'} plate={plate or 'any'}", plan)

    def convoy(self, who, plate: str, reason: str, **options) -> DataFrame:
        return self._run(who, "read.search", reason, f"convoy={plate}",
                         lambda: convoy(self.tables["reads"], self._key(plate), **options))

    def occupancy(self, who) -> DataFrame:
        return self._run(who, "read.live", None, "occupancy", lambda: occupancy(self.tables["sessions"]))

    def statistics(self, who, as_of, hours: int = 24) -> DataFrame:
        t = self.tables
        return self._run(who, "read.live", None, f"stats/{hours}h", lambda: statistics(
            t["reads"], t["sessions"], t["reviews"], t["anomalies"], as_of, hours))

    def watchlist(self, who) -> DataFrame:
        from ..operators.screening import active_entries

        return self._run(who, "watchlist.read", None, "watchlist", lambda: active_entries(self.tables["watchlist"]))

    def hold_for_case(self, who, plate: str, reason: str, as_of, days: int = 365) -> DataFrame:
        """Legal hold on a plate: the hold row to store; logged with the reads it covers."""
        from ..operators.retention import hold_for_case

        stated = gov.authorise(who, "admin.retention", reason)
        key = self._key(plate)
        covered = self.tables["reads"].filter(F.col("plate_hmac") == key).count()
        self._log(uuid.uuid4().hex, who, "admin.retention", f"extend:{plate.strip()}", stated, "ok", covered)
        return hold_for_case(self.spark.createDataFrame([(key,)], "plate_hmac string"), as_of, days)

    def request_erasure(self, who, plate: str, reason: str, as_of, authority_ref: str = "") -> DataFrame:
        """Erasure request row to store: the pseudonym only, never the plate."""
        stated = gov.authorise(who, "erasure.request", reason)
        key = self._key(plate)
        self._log(uuid.uuid4().hex, who, "erasure.request", "erasure", stated, "ok")
        row = self.spark.createDataFrame([(key, who.username, authority_ref)], "plate_hmac string, requested_by string, authority_ref string")
        return row.select("*", at(as_of).alias("requested_at"), F.lit("pending").alias("status"))

    def add_to_watchlist(self, who, requests: DataFrame, reason: str, as_of, backfill_days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(accepted, rejected, historical hits)`` for new entries; ``requests`` has ``id, plate, reason, category``."""
        from ..operators import screening

        stated = gov.authorise(who, "watchlist.write", reason)
        accepted, rejected = screening.add_entries(requests, self.hasher)
        past = screening.backfill(self.tables["reads"], accepted, as_of, backfill_days)
        self._log(uuid.uuid4().hex, who, "watchlist.write", "watchlist", stated, "ok", accepted.count())
        return accepted, rejected, past

    def hit_list(self, who, **options) -> DataFrame:
        from ..operators.screening import hit_list

        t = self.tables
        return self._run(who, "watchlist.read", None, "hits", lambda: hit_list(t["hits"], t["reads"], t["watchlist"], **options))

    def acknowledge(self, who, hit_id: int, as_of) -> DataFrame:
        """Acknowledgement row to store."""
        stated = gov.authorise(who, "hit.acknowledge", None)
        known = self.tables["hits"].filter(F.col("id") == hit_id).limit(1).count()
        self._log(uuid.uuid4().hex, who, "hit.acknowledge", f"hit={hit_id}", stated, "ok" if known else "not_found", known)
        row = self.spark.createDataFrame([(hit_id, who.username)] * known, "hit_id bigint, actor string")
        return row.withColumn("at", at(as_of))

    def anomalies(self, who, **options) -> DataFrame:
        from ..operators.anomalies import open_anomalies

        return self._run(who, "read.live", None, "anomalies", lambda: open_anomalies(self.tables["anomalies"], **options))

    def reviews(self, who, **options) -> DataFrame:
        t = self.tables
        return self._run(who, "review.read", None, "reviews", lambda: review_queue(t["reviews"], t["reads"], **options))

    def submit_reviews(self, who, submissions: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
        """``(items, rejected submissions)``; submissions have ``read_id, confirmed, corrected_text``."""
        stated = gov.authorise(who, "review.write", None)
        signed = submissions.withColumn("reviewer", F.lit(who.username)).withColumn("at", at(as_of))
        items, rejected = apply_reviews(self.tables["reviews"], signed)
        self._log(uuid.uuid4().hex, who, "review.write", "reviews", stated, "ok", submissions.count())
        return items, rejected

    def image(self, who, sha256: str, reason: str) -> DataFrame:
        """The stored image of a digest, if any."""
        return self._run(who, "read.image", reason, f"image={sha256[:12]}",
                         lambda: self.tables["blobs"].filter(F.col("sha256") == sha256).limit(1))

    def enrol(self, who, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(nodes, conflicts)`` after an enrolment."""
        from ..operators.ingest import enrol

        stated = gov.authorise(who, "node.enrol", None)
        nodes, conflicts = enrol(records, self.tables["nodes"])
        self._log(uuid.uuid4().hex, who, "node.enrol", "nodes", stated, "ok", records.count())
        return nodes, conflicts

    def sweep(self, who, root: str, as_of) -> dict[str, int]:
        """Delete what has expired from the tables stored below ``root``."""
        from ..operators import upkeep

        stated = gov.authorise(who, "admin.retention", None)
        query_id = uuid.uuid4().hex
        self._log(query_id, who, "admin.retention", "sweep", stated)
        rewritten = upkeep.apply_sweep(self.spark, root, as_of)
        self._log(query_id, who, "admin.retention", "sweep", stated, "ok", sum(rewritten.values()))
        return rewritten

    def execute_erasure(self, who, root: str, requests: DataFrame, as_of) -> DataFrame:
        """Carry out the pending requests on the tables stored below ``root``; returns them as done."""
        from ..operators import upkeep

        stated = gov.authorise(who, "admin.retention", None)
        query_id = uuid.uuid4().hex
        self._log(query_id, who, "admin.retention", "erasure", stated)
        done = upkeep.apply_erasure(self.spark, root, requests, as_of)
        self._log(query_id, who, "admin.retention", "erasure", stated, "ok", done.count())
        return done

    def audit_trail(self, who, **options) -> DataFrame:
        gov.authorise(who, "audit.read", None)
        log = self.spark.read.schema(gov.LOG_SCHEMA).parquet(self.audit_path)
        return gov.audit_trail(gov.folded_log(log), **options)
