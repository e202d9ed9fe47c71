"""Observations of a plate that do not hang together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.geometry import haversine_km
from ..functions.plates import lookup
from .ordered import with_running


def _anomaly(rows: DataFrame, kind: str, severity: str, detail: dict[str, Column], read_ids: Column) -> DataFrame:
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        F.lit(kind).alias("kind"), "plate_hmac", "plate_canonical", F.lit(severity).alias("severity"),
        F.col("captured_at").alias("detected_at"), F.create_map(*pairs).alias("detail"), read_ids.alias("read_ids"),
    )


def colour_mismatches(reads: DataFrame) -> DataFrame:
    """Plate colour implies another owner than the class letter; legacy plates only."""
    implied = lookup(R.COLOUR_OWNERSHIP, F.col("observed_colour"))
    rows = reads.withColumn("_implied", implied).filter(
        (F.col("plate_system") == "devanagari") & F.col("_implied").isNotNull()
        & (F.col("ownership") != "unknown") & (F.col("_implied") != F.col("ownership"))
    )
    return _anomaly(rows, "colour_class_mismatch", "warning", {
        "observed_colour": F.col("observed_colour"), "colour_implies": F.col("_implied"),
        "class_letter_implies": F.col("ownership"),
    }, F.array("id"))


def vehicle_mismatches(reads: DataFrame) -> DataFrame:
    """Observed vehicle type cannot carry a plate of this size band."""
    allowed = lookup(R.SIZE_VEHICLES, F.col("size_class"))
    seen = F.col("observed_vehicle_type")
    rows = reads.withColumn("_allowed", allowed).filter(
        F.col("_allowed").isNotNull() & (F.coalesce(seen, F.lit("")) != "")
        & ~F.array_contains("_allowed", F.lower(seen))
    )
    return _anomaly(rows, "plate_vehicle_mismatch", "warning", {
        "plate_size_class": F.col("size_class"), "observed_vehicle_type": seen,
    }, F.array("id"))


def impossible_pairs(
    reads: DataFrame, nodes: DataFrame, max_speed_kmh: float = 160.0, min_interval_seconds: float = 60.0,
    lookback_hours: int = 24, confidence: str = "high",
) -> DataFrame:
    """For each trusted read, the latest earlier sighting elsewhere it could not have driven from.

    Reads of a plate are never paired with each other. Per other node only the last sighting at
    least ``min_interval_seconds`` before the read can be the fastest, so each read sends one
    probe per node its plate was at around that time, and a running maximum over
    ``(plate, node)`` time blocks answers it. Work grows with reads, not with their square.
    """
    places = nodes.filter("latitude is not null and longitude is not null").select(
        "node_id", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")
    )
    trusted = reads.filter((F.col("confidence") == confidence) & F.col("verified") & ~F.col("provisional"))
    here = trusted.join(places, "node_id").select(
        "id", "plate_hmac", "plate_canonical", "node_id", "captured_at",
        F.unix_micros("captured_at").alias("t"), "lat", "lon",
    )
    # Places a plate is seen at around each quarter of a day: few, and far fewer than its places
    # over all time. The window reaches both ways, so a sighting is kept for reads still to come.
    quarter = 6 * 3600 * 1_000_000
    reach = -(-lookback_hours // 6) + 1
    here = here.withColumn("slot", F.floor(F.col("t") / F.lit(quarter)).cast("bigint"))
    stops = here.groupBy("plate_hmac", "node_id", "slot").agg(F.min("lat").alias("la"), F.min("lon").alias("lo")).select(
        "plate_hmac", F.struct(F.col("node_id").alias("n"), "la", "lo").alias("stop"),
        F.explode(F.sequence(F.col("slot") - reach, F.col("slot") + reach)).alias("slot"),
    )
    routes = stops.groupBy("plate_hmac", "slot").agg(F.collect_set("stop").alias("stops")).filter(F.size("stops") > 1)
    second = 1_000_000
    # Each read stands on the line of its own place as a sighting and on the lines of the other
    # places as a probe. A sighting at the probe's own instant counts, so it sorts first.
    speed = F.lit(max_speed_kmh)
    probe = F.struct("id", "plate_canonical", "node_id", "captured_at", "t")
    sighting = F.array(F.struct(
        F.col("node_id").alias("place"), (F.col("t") * 2).alias("pos"), F.lit(None).cast("double").alias("km"),
        F.struct("t", (-F.col("id")).alias("neg_id")).alias("seen"),
    ))

    def ask(stop: Column) -> Column:
        return F.struct(
            stop["n"].alias("place"), ((F.col("t") - F.lit(int(min_interval_seconds * second))) * 2 + 1).alias("pos"),
            haversine_km(F.col("lat"), F.col("lon"), stop["la"], stop["lo"]).alias("km"),
            F.lit(None).cast("struct<t:bigint,neg_id:bigint>").alias("seen"),
        )

    # Nodes closer than this are reachable within the smallest interval that counts.
    far = F.filter(
        F.transform(F.filter("stops", lambda s: s["n"] != F.col("node_id")), ask),
        lambda a: a["km"] > speed * F.lit(min_interval_seconds / 3600.0),
    )
    line = here.join(routes, ["plate_hmac", "slot"]).select("plate_hmac", probe.alias("probe"), F.inline(F.concat(sighting, far)))
    ten_minutes = F.floor(F.col("pos") / F.lit(2 * 600 * second)).cast("bigint")
    answered = with_running(line, ["plate_hmac", "place"], "pos", F.col("seen"), "last", block=ten_minutes)
    dt = (F.col("probe.t") - F.col("last.t")) / F.lit(float(second))
    found = answered.filter("km is not null and last is not null").withColumn("dt", dt).filter(
        F.col("dt") <= lookback_hours * 3600
    ).withColumn("speed", F.col("km") / (F.col("dt") / 3600.0)).filter(F.col("speed") > max_speed_kmh)
    # One anomaly per read: the shortest interval, then the smaller other id.
    best = found.groupBy(F.col("probe.id").alias("id")).agg(
        F.max(F.struct("last", "plate_hmac", "place", "probe", "km", "dt", "speed")).alias("b")
    )
    b = F.col("b")
    return best.select(
        (-b["last"]["neg_id"]).alias("other_id"), F.col("id").alias("read_id"), b["plate_hmac"].alias("plate_hmac"),
        b["probe"]["plate_canonical"].alias("plate_canonical"), b["place"].alias("from_node"),
        b["probe"]["node_id"].alias("to_node"), b["probe"]["captured_at"].alias("captured_at"),
        F.round(b["km"], 2).alias("distance_km"), F.round(b["dt"], 1).alias("interval_seconds"),
        F.round(b["speed"], 1).alias("implied_speed_kmh"),
    )


def impossible_movements(reads: DataFrame, nodes: DataFrame, max_speed_kmh: float = 160.0, **limits) -> DataFrame:
    pairs = impossible_pairs(reads, nodes, max_speed_kmh, **limits)
    return _anomaly(pairs, "impossible_movement", "alert", {
        "from_node": F.col("from_node"), "to_node": F.col("to_node"), "distance_km": F.col("distance_km"),
        "interval_seconds": F.col("interval_seconds"), "implied_speed_kmh": F.col("implied_speed_kmh"),
        "threshold_kmh": F.lit(max_speed_kmh),
    }, F.array("other_id", "read_id"))


def registry_mismatches(reads: DataFrame, registry: DataFrame) -> DataFrame:
    """Embossed plate province differs from the registered one."""
    known = registry.filter(F.coalesce("registered_province", F.lit(0)) != 0).select("plate_hmac", "registered_province")
    province = F.regexp_extract("plate_canonical", "^NP-E:([1-7])-", 1).cast("int")
    rows = (
        reads.filter(F.col("plate_system") == "embossed").withColumn("_province", province)
        .join(known, "plate_hmac").filter(F.col("_province") != F.col("registered_province"))
    )
    return _anomaly(rows, "registry_mismatch", "warning", {
        "plate": F.col("_province"), "registry": F.col("registered_province"),
    }, F.array("id"))


def all_anomalies(reads: DataFrame, nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Every check over verified final reads, as one table. Pure function of deduplicated
    reads, so a resend repeats nothing."""
    trusted = reads.filter(F.col("verified") & ~F.col("provisional"))
    return (
        colour_mismatches(trusted)
        .unionByName(vehicle_mismatches(trusted))
        .unionByName(impossible_movements(trusted, nodes))
        .unionByName(registry_mismatches(trusted, registry))
    )


def open_anomalies(anomalies: DataFrame, limit: int = 500) -> DataFrame:
    """Newest unreviewed anomalies."""
    first_read = F.element_at("read_ids", -1)
    return anomalies.filter("reviewed_at is null").orderBy(
        F.col("detected_at").desc(), "kind", first_read.desc()
    ).limit(min(limit, R.MAX_LIMIT))
