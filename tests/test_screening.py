import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wayledger.functions.geometry import haversine_km
from wayledger.operators import anomalies as N
from wayledger.operators import screening as S
from wayledger.functions.plates import with_canonical

NOW = datetime(2024, 2, 1)
READ = ("id bigint, node_id string, camera_id string, captured_at timestamp, plate_hmac string, plate_canonical string, confidence string,"
        " verified boolean, provisional boolean, plate_system string, ownership string, size_class string, observed_colour string,"
        " observed_vehicle_type string")
NODES = [("KTM", 27.7172, 85.3240), ("PKR", 28.2096, 83.9856), ("NEAR", 27.7180, 85.3250), ("NOWHERE", None, None)]


def read(i, node="KTM", at=NOW, plate="P", confidence="high", verified=True, provisional=False, **x):
    return (i, node, node, at, plate, plate, confidence, verified, provisional, x.get("system", "devanagari"), x.get("ownership", "private"),
            x.get("size", "light"), x.get("colour"), x.get("vehicle"))


def reads(spark, rows):
    return spark.createDataFrame(rows, READ)


def nodes(spark):
    return spark.createDataFrame(NODES, "node_id string, latitude double, longitude double")


def entries(spark, hasher, rows):
    df = spark.createDataFrame(rows, "id bigint, plate string, reason string, expires_at timestamp, category string")
    return S.add_entries(df, hasher)


def test_entry_in_one_script_hits_a_read_in_the_other(spark, hasher):
    ok, bad = entries(spark, hasher, [(1, "BA 1 CHA 1234", "stolen", None, "theft"), (2, "BA 1 CHA 1234", " ", None, "x"), (3, "HELLO", "r", None, "x")])
    assert {r.id: r.error for r in bad.collect()} == {2: "a watch-list entry requires a reason", 3: "not a valid Nepali plate"}
    texts = spark.createDataFrame([(1, "बा १ च १२३४", "high"), (2, "बा १ च १२३४", "medium")], "id bigint, t string, confidence string")
    seen = with_canonical(texts, "t", "plate_canonical").withColumn("plate_hmac", hasher.hash(F.col("plate_canonical"))).select(
        "*", F.lit("C").alias("camera_id"), F.lit(NOW).alias("captured_at"), F.lit(False).alias("provisional"), F.lit(True).alias("verified"))
    assert {r.read_id: r.actionable for r in S.screen(seen, ok, NOW).collect()} == {1: True, 2: False}


def test_expired_inactive_and_unverified_are_silent(spark):
    w = spark.createDataFrame([(1, "P", "c", True, datetime(2024, 1, 31)), (2, "P", "c", False, None), (3, "P", "c", True, datetime(2024, 3, 1))],
                              "id bigint, plate_hmac string, category string, active boolean, expires_at timestamp")
    hits = S.screen(reads(spark, [read(1), read(2, verified=False), read(3, plate="Q")]), w, NOW).collect()
    assert [(h.read_id, h.watchlist_id) for h in hits] == [(1, 3)]


def test_backfill_is_never_actionable(spark):
    rows = [read(i, at=NOW - timedelta(days=d)) for i, d in enumerate((1, 5, 29, 31))] + [read(9, provisional=True)]
    w = spark.createDataFrame([(1, "P", "c")], "id bigint, plate_hmac string, category string")
    hits = S.backfill(reads(spark, rows), w, NOW).collect()
    assert len(hits) == 3 and not any(h.actionable for h in hits)


def test_distance_between_cities(spark):
    km = spark.range(1).select(haversine_km(*[F.lit(x) for x in (27.7172, 85.3240, 28.2096, 83.9856)])).first()[0]
    assert 130 < km < 160


def test_impossible_movement(spark):
    rows = [read(1), read(2, "PKR", NOW + timedelta(minutes=10))]
    a = N.impossible_movements(reads(spark, rows), nodes(spark)).collect()
    assert len(a) == 1 and a[0].read_ids == [1, 2] and a[0].severity == "alert"
    assert a[0].detail["from_node"] == "KTM" and float(a[0].detail["implied_speed_kmh"]) > 160


def test_plausible_or_untrusted_movement_is_quiet(spark):
    for rows in (
        [read(1), read(2, "PKR", NOW + timedelta(hours=3))],
        [read(1, confidence="medium"), read(2, "PKR", NOW + timedelta(minutes=10))],
        [read(1, verified=False), read(2, "PKR", NOW + timedelta(minutes=10))],
        [read(1, provisional=True), read(2, "PKR", NOW + timedelta(minutes=10))],
        [read(1), read(2, "PKR", NOW + timedelta(seconds=30))],
        [read(1), read(2, "NOWHERE", NOW + timedelta(minutes=10))],
        [read(1), read(2, "NEAR", NOW + timedelta(minutes=2))],
    ):
        assert N.impossible_pairs(reads(spark, rows), nodes(spark)).count() == 0


def test_impossible_movement_equals_brute_force(spark):
    """One plate holds most reads; the operator must agree with comparing all pairs."""
    rng = random.Random(11)
    places = {n: (la, lo) for n, la, lo in NODES if la is not None}
    rows = [read(i, rng.choice(["KTM", "PKR", "NEAR", "NOWHERE"]), NOW + timedelta(seconds=rng.randrange(90_000)), rng.choice("PPPPQ"),
                 rng.choice(["high", "high", "low"])) for i in range(150)]

    def km(a, b):
        (la, lo), (lb, lp) = places[a], places[b]
        h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    want = {}
    good = [r for r in rows if r[6] == "high" and r[1] in places]
    for r in good:
        found = []
        for o in good:
            dt = (r[3] - o[3]).total_seconds()
            if o[4] == r[4] and o[1] != r[1] and 60 <= dt <= 86400 and km(o[1], r[1]) / (dt / 3600) > 160:
                found.append((dt, o[0]))
        if found:
            want[r[0]] = min(found)[1]
    got = {x.read_id: x.other_id for x in N.impossible_pairs(reads(spark, rows), nodes(spark)).collect()}
    assert got == want and len(want) > 20


def test_colour_and_vehicle_mismatches(spark):
    rows = [read(1, colour="black_white"), read(2, colour="red_white"), read(3, colour="black_white", system="embossed"),
            read(4, colour="unknown"), read(5, vehicle="Truck"), read(6, vehicle="Car"), read(7, vehicle="truck", size="any")]
    assert [r.read_ids for r in N.colour_mismatches(reads(spark, rows)).collect()] == [[1]]
    assert [r.read_ids for r in N.vehicle_mismatches(reads(spark, rows)).collect()] == [[5]]


def test_registry_mismatch(spark):
    rows = [read(1, plate="NP-E:3-B-PA-1234", system="embossed"), read(2, plate="NP-E:4-B-PA-1234", system="embossed")]
    registry = spark.createDataFrame([("NP-E:3-B-PA-1234", 5), ("NP-E:4-B-PA-1234", 4)], "plate_hmac string, registered_province int")
    assert [r.read_ids for r in N.registry_mismatches(reads(spark, rows), registry).collect()] == [[1]]
