import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from wayledger import refdata as R
from wayledger.functions import ctc, text
from wayledger.functions.plates import near_miss_pairs, with_canonical, with_parsed
from wayledger.functions.pseudonym import PlateHasher

from .conftest import KEY

LEGACY = "NP-L:BA-1-CHA-1234"
CASES = {
    "बा १ च १२३४": LEGACY, "BA 1 CHA 1234": LEGACY, "ba-1-cha-1234": LEGACY, "NP-L:BA-1-CHA-1234": LEGACY,
    "बा१च१२३४": LEGACY, "BA १ CHA १२३४": LEGACY, "को प २४७": "NP-L:KO-0-PA-247", "KO PA 247": "NP-L:KO-0-PA-247",
    "बा १ सी.डी. १२३४": "NP-L:BA-1-CD-1234", "3 B PA 1234": "NP-E:3-B-PA-1234", "NEP 3B PA 1234": "NP-E:3-B-PA-1234",
    "np-e:3-b-pa-1234": "NP-E:3-B-PA-1234", "5 J2 KL 0087": "NP-E:5-J2-KL-0087", "1C1AB12": "NP-E:1-C1-AB-12",
    "": None, "   ": None, "HELLO": None, "बा १ ध १२३४": None, "8 B PA 1234": None, "3 B PA 12345": None,
    "3 A1 PA 1234": None, "3 B P 1234": None, "बा 1 च 1234": None, ",,,": None,
}


def test_canonical_keys(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string")
    got = {r.t: r.canonical for r in with_canonical(df, "t").collect()}
    assert got == CASES


def test_null_text_is_rejected(spark):
    row = with_parsed(spark.createDataFrame([(None,)], "t string"), "t").first().plate
    assert not row.is_valid and row.errors == ["empty input"] and row.confidence == "reject"


def test_parsed_fields(spark):
    df = spark.createDataFrame([("BA 1 CHA 234", "black_white"), ("5 J2 KL 0087", "red_white"), ("nope", None)], "t string, c string")
    a, b, c = [r.plate for r in with_parsed(df, "t", observed_colour="c").collect()]
    assert (a.zone, a.lot, a.vehicle_class, a.serial, a.ownership, a.size_class) == ("BA", "1", "CHA", "234", "private", "light")
    assert a.display == "बा १ च २३४" and a.expected_colour == ["red_white", "white_black"]
    assert a.warnings == [
        "plate colour 'black_white' disagrees with ownership 'private' implied by class 'CHA'",
        "serial has 3 digits; four is standard",
    ]
    assert a.confidence == "medium"
    assert [f.name for f in b.fields] == ["province", "class_letter", "subclass", "series", "serial"]
    assert (b.province, b.class_letter, b.size_class, b.ownership) == (5, "J2", "heavy", "unknown")
    assert b.warnings == ["embossed plates are black-on-white; observed 'red_white'"]
    assert c.errors == ["string does not match any Nepali plate layout"] and c.canonical == ""


def test_every_zone_and_class_round_trips(spark):
    rows = [(f"{z[0]} {c[0]} १२३४", f"NP-L:{z[1]}-0-{c[1]}-1234") for z in R.ZONES for c in R.CLASSES]
    rows += [(f"{z[1]} {c[1]} 1234", f"NP-L:{z[1]}-0-{c[1]}-1234") for z in R.ZONES for c in R.CLASSES]
    rows += [(f"{p}{c}AB1234", f"NP-E:{p}-{c}-AB-1234") for p in range(1, 8) for c in R.EMBOSSED_SIZE]
    df = with_canonical(spark.createDataFrame(rows, "t string, want string"), "t")
    assert df.filter("canonical is distinct from want").collect() == []


def test_hmac_equals_library(spark, hasher):
    plates = [LEGACY, "NP-E:3-B-PA-1234", "बा"]
    df = spark.createDataFrame([(p,) for p in plates], "p string").select("p", hasher.hash(F.col("p")).alias("h"))
    for r in df.collect():
        assert r.h == hmac.new(KEY.encode(), r.p.encode(), hashlib.sha256).hexdigest()


def test_short_keys_are_refused():
    with pytest.raises(ValueError):
        PlateHasher("short")


def test_key_pads_do_not_show_in_plans(spark, hasher):
    df = spark.range(1).select(hasher.hash(F.col("id").cast("string")).alias("h"))
    for part in (df._jdf.queryExecution().toString(),):
        assert hasher._inner.hex().lower() not in part.lower().replace(" ", "")


def test_near_misses(spark):
    df = spark.createDataFrame([("NP-E:3-B-PA-1234",), ("NP-E:3-B-PA-1Z34",), ("NP-E:3-B-PA-1534",), ("NP-E:3-8-PA-1234",)], "plate_canonical string")
    got = {(r.plate_a, r.plate_b) for r in near_miss_pairs(df).collect()}
    assert got == {("NP-E:3-B-PA-1234", "NP-E:3-B-PA-1Z34"), ("NP-E:3-8-PA-1234", "NP-E:3-B-PA-1234")}


def test_vocabulary_and_confusions():
    assert len(R.vocabulary()) == 71
    pairs = set(R.confusable_pairs())
    assert ("ग", "ध") in pairs and ("ध", "ग") in pairs and ("A", "B") not in pairs


def test_labels(spark):
    df = spark.createDataFrame([(59,), (90,), (5400,), (86400 * 2,)], "s bigint")
    then = F.timestamp_seconds(F.lit(10_000_000) - F.col("s"))
    now = F.timestamp_seconds(F.lit(10_000_000))
    got = [(r.e, r.n) for r in df.select(text.relative_age(then, now).alias("e"), text.relative_age(then, now, "ne").alias("n")).collect()]
    assert got == [("59s", "५९ से"), ("2m", "२ मि"), ("2h", "२ घ"), ("2d", "२ दिन")]
    assert spark.range(1).select(text.number_label(F.lit(1234567), "ne")).first()[0] == "१,२३४,५६७"


def test_collapse_and_edit_distance(spark):
    rng = random.Random(3)
    vocab = R.vocabulary()

    def distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    rows = [([0, 5, 5, 0, 5, 3, 3, 0], ["बा", "१"], ["ब", "१"])]
    rows += [([rng.randrange(4) for _ in range(9)], rng.choices(vocab[1:], k=rng.randrange(8)), rng.choices(vocab[1:], k=5)) for _ in range(30)]
    df = spark.createDataFrame(rows, "i array<int>, a array<string>, b array<string>")
    for r in df.select("*", ctc.collapse(F.col("i")).alias("c"), ctc.token_edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        want = [x for k, x in enumerate(r.i) if x and (k == 0 or r.i[k - 1] != x)]
        assert r.c == want and r.d == distance(r.a, r.b)
