"""Plate canonicalisation, pseudonyms, display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import refdata as R
from ...functions import plates as P
from ...functions import text as X
from .. import adapters as A
from ..adapters import AS_OF
from .registry import hmac_sql, query

U = "user_id"
OWN, SIZE, SYSTEM = A.owner(U), A.size(U), A.system(U)
CLASS = A.pick(A._CLASSES, f"{U} % 13")
OWN_COLOUR = A.pick(",".join(next(c for c, o in R.COLOUR_OWNERSHIP.items() if o == cl[2]) for cl in R.CLASSES), f"{U} % 13")
MISMATCH = (
    f"(observed_colour <> 'unknown' AND observed_colour <> 'white_black' AND"
    f" (({U} % 3 = 0) OR observed_colour <> {OWN_COLOUR}))"
)


@query("plt1_canonical", "plate_texts", sql="SELECT id, text, expected AS canonical FROM plate_texts")
def _(t):
    return P.with_canonical(t.plate_texts.select("id", "text"), "text")


@query("pse1_pseudonym", "reads", sql=f"SELECT id, {hmac_sql('plate_canonical')} AS plate_hmac FROM reads")
def _(t):
    return t.keyed("reads").select("id", "plate_hmac")


@query("plt2_separators", "plate_texts",
       sql=r"SELECT id, regexp_replace(text, '[\s\-_.·•/|,]+', '', 'g') AS compact FROM plate_texts")
def _(t):
    return t.plate_texts.select("id", P.strip_separators(F.col("text")).alias("compact"))


@query("plt3_4_layouts", "plate_texts", sql=f"""
SELECT CASE WHEN expected IS NULL THEN 'unknown' ELSE {SYSTEM} END AS system, expected IS NOT NULL AS is_valid, count(*) AS n
FROM plate_texts GROUP BY ALL""")
def _(t):
    return P.with_parsed(t.plate_texts, "text").groupBy("plate.system", "plate.is_valid").agg(F.count("*").alias("n"))


_LEG = [("zone", A.pick(A._ZONES_DEVA, f"{U} % 14")), ("lot", A.deva(f"cast({U} % 10 as string)")),
        ("class", A.pick(",".join(c[0] for c in R.CLASSES), f"{U} % 13")), ("serial", A.deva(A.serial(U)))]
_EMB = [("province", f"cast({U} % 7 + 1 as string)"), ("class_letter", f"substr({A.pick(A._EMBOSSED, f'{U} % 11')}, 1, 1)"),
        ("subclass", f"CASE WHEN {U} % 11 = 9 THEN '1' END"), ("series", "'PA'"), ("serial", A.serial(U))]
_SEGMENTS = " UNION ALL ".join(
    f"SELECT id, '{n}' AS field, {v} AS value FROM plate_texts WHERE expected IS NOT NULL AND ({U} % 3 {op} 0)"
    for op, group in (("<>", _LEG), ("=", _EMB)) for n, v in group
)


@query("plt5_segments", "plate_texts", sql=f"SELECT * FROM ({_SEGMENTS}) s WHERE value IS NOT NULL")
def _(t):
    rows = P.with_parsed(t.plate_texts.select("id", "text"), "text")
    return rows.select("id", F.explode("plate.fields").alias("f")).select("id", F.col("f.name").alias("field"), F.col("f.value").alias("value"))


@query("plt6_legacy_assembly", "plate_texts", sql=f"""
SELECT id, {A.pick(A._ZONES, f'{U} % 14')} AS zone, cast({U} % 10 as string) AS lot, {CLASS} AS vehicle_class,
 {A.serial(U)} AS serial, {OWN} AS ownership, {SIZE} AS size_class,
 {_LEG[0][1]} || ' ' || {_LEG[1][1]} || ' ' || {_LEG[2][1]} || ' ' || {_LEG[3][1]} AS display,
 {OWN_COLOUR} || ',white_black' AS expected_colours,
 CASE WHEN {MISMATCH} THEN 'plate colour ''' || observed_colour || ''' disagrees with ownership ''' || {OWN} || ''' implied by class ''' || {CLASS} || '''' ELSE '' END AS warnings
FROM plate_texts WHERE expected IS NOT NULL AND {U} % 3 <> 0""")
def _(t):
    p = P.with_parsed(t.plate_texts, "text", observed_colour="observed_colour").filter("plate.system = 'devanagari'")
    return p.select(
        "id", "plate.zone", "plate.lot", "plate.vehicle_class", "plate.serial", "plate.ownership", "plate.size_class",
        "plate.display", F.array_join("plate.expected_colour", ",").alias("expected_colours"),
        F.array_join("plate.warnings", ";").alias("warnings"),
    )


@query("plt7_embossed_assembly", "plate_texts", sql=f"""
SELECT id, cast({U} % 7 + 1 as int) AS province, {A.pick(A._EMBOSSED, f'{U} % 11')} AS class_letter, 'PA' AS series,
 {A.serial(U)} AS serial, {OWN} AS ownership, {SIZE} AS size_class,
 CASE WHEN {MISMATCH} THEN 'embossed plates are black-on-white; observed ''' || observed_colour || '''' ELSE '' END AS warnings
FROM plate_texts WHERE expected IS NOT NULL AND {U} % 3 = 0""")
def _(t):
    p = P.with_parsed(t.plate_texts, "text", observed_colour="observed_colour").filter("plate.system = 'embossed'")
    return p.select("id", "plate.province", "plate.class_letter", "plate.series", "plate.serial", "plate.ownership",
                    "plate.size_class", F.array_join("plate.warnings", ";").alias("warnings"))


@query("plt8_errors", "plate_texts", sql="""
SELECT id, CASE WHEN trim(text) = '' THEN 'empty input' ELSE 'string does not match any Nepali plate layout' END AS error
FROM (SELECT id, CASE WHEN id % 13 = 0 THEN '  ' ELSE text END AS text, CASE WHEN id % 13 = 0 THEN NULL ELSE expected END AS expected FROM plate_texts) t
WHERE expected IS NULL""")
def _(t):
    rows = t.plate_texts.select("id", F.when(F.col("id") % 13 == 0, "  ").otherwise(F.col("text")).alias("text"))
    return P.with_parsed(rows, "text").filter("not plate.is_valid").select("id", F.array_join("plate.errors", ";").alias("error"))


@query("plt9_confidence", "plate_texts", sql=f"""
SELECT id, CASE WHEN expected IS NULL THEN 'reject' WHEN score >= 0.9 AND NOT {MISMATCH} THEN 'high' WHEN score >= 0.75 THEN 'medium'
 WHEN score >= 0.5 THEN 'low' ELSE 'reject' END AS confidence
FROM (SELECT *, cast(id % 101 as double) / 100 AS score FROM plate_texts) t""")
def _(t):
    rows = t.plate_texts.withColumn("score", (F.col("id") % 101).cast("double") / 100)
    return P.with_parsed(rows, "text", score=F.col("score"), observed_colour="observed_colour").select("id", "plate.confidence")


@query("plt10_lookups", "reads", sql=f"""
SELECT observed_colour, vehicle_class, CASE WHEN observed_colour = 'white_black' THEN 'embossed' WHEN observed_colour = 'unknown' THEN 'unknown' ELSE 'devanagari' END AS system,
 ownership, size_class, count(*) AS n
FROM (SELECT observed_colour, {CLASS.replace(U, 'event_id')} AS vehicle_class, {A.pick(A._OWNERS, 'event_id % 13')} AS ownership, {A.pick(A._SIZES, 'event_id % 13')} AS size_class
 FROM (SELECT id AS event_id, observed_colour FROM reads) e) t GROUP BY ALL""")
def _(t):
    letters = F.array(*[F.lit(c[1]) for c in R.CLASSES])
    rows = t.reads.select("observed_colour", F.element_at(letters, (F.col("id") % 13 + 1).cast("int")).alias("vehicle_class"))
    c = F.col("vehicle_class")
    return rows.groupBy(
        "observed_colour", "vehicle_class", P.system_for_colour(F.col("observed_colour")).alias("system"),
        P.ownership_for_class(c).alias("ownership"), P.size_for_class(c).alias("size_class"),
    ).agg(F.count("*").alias("n"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in R.confusable_pairs())
_MISREAD = "substr(plate_canonical, 1, length(plate_canonical) - 1) || translate(substr(plate_canonical, length(plate_canonical), 1), '01258', 'OLZSB')"


@query("plt11_near_misses", "reads", sql=f""", plates AS (SELECT plate_canonical AS plate FROM reads UNION SELECT {_MISREAD} FROM reads),
pairs(a, b) AS (VALUES {_PAIRS}),
spots AS (SELECT x.plate AS plate_a, y.plate AS plate_b, i, substr(x.plate, i, 1) AS a, substr(y.plate, i, 1) AS b
 FROM plates x JOIN plates y ON x.plate < y.plate AND length(x.plate) = length(y.plate), range(6, 25) r(i)
 WHERE substr(x.plate, i, 1) <> substr(y.plate, i, 1)),
one AS (SELECT plate_a, plate_b, min(a) AS glyph_a, min(b) AS glyph_b FROM spots GROUP BY plate_a, plate_b HAVING count(*) = 1)
SELECT one.* FROM one JOIN pairs ON glyph_a = a AND glyph_b = b WHERE substr(plate_a, 1, 5) = substr(plate_b, 1, 5)""")
def _(t):
    plates = t.reads.select("plate_canonical")
    misread = plates.select(F.expr(_MISREAD).alias("plate_canonical"))
    return P.near_miss_pairs(plates.unionByName(misread))


@query("plt12_number_labels", sql=f"""
SELECT event_id AS id, format('{{:,}}', event_id * 1234) AS label_en, translate(format('{{:,}}', event_id * 1234), '0123456789', '{R.DEVA_DIGITS}') AS label_ne FROM events""")
def _(t):
    n = F.col("event_id") * 1234
    return t.events.select(F.col("event_id").alias("id"), X.number_label(n).alias("label_en"), X.number_label(n, "ne").alias("label_ne"))


@query("plt13_relative_age", sql=f"""
SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN cast(floor(s / 60 + 0.5) as bigint) || 'm'
 WHEN s < 86400 THEN cast(floor(s / 3600 + 0.5) as bigint) || 'h' ELSE cast(floor(s / 86400 + 0.5) as bigint) || 'd' END AS age
FROM (SELECT event_id AS id, cast(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1000000 + 0.5) as bigint) AS s FROM events) t""")
def _(t):
    return t.events.select(F.col("event_id").alias("id"), X.relative_age(F.col("ts"), F.to_timestamp(F.lit(AS_OF))).alias("age"))
