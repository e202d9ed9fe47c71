"""Plate strings to canonical keys and parsed fields, as Column expressions.

Two layouts are legal: legacy ``zone lot{0,2} class serial{1,4}`` (Devanagari or romanised)
and embossed ``province class series{2} serial{1,4}``. Every test and lookup is a built-in
function, so whole columns parse inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from .literals import constant_map
from .once import once

ASCII_DIGITS = "0123456789"
SEPARATORS = r"(?U)[\s\-_.·•/|,]+"

_CLASS_BY_STRIPPED = {c[0].replace(".", ""): c for c in R.CLASSES}


def _alternation(tokens) -> str:
    return "|".join(sorted(tokens, key=len, reverse=True))


_ZONES_DEVA = _alternation(z[0] for z in R.ZONES)
_ZONES_ROMAN = _alternation(z[1] for z in R.ZONES)
_CLASSES_DEVA = _alternation(_CLASS_BY_STRIPPED)
_CLASSES_ROMAN = _alternation(c[1] for c in R.CLASSES)
_SEP = r"[\s\-_.·•/|,]"

_NATIVE = f"({_ZONES_DEVA})([०-९]{{0,2}})({_CLASSES_DEVA})([०-९]{{1,4}})"
_ROMANISED = (
    f"{_SEP}*({_ZONES_ROMAN})(?:{_SEP}+([0-9]{{1,2}}))?{_SEP}+({_CLASSES_ROMAN}){_SEP}+([0-9]{{1,4}}){_SEP}*"
)
_EMBOSSED = "(?:NEP)?([1-7])(A|B|C1?|D|E|F|G|H[12]?|I[1-3]?|J[1-5]?|K)([A-Z]{2})([0-9]{1,4})"
NATIVE = f"^{_NATIVE}$"
EMBOSSED = f"^{_EMBOSSED}$"

# All layouts in one expression over "compact text, newline, text with ASCII digits"; the order
# of the alternatives is the order the layouts are tried in.
_ANY_LAYOUT = f"(?sU)^(?:{_NATIVE}\\n.*|[^\\n]*\\n{_ROMANISED}|{_EMBOSSED}\\n.*)$"
_PIECES = "," + ",".join(f"${i}" for i in range(1, 13))
_PREFIX = r"(?iU)^\s*(?:NP-L:)?(?:NP-E:)?"


def lookup(mapping: dict, key: Column) -> Column:
    """Constant map lookup; a missing key gives null."""
    return F.try_element_at(constant_map(mapping), key)


def deva_to_ascii(c: Column) -> Column:
    return F.translate(c, R.DEVA_DIGITS, ASCII_DIGITS)


def ascii_to_deva(c: Column) -> Column:
    return F.translate(c, ASCII_DIGITS, R.DEVA_DIGITS)


def strip_separators(c: Column) -> Column:
    return F.regexp_replace(c, SEPARATORS, "")


def plate_pieces(df: DataFrame, text: str) -> DataFrame:
    """Add ``_kind`` (layout that matched, or null) and its raw pieces ``_1`` to ``_4``.

    One match covers all layouts: the pieces come back comma-separated, and a comma is a
    separator, so unmatched text can not start with one.
    """
    raw = F.upper(F.regexp_replace(F.col(text), _PREFIX, ""))
    subject = df.withColumn("_raw", raw)
    subject = subject.withColumn("_subject", F.concat(strip_separators(F.col("_raw")), F.lit("\n"), deva_to_ascii(F.col("_raw"))))
    split = once(subject.drop("_raw"), _m=F.split(F.regexp_replace("_subject", _ANY_LAYOUT, _PIECES), ",")).drop("_subject")
    m = F.col("_m")
    kind = F.when(m[0] == "", F.when(m[1] != "", "native").when(m[5] != "", "romanised").otherwise("embossed"))

    def piece(i: int) -> Column:
        return F.when(m[1] != "", m[i]).when(m[5] != "", m[4 + i]).otherwise(m[8 + i])

    pieces = {f"_{i}": F.when(m[0] == "", piece(i)) for i in range(1, 5)}
    return once(split, _kind=kind, **pieces).drop("_m")


def _zone() -> Column:
    return F.when(F.col("_kind") == "native", lookup({z[0]: z[1] for z in R.ZONES}, F.col("_1"))).otherwise(F.col("_1"))


def _class() -> Column:
    stripped = {c[0].replace(".", ""): c[1] for c in R.CLASSES}
    return F.when(F.col("_kind") == "native", lookup(stripped, F.col("_3"))).otherwise(F.col("_3"))


def with_canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """Canonical key of a free-text plate, null when no layout matches."""
    lot = F.when(F.col("_2") == "", "0").otherwise(deva_to_ascii(F.col("_2")))
    legacy = F.concat(F.lit("NP-L:"), F.concat_ws("-", _zone(), lot, _class(), deva_to_ascii(F.col("_4"))))
    embossed = F.concat(F.lit("NP-E:"), F.concat_ws("-", "_1", "_2", "_3", "_4"))
    key = F.when(F.col("_kind") == "embossed", embossed).when(F.col("_kind").isNotNull(), legacy)
    return once(plate_pieces(df, text), **{out: key}).drop("_kind", "_1", "_2", "_3", "_4")


def confidence_band(score: Column, weakest: Column, warned: Column, repaired: Column) -> Column:
    """Operational band of a parsed plate."""
    return (
        F.when((score >= 0.90) & (weakest >= 0.70) & ~warned & ~repaired, "high")
        .when((score >= 0.75) & (weakest >= 0.45), F.when(repaired, "low").otherwise("medium"))
        .when(score >= 0.50, "low")
        .otherwise("reject")
    )


def with_parsed(
    df: DataFrame, text: str, out: str = "plate", score: Column | None = None,
    observed_colour: str | None = None,
) -> DataFrame:
    """Full parse of ``text`` into a struct column: fields, ownership, size, warnings, errors, band."""
    score = F.lit(1.0) if score is None else score
    colour = F.col(observed_colour) if observed_colour else F.lit(None).cast("string")
    kind = F.col("_kind")
    legacy = kind.isin("native", "romanised")
    keys = list(df.columns)
    embossed = kind == "embossed"
    staged = once(
        plate_pieces(df, text),
        _p_score=score, _p_colour=colour,
        _p_zone=F.when(legacy, _zone()),
        _p_lot=F.when(legacy & (F.col("_2") != ""), deva_to_ascii(F.col("_2"))),
        _p_class=F.when(legacy, _class()),
        _p_province=F.when(embossed, F.col("_1").cast("int")),
        _p_letter=F.when(embossed, F.col("_2")),
        _p_series=F.when(embossed, F.col("_3")),
        _p_serial=deva_to_ascii(F.col("_4")),
    )
    staged = once(
        staged,
        _p_zone_deva=F.when(legacy, lookup({z[1]: z[0] for z in R.ZONES}, F.col("_p_zone"))),
        _p_class_deva=F.when(legacy, lookup({c[1]: c[0] for c in R.CLASSES}, F.col("_p_class"))),
        _p_owner=F.when(legacy, lookup({c[1]: c[2] for c in R.CLASSES}, F.col("_p_class"))).otherwise("unknown"),
        _p_size=F.when(legacy, lookup({c[1]: c[3] for c in R.CLASSES}, F.col("_p_class")))
        .when(embossed, lookup(R.EMBOSSED_SIZE, F.col("_p_letter"))).otherwise("unknown"),
    )
    staged = once(staged, _p_warn=_warnings(legacy), _p_fields=_fields(legacy))

    weakest = F.array_min(F.transform("_p_fields", lambda f: f["score"]))
    repaired = F.exists("_p_fields", lambda f: f["repaired"])
    blank = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    struct = F.struct(
        F.when(legacy, "devanagari").when(kind == "embossed", "embossed").otherwise("unknown").alias("system"),
        F.when(legacy, F.concat(F.lit("NP-L:"), F.concat_ws(
            "-", "_p_zone", F.coalesce("_p_lot", F.lit("0")), "_p_class", "_p_serial")))
        .when(kind == "embossed", F.concat(F.lit("NP-E:"), F.concat_ws(
            "-", "_p_province", "_p_letter", "_p_series", "_p_serial")))
        .otherwise("").alias("canonical"),
        F.when(legacy, F.concat_ws(
            " ", "_p_zone_deva", ascii_to_deva(F.col("_p_lot")), "_p_class_deva", ascii_to_deva(F.col("_p_serial"))))
        .when(kind == "embossed", F.concat_ws(" ", "_p_province", "_p_letter", "_p_series", "_p_serial"))
        .otherwise(F.col(text)).alias("display"),
        F.col("_p_zone").alias("zone"),
        F.col("_p_zone_deva").alias("zone_deva"),
        F.col("_p_lot").alias("lot"),
        F.col("_p_class").alias("vehicle_class"),
        F.col("_p_class_deva").alias("vehicle_class_deva"),
        F.col("_p_province").alias("province"),
        F.col("_p_letter").alias("class_letter"),
        F.col("_p_series").alias("series"),
        F.when(kind.isNotNull(), F.col("_p_serial")).alias("serial"),
        F.col("_p_owner").alias("ownership"),
        F.col("_p_size").alias("size_class"),
        _expected_colours(legacy).alias("expected_colour"),
        kind.isNotNull().alias("is_valid"),
        F.when(kind.isNull(), "reject").otherwise(
            confidence_band(F.col("_p_score"), weakest, F.size("_p_warn") > 0, repaired)
        ).alias("confidence"),
        F.when(kind.isNotNull(), F.col("_p_score")).otherwise(0.0).alias("score"),
        F.coalesce("_p_fields", F.array().cast(FIELDS_TYPE)).alias("fields"),
        F.coalesce("_p_warn", F.array().cast("array<string>")).alias("warnings"),
        F.when(blank, F.array(F.lit("empty input")))
        .when(kind.isNull(), F.array(F.lit("string does not match any Nepali plate layout")))
        .otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    return once(staged, **{out: struct}).select(*keys, out)


def fields_of(df: DataFrame, canonical: str, score: Column, out: str = "fields") -> DataFrame:
    """Add the named fields of a canonical key, legacy ones in their native script."""
    split = once(df, _b=F.split(F.expr(f"substring({canonical}, 6)"), "-"))
    b = F.col("_b")
    letter = b[1]

    def field(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), score.alias("score"), F.lit(False).alias("repaired"))

    legacy = F.array(
        field("zone", lookup({z[1]: z[0] for z in R.ZONES}, b[0])), field("lot", ascii_to_deva(b[1])),
        field("class", lookup({c[1]: c[0] for c in R.CLASSES}, b[2])), field("serial", ascii_to_deva(b[3])),
    )
    embossed = F.array(
        field("province", b[0]), field("class_letter", F.substring(letter, 1, 1)),
        field("subclass", F.when(F.length(letter) > 1, F.substring(letter, 2, 1))), field("series", b[2]), field("serial", b[3]),
    )
    both = F.when(F.col(canonical).startswith("NP-L:"), legacy).otherwise(embossed)
    return once(split, **{out: F.filter(both, lambda f: f["value"].isNotNull())}).drop("_b")


FIELDS_TYPE = "array<struct<name:string,value:string,score:double,repaired:boolean>>"


def _field(name: str, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"), value.alias("value"),
        F.col("_p_score").alias("score"), F.lit(False).alias("repaired"),
    )


def _fields(legacy: Column) -> Column:
    """Named pieces that are present, with the script they were written in."""
    old = F.array(
        _field("zone", F.col("_p_zone_deva")),
        _field("lot", ascii_to_deva(F.col("_p_lot"))),
        _field("class", F.col("_p_class_deva")),
        _field("serial", ascii_to_deva(F.col("_p_serial"))),
    )
    letter = F.col("_p_letter")
    new = F.array(
        _field("province", F.col("_p_province").cast("string")),
        _field("class_letter", F.substring(letter, 1, 1)),
        _field("subclass", F.when(F.length(letter) > 1, F.substring(letter, 2, 1))),
        _field("series", F.col("_p_series")),
        _field("serial", F.col("_p_serial")),
    )
    both = F.when(legacy, old).when(F.col("_kind") == "embossed", new)
    return F.filter(both, lambda f: f["value"].isNotNull())


def _warnings(legacy: Column) -> Column:
    colour = F.col("_p_colour")
    known = colour.isNotNull() & (colour != "unknown")
    disagrees = legacy & known & (colour != R.EMBOSSED_COLOUR) & (
        F.coalesce(lookup(R.COLOUR_OWNERSHIP, colour), F.lit("")) != F.col("_p_owner")
    )
    not_white = (F.col("_kind") == "embossed") & known & (colour != R.EMBOSSED_COLOUR)
    digits = F.length("_p_serial")
    notes = F.array(
        F.when(disagrees, F.format_string(
            "plate colour '%s' disagrees with ownership '%s' implied by class '%s'",
            colour, "_p_owner", "_p_class")),
        F.when(not_white, F.format_string("embossed plates are black-on-white; observed '%s'", colour)),
        F.when(digits < 4, F.format_string("serial has %d digits; four is standard", digits)),
    )
    return F.when(F.col("_kind").isNotNull(), F.array_compact(notes))


def _expected_colours(legacy: Column) -> Column:
    own_colour = lookup({v: k for k, v in R.COLOUR_OWNERSHIP.items()}, F.col("_p_owner"))
    return (
        F.when(legacy, F.array(own_colour, F.lit(R.EMBOSSED_COLOUR)))
        .when(F.col("_kind") == "embossed", F.array(F.lit(R.EMBOSSED_COLOUR)))
        .otherwise(F.array().cast("array<string>"))
    )


def system_for_colour(colour: Column) -> Column:
    """Plate system a colour scheme implies."""
    return (
        F.when(colour == R.EMBOSSED_COLOUR, "embossed")
        .when(colour.isin(*R.COLOUR_OWNERSHIP), "devanagari")
        .otherwise("unknown")
    )


def ownership_for_class(vehicle_class: Column) -> Column:
    return F.coalesce(lookup({c[1]: c[2] for c in R.CLASSES}, vehicle_class), F.lit("unknown"))


def size_for_class(vehicle_class: Column) -> Column:
    return F.coalesce(lookup({c[1]: c[3] for c in R.CLASSES}, vehicle_class), F.lit("unknown"))


def band_rank(confidence: Column) -> Column:
    """reject 0, low 1, medium 2, high 3; unknown bands rank as reject."""
    return F.coalesce(lookup({b: i for i, b in enumerate(R.BANDS)}, confidence), F.lit(0))


def near_miss_pairs(plates: DataFrame, plate: str = "plate_canonical") -> DataFrame:
    """Pairs of distinct plates that differ in one glyph from the same confusion group.

    Each plate emits one row per (position, partner glyph); an equi-join on the masked text
    and glyph finds partners, so no group of plates is ever paired with itself.
    """
    partners: dict[str, list[str]] = {}
    for a, b in R.confusable_pairs():
        partners.setdefault(a, []).append(b)
    distinct = plates.select(F.col(plate).alias("plate")).distinct()
    glyphs = distinct.select(
        "plate", F.posexplode(F.split(F.expr("substring(plate, 6)"), "")).alias("pos", "glyph")
    ).filter(F.col("glyph").rlike("[0-9A-Z०-९]"))
    masked = glyphs.withColumn(
        "mask", F.concat(F.expr("substring(plate, 1, pos + 5)"), F.lit("*"), F.expr("substring(plate, pos + 7)"))
    )
    wanted = masked.select(
        "mask", F.col("plate").alias("plate_a"), F.col("glyph").alias("glyph_a"),
        F.explode(lookup(partners, F.col("glyph"))).alias("glyph"),
    )
    have = masked.select("mask", "glyph", F.col("plate").alias("plate_b"))
    return wanted.join(have, ["mask", "glyph"]).filter("plate_a < plate_b").select(
        "plate_a", "plate_b", "glyph_a", F.col("glyph").alias("glyph_b")
    )
