"""Fixed values of the domain: zones, classes, colours, roles, retention.

Everything here is a constant that results must agree with; no logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Legacy zones as (Devanagari, roman, name, province).
ZONES = [
    ("मे", "ME", "Mechi", 1),
    ("को", "KO", "Koshi", 1),
    ("स", "SA", "Sagarmatha", 1),
    ("ज", "JA", "Janakpur", 2),
    ("बा", "BA", "Bagmati", 3),
    ("ना", "NA", "Narayani", 3),
    ("ग", "GA", "Gandaki", 4),
    ("लु", "LU", "Lumbini", 5),
    ("ध", "DHA", "Dhawalagiri", 4),
    ("रा", "RA", "Rapti", 5),
    ("भे", "BHE", "Bheri", 6),
    ("क", "KA", "Karnali", 6),
    ("से", "SE", "Seti", 7),
    ("म", "MA", "Mahakali", 7),
]

# Legacy classes as (Devanagari, roman, ownership, size).
CLASSES = [
    ("क", "KA", "private", "heavy"),
    ("च", "CHA", "private", "light"),
    ("प", "PA", "private", "motorcycle"),
    ("ख", "KHA", "public", "heavy"),
    ("ज", "JA", "public", "light"),
    ("फ", "PHA", "public", "motorcycle"),
    ("ग", "GA", "government", "heavy"),
    ("झ", "JHA", "government", "light"),
    ("ब", "BA", "government", "motorcycle"),
    ("घ", "GHA", "corporation", "heavy"),
    ("ञ", "NYA", "corporation", "light"),
    ("य", "YA", "tourist", "any"),
    ("सी.डी.", "CD", "diplomatic", "any"),
]

# Provinces as (number, name).
PROVINCES = [
    (1, "Koshi"), (2, "Madhesh"), (3, "Bagmati"), (4, "Gandaki"),
    (5, "Lumbini"), (6, "Karnali"), (7, "Sudurpashchim"),
]

# Embossed class -> size band.
EMBOSSED_SIZE = {
    "A": "motorcycle", "B": "light", "C": "light", "C1": "light", "D": "heavy",
    "E": "heavy", "F": "heavy", "G": "heavy", "H": "heavy", "H1": "heavy",
    "H2": "heavy", "I": "heavy", "I1": "heavy", "I2": "heavy", "I3": "heavy",
    "J": "heavy", "J1": "heavy", "J2": "heavy", "J3": "heavy", "J4": "heavy",
    "J5": "heavy", "K": "motorcycle",
}

# Plate colour -> ownership it denotes on a legacy plate.
COLOUR_OWNERSHIP = {
    "red_white": "private",
    "black_white": "public",
    "white_red": "government",
    "yellow_black": "corporation",
    "green_white": "tourist",
    "blue_white": "diplomatic",
}
EMBOSSED_COLOUR = "white_black"
COLOURS = [*COLOUR_OWNERSHIP, EMBOSSED_COLOUR]

# Glyphs that collapse into each other in a bad image.
DEVANAGARI_CONFUSIONS = (
    ("ग", "ध", "घ"), ("च", "ज", "ञ"), ("प", "फ", "य"), ("ब", "भ", "क"), ("क", "ख"), ("म", "भ"), ("स", "ग"),
    ("२", "३"), ("४", "५"), ("६", "७", "९"), ("०", "९"), ("१", "३"), ("८", "६"),
)
LATIN_CONFUSIONS = (
    ("0", "O", "D", "Q"), ("1", "I", "L"), ("8", "B"), ("5", "S"), ("2", "Z"), ("6", "G"), ("U", "V"), ("7", "T"), ("E", "F"), ("C", "G"),
)

# Observed vehicle types a plate size band may be carried by.
SIZE_VEHICLES = {
    "motorcycle": ["motorcycle", "scooter", "moped"],
    "light": ["car", "jeep", "van", "tempo", "auto", "pickup"],
    "heavy": ["truck", "bus", "lorry", "minibus", "tractor", "excavator", "crane"],
}

# Confidence bands, weakest first.
BANDS = ["reject", "low", "medium", "high"]

# Action -> roles that may perform it.
PERMISSIONS = {
    "read.live": ["operator", "investigator", "admin"],
    "read.search": ["investigator", "admin"],
    "read.export": ["investigator", "admin"],
    "read.image": ["operator", "investigator", "admin"],
    "session.search": ["operator", "investigator", "admin"],
    "watchlist.read": ["operator", "investigator", "admin"],
    "watchlist.write": ["investigator", "admin"],
    "hit.acknowledge": ["operator", "investigator", "admin"],
    "review.read": ["operator", "investigator", "admin"],
    "review.write": ["operator", "investigator", "admin"],
    "node.enrol": ["admin"],
    "admin.users": ["admin"],
    "admin.retention": ["admin"],
    "erasure.request": ["admin", "investigator"],
    "audit.read": ["auditor"],
}
# Actions that need a stated purpose, and its least length.
REASON_REQUIRED = [
    "read.search", "read.export", "read.image", "session.search",
    "watchlist.write", "erasure.request",
]
MIN_REASON_LENGTH = 8

# Days each kind of record is kept.
READS_DAYS = 365
SESSIONS_DAYS = 365
IMAGES_DAYS = 90
UNREADABLE_DAYS = 90
AUDIT_DAYS = 365 * 7

# Relative road frequency of legacy classes and zones.
CLASS_WEIGHTS = {
    "KA": 2.5, "CHA": 22.0, "PA": 55.0, "KHA": 3.0, "JA": 6.0, "PHA": 4.0,
    "GA": 1.2, "JHA": 2.0, "BA": 1.5, "GHA": 0.7, "NYA": 0.8, "YA": 1.0, "CD": 0.3,
}
ZONE_WEIGHTS = {
    "ME": 4.0, "KO": 8.0, "SA": 5.5, "JA": 6.0, "BA": 34.0, "NA": 10.0, "GA": 7.0,
    "LU": 9.0, "DHA": 2.5, "RA": 4.5, "BHE": 4.0, "KA": 1.5, "SE": 3.0, "MA": 2.0,
}

# Kinds of events.
EVENT_KINDS = ["plate_read", "zone_entry", "zone_exit", "session_plate", "unreadable_passage"]
GENESIS = "0" * 64
# Fixed value: rows of a result page at most.
MAX_LIMIT = 1000
# Fixed value: the Devanagari digits.
DEVA_DIGITS = "०१२३४५६७८९"


def vocabulary() -> list[str]:
    """The 71 recogniser tokens: blank, Devanagari digits and letters, Latin digits and letters."""
    letters = list(dict.fromkeys([z[0] for z in ZONES] + [c[0] for c in CLASSES]))
    latin = [str(d) for d in range(10)] + [chr(ord("A") + i) for i in range(26)]
    return ["∅", *DEVA_DIGITS, *letters, *latin]


def confusable_pairs() -> list[tuple[str, str]]:
    """Symmetric glyph pairs of the confusion groups."""
    pairs = {
        (a, b)
        for group in DEVANAGARI_CONFUSIONS + LATIN_CONFUSIONS
        for a in group
        for b in group
        if a != b
    }
    return sorted(pairs)


def zones_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone_deva string, zone string, zone_name string, province int")


def classes_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CLASSES, "class_deva string, vehicle_class string, ownership string, size_class string"
    )


def permissions_df(spark: SparkSession) -> DataFrame:
    rows = [(a, r, a in REASON_REQUIRED) for a, roles in PERMISSIONS.items() for r in roles]
    return spark.createDataFrame(rows, "action string, role string, reason_required boolean")
