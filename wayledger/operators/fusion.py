"""Many frames of one passage to one read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import plates as P
from ..functions.literals import constant_array
from ..functions.once import once
from ..session import materialise


def frame_weight(quality: Column, gamma: float = 2.0) -> Column:
    """Clamped quality to the power gamma."""
    return F.pow(F.least(F.greatest(quality, F.lit(0.0)), F.lit(1.0)), F.lit(gamma))


def pooled_posteriors(frames: DataFrame, gamma: float = 2.0) -> DataFrame:
    """Weighted log-linear pooling of aligned log-probabilities, one row per (track, t, v).

    Tracks whose frames differ in shape, are empty, or carry no weight give no rows. Sums are
    pre-aggregated before the shuffle; the normalising window spans one vocabulary only.
    """
    weighted = frames.select(
        "track_id", "log_probs", frame_weight(F.col("quality"), gamma).alias("w"),
        F.size("log_probs").alias("n_t"),
        F.transform("log_probs", lambda r: F.size(r)).alias("widths"),
    )
    shape = weighted.groupBy("track_id").agg(
        F.min("n_t").alias("t_min"), F.max("n_t").alias("t_max"),
        F.min(F.array_min("widths")).alias("v_min"), F.max(F.array_max("widths")).alias("v_max"),
        F.sum("w").alias("total_w"),
    ).filter("t_min = t_max and v_min = v_max and t_min > 0 and v_min > 0 and total_w > 0")
    cells = weighted.filter("w > 0").select("track_id", "w", F.posexplode("log_probs").alias("t", "row")).select(
        "track_id", "w", "t", F.posexplode("row").alias("v", "lp")
    )
    mixed = cells.groupBy("track_id", "t", "v").agg(F.sum(F.col("w") * F.col("lp")).alias("s")).join(
        shape.select("track_id", "total_w"), "track_id"
    ).select("track_id", "t", "v", (F.col("s") / F.col("total_w")).alias("x"))
    row = W.partitionBy("track_id", "t")
    peak = mixed.withColumn("m", F.max("x").over(row))
    total = peak.withColumn("z", F.sum(F.exp(F.col("x") - F.col("m"))).over(row))
    return total.select("track_id", "t", "v", (F.col("x") - F.col("m") - F.log("z")).alias("log_prob"))


def pooled_colour(frames: DataFrame, gamma: float = 2.0) -> DataFrame:
    """Weighted mean colour posterior per track over reliable frames: ``(track_id, colour, p)``."""
    w = frame_weight(F.col("quality"), gamma)
    usable = frames.select("track_id", "colour", "colour_reliable", w.alias("w")).filter(
        "colour is not null and colour_reliable and w > 0"
    )
    weight = usable.groupBy("track_id").agg(F.sum("w").alias("total"))
    mass = usable.select("track_id", "w", F.explode("colour").alias("name", "p")).groupBy(
        "track_id", F.col("name").alias("colour")
    ).agg(F.sum(F.col("w") * F.col("p")).alias("mass"))
    return mass.join(weight, "track_id").select("track_id", "colour", (F.col("mass") / F.col("total")).alias("p"))


def best_colour(pooled: DataFrame) -> DataFrame:
    """Most likely colour per track, with the system it implies when certain enough."""
    top = pooled.groupBy("track_id").agg(F.max(F.struct("p", "colour")).alias("b")).select(
        "track_id", F.col("b.colour").alias("colour"), F.col("b.p").alias("p")
    )
    implied = P.system_for_colour(F.col("colour"))
    return top.withColumn("system_hint", F.when((F.col("p") >= 0.6) & (implied != "unknown"), implied))


def colour_bonus(posterior: Column, ownership: Column, weight: float = 1.0, floor: float = 1e-3) -> Column:
    """Log bonus of a class letter's owner under a colour posterior map; 0 without evidence."""

    def mass_of(colour: str) -> Column:
        return F.coalesce(F.try_element_at(posterior, F.lit(colour)), F.lit(0.0))

    legacy = sum((mass_of(c) for c in R.COLOUR_OWNERSHIP), F.lit(0.0))
    own = F.lit(0.0)
    for colour, owner in R.COLOUR_OWNERSHIP.items():
        own = own + F.when(ownership == owner, mass_of(colour)).otherwise(0.0)
    bonus = F.lit(weight) * F.log(F.greatest(own / legacy, F.lit(floor)))
    known = ownership.isNotNull() & (ownership != "unknown") & posterior.isNotNull()
    return F.when(known & (legacy > 0), bonus).otherwise(0.0)


def reranked(candidates: DataFrame, posterior: str = "colour", weight: float = 1.0) -> DataFrame:
    """Candidates of each frame re-ranked by log-probability plus the colour bonus."""
    letter = F.regexp_extract("canonical", "^NP-L:[A-Z]+-[0-9]*-([A-Z]+)-", 1)
    scored = candidates.withColumn("colour_bonus", colour_bonus(F.col(posterior), P.ownership_for_class(letter), weight))
    scored = scored.withColumn("total", F.col("log_prob") + F.col("colour_bonus"))
    w = W.partitionBy("track_id", "frame").orderBy(F.col("total").desc(), "canonical", "rank")
    return scored.withColumn("new_rank", F.row_number().over(w) - 1)


# Layout slots in order; optional slots may be absent.
SLOTS = {
    "devanagari": ["zone", "lot", "class", "serial"],
    "embossed": ["province", "class_letter", "subclass", "series", "serial"],
}
_ALL_SLOTS = list(dict.fromkeys(SLOTS["devanagari"] + SLOTS["embossed"]))


def plate_votes(candidates: DataFrame, pooled: DataFrame | None = None, gamma: float = 2.0) -> DataFrame:
    """Evidence per (track, plate), the only pass over the frames.

    A candidate votes with frame weight times its score, halved per rank; each of its fields
    votes with that times the field's own score (``s_*``). Also kept: the score and band the
    plate was first seen with, and in how many frames it was the top choice (``tops``). All
    buffers are numbers, so the sums are hashed before the shuffle and never sorted.
    ``pooled`` candidates vote with the track's whole frame weight.
    """
    w = frame_weight(F.col("quality"), gamma)
    rank = F.col("rank").cast("bigint")
    rows = candidates.withColumn("w", w).filter("w > 0").select(
        "track_id", "system", "canonical", "score", P.band_rank(F.col("confidence")).alias("band"),
        F.struct(F.col("frame").cast("bigint").alias("frame"), rank.alias("rank")).alias("seen"), F.when(rank == 0, F.col("w")).otherwise(0.0).alias("top_w"),
        (rank == 0).alias("top"), (F.col("w") * F.col("score") * F.pow(F.lit(0.5), rank)).alias("cw"),
        F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], f["score"]))).alias("scores"),
    )
    if pooled is None:
        return _summed(rows)
    weight = rows.groupBy("track_id").agg(F.sum("top_w").alias("total_w"))
    extra = pooled.join(weight, "track_id", "left").select(
        "track_id", "system", "canonical", "score", P.band_rank(F.col("confidence")).alias("band"),
        F.struct(F.lit((1 << 63) - 1).alias("frame"), rank.alias("rank")).alias("seen"), F.lit(0.0).alias("top_w"), F.lit(False).alias("top"),
        (F.coalesce("total_w", F.lit(1.0)) * F.col("score")).alias("cw"),
        # Field votes of a pooled candidate carry the plate's score.
        F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], F.col("score").alias("score")))).alias("scores"),
    )
    return _summed(rows.unionByName(extra))


def _summed(rows: DataFrame) -> DataFrame:
    votes = [
        F.sum(F.col("cw") * F.greatest(F.try_element_at("scores", F.lit(s)), F.lit(1e-6))).alias(f"s_{s}") for s in _ALL_SLOTS
    ]
    return rows.groupBy("track_id", "canonical", "system").agg(
        F.sum("cw").alias("votes"), F.min_by("score", "seen").alias("first_score"), F.min_by("band", "seen").alias("first_band"),
        F.count_if("top").alias("tops"), *votes,
    )


def field_votes(plates: DataFrame) -> DataFrame:
    """Votes per (track, field, value). A plate's field values follow from its key; a field
    without votes was absent (a legacy plate without lot shares the key of lot 0)."""
    with_fields = P.fields_of(plates, "canonical", F.lit(None).cast("double"))
    votes = F.create_map(*[x for s in _ALL_SLOTS for x in (F.lit(s), F.col(f"s_{s}"))])
    rows = with_fields.select("track_id", votes.alias("votes"), F.explode("fields").alias("f")).select(
        "track_id", F.col("f.name").alias("field"), F.col("f.value").alias("value"), F.try_element_at("votes", F.col("f.name")).alias("votes")
    ).filter("votes is not null")
    return rows.groupBy("track_id", "field", "value").agg(F.sum("votes").alias("votes"))


def fuse(
    candidates: DataFrame, pooled: DataFrame | None = None, colours: DataFrame | None = None,
    gamma: float = 2.0, top_k: int = 3,
) -> DataFrame:
    """Consensus read per track.

    The winning value of each slot is assembled and must form a legal plate; otherwise the
    best whole plate stands. Ties go to the larger value. Frames are reduced to distinct
    plates first; everything after is aggregates and a group-limited window over those.
    """
    # Distinct plates are a small part of the frames: written once, so that the steps below
    # never run over the frames again.
    plates = materialise(plate_votes(candidates, pooled, gamma))
    tracks = plates.groupBy("track_id").agg(
        F.max(F.struct("votes", "canonical", "system", "first_score", "first_band")).alias("best"), F.sum("tops").alias("n_frames"),
        F.sum(F.when(F.col("system") == "devanagari", F.col("votes"))).alias("legacy_votes"),
        F.sum(F.when(F.col("system") == "embossed", F.col("votes"))).alias("embossed_votes"),
    )
    winners = field_votes(plates).groupBy("track_id", "field").agg(
        F.max(F.struct("votes", "value")).alias("top"), F.sum("votes").alias("total")
    )
    slots = winners.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct(  # at most eight slots
        "field", F.struct(F.col("top.value").alias("value"), (F.col("top.votes") / F.col("total")).alias("support"))
    ))).alias("slots"))
    # Flat columns: structs that pass a generator confuse nested-column pruning.
    flat = tracks.select(
        "track_id", "n_frames", "legacy_votes", "embossed_votes", F.col("best.canonical").alias("best_canonical"),
        F.col("best.system").alias("best_system"), F.col("best.first_score").alias("best_score"),
        F.element_at(constant_array(R.BANDS), F.col("best.first_band") + 1).alias("best_confidence"),
    )
    parts = flat.join(slots, "track_id", "left")
    if colours is not None:
        parts = parts.join(colours.select("track_id", F.col("colour").alias("track_colour")), "track_id", "left")
    else:
        parts = parts.withColumn("track_colour", F.lit(None).cast("string"))
    chosen = _assembled(parts)
    backing = plates.select("track_id", "canonical", F.col("votes").alias("backing"), "tops")
    w = W.partitionBy("track_id").orderBy(F.col("votes").desc(), F.col("canonical").desc())
    leaders = plates.select("track_id", "canonical", "votes").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_k)
    others = leaders.join(chosen.select("track_id", F.col("canonical").alias("won")), "track_id").filter("canonical <> won").groupBy(
        "track_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("r", "canonical"))), lambda s: s["canonical"]),
                                1, max(1, top_k - 1)).alias("alternatives"))
    out = chosen.join(backing, ["track_id", "canonical"], "left").join(others, "track_id", "left")
    agreement = F.when(F.col("n_frames") > 0, F.coalesce("tops", F.lit(0)) / F.col("n_frames")).otherwise(0.0)
    return out.select(
        "track_id", "canonical", "system", rebanded(F.col("band"), agreement, F.col("n_frames")).alias("confidence"), "plate_score",
        F.log(F.greatest(F.coalesce("backing", F.lit(1e-9)), F.lit(1e-9))).alias("score"),
        "n_frames", agreement.alias("agreement"),
        F.coalesce("field_support", F.create_map().cast("map<string,double>")).alias("field_support"),
        (F.coalesce("alternatives", F.array().cast("array<string>")) if top_k > 1 else F.array().cast("array<string>")).alias("alternatives"),
        "assembled",
    )


def _assembled(parts: DataFrame) -> DataFrame:
    """One row per track: the assembled plate if legal, else the best whole plate."""
    legacy = F.coalesce(F.col("legacy_votes"), F.lit(-1.0)) > F.coalesce(F.col("embossed_votes"), F.lit(-1.0))

    def of(name: str, part: str) -> list[Column]:
        return [F.try_element_at("slots", F.lit(s))[part] for s in SLOTS[name]]

    supports = F.when(legacy, F.array_compact(F.array(*of("devanagari", "support")))).otherwise(
        F.array_compact(F.array(*of("embossed", "support"))))
    staged = once(
        parts,
        legacy=legacy,
        text=F.when(legacy, P.strip_separators(F.concat_ws("", *of("devanagari", "value")))).otherwise(F.concat_ws("", *of("embossed", "value"))),
        mean_support=F.aggregate(supports, F.lit(0.0), lambda a, x: a + x) / F.size(supports),
    )
    legal = F.when(F.col("legacy"), F.col("text").rlike(P.NATIVE)).otherwise(F.col("text").rlike(P.EMBOSSED) & ~F.col("text").startswith("NEP"))
    staged = once(staged, legal=F.coalesce(legal, F.lit(False)))
    parsed = P.with_parsed(staged.withColumn("_legal_text", F.when(F.col("legal"), F.col("text"))), "_legal_text", "parsed",
                           score=F.col("mean_support"), observed_colour="track_colour")
    ok, p = F.col("legal"), F.col("parsed")
    return parsed.select(
        "track_id", F.when(ok, p["canonical"]).otherwise(F.col("best_canonical")).alias("canonical"),
        F.when(ok, p["system"]).otherwise(F.col("best_system")).alias("system"),
        F.when(ok, p["confidence"]).otherwise(F.col("best_confidence")).alias("band"),
        F.when(ok, F.col("mean_support")).otherwise(F.col("best_score")).alias("plate_score"),
        F.when(ok, _support_map()).alias("field_support"), ok.alias("assembled"), "n_frames",
    )


def _support_map() -> Column:
    return F.transform_values("slots", lambda k, v: v["support"])


def rebanded(band: Column, agreement: Column, n_frames: Column) -> Column:
    """Confidence band adjusted by agreement across frames; one frame caps at medium."""
    return (
        F.when(n_frames <= 1, F.when(band == "high", "medium").otherwise(band))
        .when((agreement >= 0.8) & (n_frames >= 3) & (band == "medium"), "high")
        .when((agreement < 0.5) & (band == "high"), "medium")
        .when(agreement < 0.35, "low")
        .otherwise(band)
    )
