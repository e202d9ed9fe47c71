"""Accuracy reports and corpus analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import ctc, plates as P
from .ordered import with_previous

METHODS = ["greedy_ok", "grammar_ok", "colour_ok"]


def width_band(px: Column) -> Column:
    return (
        F.when((px >= 0) & (px < 40), "0-40px").when((px >= 40) & (px < 60), "40-60px")
        .when((px >= 60) & (px < 90), "60-90px").when((px >= 90) & (px < 130), "90-130px")
        .otherwise("130px+")
    )


def quality_band(q: Column) -> Column:
    return F.when(q >= 0.7, "clean").when(q >= 0.4, "moderate").otherwise("degraded")


def stratified_accuracy(samples: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """Count and accuracy of each method per stratum; a sample counts in five strata.

    Samples are first counted per combination of strata, so the five-fold spread runs over
    a handful of rows.
    """
    parts = samples.select(
        "system", width_band(F.col("width_px")).alias("w"), quality_band(F.col("quality")).alias("q"),
        F.col("two_row"), *methods,
    ).groupBy("system", "w", "q", "two_row").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(m)).alias(m) for m in methods]
    )
    strata = F.array(
        F.lit("ALL"), F.concat(F.lit("system:"), "system"), F.concat(F.lit("width:"), "w"),
        F.concat(F.lit("quality:"), "q"),
        F.concat(F.lit("layout:"), F.when(F.col("two_row"), "two-row").otherwise("single-row")),
    )
    return parts.withColumn("stratum", F.explode(strata)).groupBy("stratum").agg(
        F.sum("n").alias("n"), *[(F.sum(m) / F.sum("n")).alias(m.replace("_ok", "")) for m in methods]
    )


def calibration(samples: DataFrame, correct: str = "colour_ok") -> DataFrame:
    """Count, accuracy and error rate per confidence band."""
    return samples.groupBy("confidence").agg(
        F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    ).withColumn("error_rate", 1.0 - F.col("accuracy"))


def greedy_metrics(samples: DataFrame) -> DataFrame:
    """Exact match, token error rate, colour accuracy and quality error in one row.

    Needs ``truth``, ``predicted`` (token arrays), ``colour``, ``predicted_colour``,
    ``quality``, ``predicted_quality``.
    """
    return samples.agg(
        F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("exact_match"),
        (F.sum(ctc.token_edit_distance(F.col("predicted"), F.col("truth"))) / F.sum(F.size("truth"))).alias("token_error_rate"),
        F.avg((F.col("colour") == F.col("predicted_colour")).cast("double")).alias("colour_accuracy"),
        F.avg(F.abs(F.col("quality") - F.col("predicted_quality"))).alias("quality_mae"),
        F.count("*").alias("n"),
    )


def track_report(frames: DataFrame, fused: DataFrame) -> DataFrame:
    """Fused read against any correct frame and against the first frame.

    ``frames``: ``track_id, frame, truth, ok``; ``fused``: ``track_id, canonical``.
    """
    per = frames.groupBy("track_id").agg(
        F.max("ok").alias("any_ok"), F.min_by("ok", "frame").alias("first_ok"), F.min_by("truth", "frame").alias("truth")
    ).join(fused.select("track_id", "canonical"), "track_id", "left")
    hit = F.coalesce(F.col("canonical") == F.col("truth"), F.lit(False))
    return per.agg(
        F.count("*").alias("n_tracks"), F.avg(hit.cast("double")).alias("fused"),
        F.avg(F.col("any_ok").cast("double")).alias("oracle_best_frame"),
        F.avg(F.col("first_ok").cast("double")).alias("first_frame"),
    )


def unit_hash(key: Column, seed: int = 0) -> Column:
    """Deterministic number in [0, 1) per key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 48))


def split(samples: DataFrame, unit: str, val_fraction: float = 0.05, seed: int = 0) -> DataFrame:
    """Add ``split``: ``val`` for ``max(1, floor(n * fraction))`` whole units, else ``train``.

    Units are ordered by hash. A histogram of the hash finds the bucket the cut falls in, and
    only that bucket is ranked, so no task sorts all units.
    """
    n_buckets = 65536
    units = samples.select(unit).distinct().withColumn("_h", unit_hash(F.col(unit), seed)).withColumn(
        "_bucket", F.floor(F.col("_h") * n_buckets).cast("int")
    )
    counts = units.groupBy("_bucket").agg(F.count("*").alias("_n"))
    everything = W.partitionBy(F.lit(0))  # at most n_buckets rows
    ahead = everything.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cut = counts.select(
        "_bucket", "_n", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(F.sum("_n").over(everything) * F.lit(val_fraction)).cast("bigint")).alias("_want"),
    ).filter("_before < _want")
    # At most n_buckets rows: a proven bound for the broadcast.
    near = units.join(F.broadcast(cut), "_bucket")
    whole = near.filter("_before + _n <= _want").select(unit)
    w = W.partitionBy("_bucket").orderBy("_h", unit)
    edge = near.filter("_before + _n > _want").withColumn("_r", F.row_number().over(w)).filter(
        "_before + _r <= _want"
    ).select(unit)
    val = whole.unionByName(edge).withColumn("_val", F.lit(True))
    return samples.join(val, unit, "left").withColumn(
        "split", F.when(F.col("_val"), "val").otherwise("train")
    ).drop("_val")


def split_corpus(samples: DataFrame, val_fraction: float = 0.05, seed: int = 0) -> DataFrame:
    """Split by track when every row has one, else by row (``path``)."""
    untracked = samples.filter("track_id is null").limit(1).count()
    return split(samples, "path" if untracked else "track_id", val_fraction, seed)


def tracks_in_order(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their position in the track, frames in order, without gathering tracks."""
    from .tracks import with_row_number

    return with_row_number(samples, keys, "frame").withColumnRenamed("_n", "position")


def legality(outputs: DataFrame) -> DataFrame:
    """Greedy outputs split into correct, wrong but legal, and not a plate.

    ``truth`` and ``predicted`` are token arrays.
    """
    text = outputs.withColumn("_text", F.array_join("predicted", "")).withColumn(
        "_compact", P.strip_separators(F.col("_text"))
    )
    legal = F.col("_compact").rlike(P.NATIVE) | (F.col("_text").rlike(P.EMBOSSED) & ~F.col("_text").startswith("NEP"))
    label = F.when(F.col("truth") == F.col("predicted"), "correct").when(legal, "wrong_legal").otherwise("not_a_plate")
    return text.groupBy(label.alias("outcome")).agg(F.count("*").alias("n"))


def grid(spark: SparkSession) -> DataFrame:
    """Every (zone, class) and (province, class) pair a balanced corpus must hold."""
    rows = [("NP-L", z[1], c[1]) for z in R.ZONES for c in R.CLASSES]
    rows += [("NP-E", str(p), c) for p, _ in R.PROVINCES for c in R.EMBOSSED_SIZE if c != "J"]
    return spark.createDataFrame(rows, "system string, region string, vehicle_class string")


def missing_structures(corpus: DataFrame) -> DataFrame:
    """Pairs of the grid no canonical plate of the corpus has."""
    pattern = "^(NP-[LE]):([A-Z0-9]+)-(?:[0-9]{1,2}-)?([A-Z][A-Z0-9]*)-"
    have = corpus.select(
        F.regexp_extract("canonical", pattern, 1).alias("system"), F.regexp_extract("canonical", pattern, 2).alias("region"),
        F.regexp_extract("canonical", pattern, 3).alias("vehicle_class"),
    ).distinct()
    return grid(corpus.sparkSession).join(have, ["system", "region", "vehicle_class"], "left_anti")


def reweighted(corpus: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` legacy samples drawn without replacement by road frequency of zone and class."""
    zone = F.regexp_extract("canonical", "^NP-L:([A-Z]+)-", 1)
    klass = F.regexp_extract("canonical", "^NP-L:[A-Z]+-[0-9]+-([A-Z]+)-", 1)
    weight = P.lookup(R.ZONE_WEIGHTS, zone) * P.lookup(R.CLASS_WEIGHTS, klass)
    u = F.greatest(unit_hash(F.col(key), seed), F.lit(1e-15))
    drawn = corpus.withColumn("weight", weight).filter("weight is not null").withColumn(
        "draw", -F.log(u) / F.col("weight")
    )
    return drawn.orderBy("draw", key).limit(n)


def manifest(corpus: DataFrame) -> DataFrame:
    """Counts, tracks and font authenticity of a corpus index in one row."""
    return corpus.agg(
        F.count("*").alias("count"), F.count_distinct("track_id").alias("tracks"),
        F.count("frame").alias("frames"), F.count_if("grid_seeded").alias("grid_seeded"),
        F.bool_and("font_authentic").alias("fonts_authentic"),
    )


def track_shapes(frames: DataFrame) -> DataFrame:
    """Per track: frames, monotone width, best frame, whether the best is the last, quality spread."""
    prev = with_previous(frames, ["track_id"], "frame", ["width_px"])
    d = F.col("width_px") - F.col("prev_width_px")
    return prev.groupBy("track_id").agg(
        F.count("*").alias("n_frames"),
        (F.coalesce(F.bool_and(d >= 0), F.lit(True)) | F.coalesce(F.bool_and(d <= 0), F.lit(True))).alias("monotone"),
        F.max(F.struct("quality", (-F.col("frame")).alias("nf"))).alias("b"), F.max("frame").alias("last_frame"),
        (F.max("quality") - F.min("quality")).alias("quality_spread"),
    ).select(
        "track_id", "n_frames", "monotone", (-F.col("b.nf")).alias("best_frame"),
        (-F.col("b.nf") == F.col("last_frame")).alias("best_is_last"), "quality_spread",
    )
