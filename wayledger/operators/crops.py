"""Plate crop quality and choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ramp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def crop_quality(b: Column, sharpness: Column, detector: Column, frame_w: Column, frame_h: Column) -> Column:
    """How likely a crop is to read: size, sharpness and detector, gated by edge and legibility."""
    width = F.greatest(b["x2"] - b["x1"], F.lit(0.0))
    mx, my = frame_w * 0.04, frame_h * 0.04
    clipped = (b["x1"] < mx) | (b["y1"] < my) | (b["x2"] > frame_w - mx) | (b["y2"] > frame_h - my)
    graded = _ramp(width, 24.0, 110.0) * 0.45 + sharpness * 0.35 + F.least(
        F.greatest(detector, F.lit(0.0)), F.lit(1.0)
    ) * 0.20
    return graded * F.when(clipped, 0.55).otherwise(1.0) * _ramp(width, 18.0, 28.0)


def select_crops(
    candidates: DataFrame, k: int = 8, window: int = 6, penalty: float = 0.6, min_quality: float = 0.05
) -> DataFrame:
    """Up to ``k`` good crops per track, spread in time; needs ``quality`` and one crop per frame.

    Greedy: each pick discounts frames within ``window`` of it. At most
    ``(k - 1) * (2 * window - 1)`` frames can be discounted before the last pick, so one more
    than that of the best frames decides the outcome exactly. The group limit applies before
    the shuffle, which bounds what any track brings into one task.
    """
    usable = candidates.filter(F.col("quality") >= min_quality)
    reach = (k - 1) * (2 * window - 1) + 1
    w = W.partitionBy("track_id").orderBy(F.col("quality").desc(), "frame_index")
    best = usable.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= reach)
    pools = best.groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct("frame_index", "quality"))).alias("pool")
    )
    item = "struct<frame_index:bigint,quality:double>"
    typed = pools.withColumn("pool", F.col("pool").cast(f"array<{item}>"))

    def value(c: Column, chosen: Column) -> Column:
        def discount(acc: Column, s: Column) -> Column:
            gap = F.abs(s["frame_index"] - c["frame_index"])
            near = F.lit(1.0) - F.lit(penalty) * (F.lit(1.0) - gap / F.lit(float(window)))
            return F.when(gap < window, acc * near).otherwise(acc)

        return F.aggregate(chosen, c["quality"], discount)

    def pick(chosen: Column, _: Column) -> Column:
        left = F.filter("pool", lambda c: ~F.exists(chosen, lambda s: s["frame_index"] == c["frame_index"]))
        scored = F.transform(left, lambda c: F.struct(
            value(c, chosen).alias("v"), (-c["frame_index"]).alias("first"), c.alias("c")
        ))
        return F.concat(chosen, F.transform(F.slice(F.array_sort(scored, lambda a, b: (
            F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).otherwise(F.signum(b["first"] - a["first"]).cast("int"))
        )), 1, 1), lambda s: s["c"]))

    greedy = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast(f"array<{item}>"), pick)
    chosen = typed.select("track_id", F.when(F.size("pool") <= k, F.col("pool")).otherwise(greedy).alias("chosen"))
    return chosen.select("track_id", F.explode("chosen").alias("c")).select("track_id", "c.frame_index", "c.quality")
