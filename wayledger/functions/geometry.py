"""Boxes, polygons, distances and layout arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
TWO_ROW_ASPECT = 2.7


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dp = F.radians(lat2 - lat1) / 2
    dl = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(dp), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(chord))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def reference_x(b: Column) -> Column:
    """Bottom-centre x: where the vehicle touches the road."""
    return (b["x1"] + b["x2"]) / 2.0


def reference_y(b: Column) -> Column:
    return b["y2"]


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd crossing test of a point against an array of ``(x, y)`` vertices."""
    n = F.size(polygon)
    following = F.concat(F.slice(polygon, 2, F.greatest(n - 1, F.lit(0))), F.slice(polygon, 1, 1))
    crossings = F.zip_with(
        polygon,
        following,
        lambda a, b: F.when(
            ((a["y"] > y) != (b["y"] > y))
            & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"] + F.lit(1e-12)) + a["x"]),
            1,
        ).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda acc, c: acc + c) % 2 == 1


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    zero = F.lit(0.0)
    inter = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero) * F.greatest(
        F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero
    )
    area_a = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    area_b = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return inter / F.greatest(area_a + area_b - inter, F.lit(1e-6))


def fallback_plate_region(b: Column) -> Column:
    """Lower-middle part of a vehicle box, where a plate sits when no detector said."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return box(b["x1"] + w * 0.15, b["y1"] + h * 0.62, b["x2"] - w * 0.15, b["y2"] - h * 0.04)


def padded_crop(b: Column, frame_w: Column, frame_h: Column, pad: float = 0.06) -> Column:
    """Padded crop clamped to the frame, whole pixels; null when under 4 pixels a side."""
    px, py = (b["x2"] - b["x1"]) * pad, (b["y2"] - b["y1"]) * pad
    zero = F.lit(0.0)
    x1 = F.greatest(zero, b["x1"] - px).cast("int").cast("double")
    y1 = F.greatest(zero, b["y1"] - py).cast("int").cast("double")
    x2 = F.least(frame_w.cast("double"), b["x2"] + px).cast("int").cast("double")
    y2 = F.least(frame_h.cast("double"), b["y2"] + py).cast("int").cast("double")
    return F.when((x2 - x1 >= 4) & (y2 - y1 >= 4), box(x1, y1, x2, y2))


def is_two_row(width: Column, height: Column) -> Column:
    return (height > 0) & (width / height < TWO_ROW_ASPECT)


def quad_aspect(corners: Column) -> Column:
    """Mean long edge over mean short edge of a four-cornered plate outline."""

    def edge(i: int, j: int) -> Column:
        p, q = corners[i], corners[j]
        return F.hypot(p["x"] - q["x"], p["y"] - q["y"])

    h = (edge(0, 3) + edge(1, 2)) / 2.0
    w = (edge(0, 1) + edge(2, 3)) / 2.0
    return F.when((F.size(corners) == 4) & (h > 1e-6), w / h).otherwise(0.0)
