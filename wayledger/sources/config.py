"""Zone and node configuration with validation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE_SCHEMA = (
    "zone_id string, camera_id string, name string, polygon array<array<double>>, max_dwell_seconds double,"
    " enter_frames int, exit_frames int"
)
NODE_SCHEMA = (
    "node_id string, site_id string, edge_retention_days int, cameras array<struct<camera_id:string,source:string,"
    "site_id:string,name:string,target_fps:double,mounting_notes:string>>"
)


def zones(raw: DataFrame) -> DataFrame:
    """Zone rows with defaults; zones under three points raise with their ids."""
    bad = raw.filter(F.coalesce(F.size("polygon"), F.lit(0)) < 3).select("zone_id")
    ids = [r[0] for r in bad.limit(20).collect()]  # at most 20 ids, for the message
    if ids:
        raise ValueError(f"zones need at least 3 points: {bad.count()} have fewer, among them {sorted(map(str, ids))}")
    points = F.transform("polygon", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return raw.select(
        "zone_id", "camera_id", F.coalesce("name", "zone_id").alias("name"), points.alias("polygon"),
        F.coalesce("max_dwell_seconds", F.lit(6 * 3600.0)).alias("max_dwell_seconds"),
        F.coalesce("enter_frames", F.lit(3)).alias("enter_frames"), F.coalesce("exit_frames", F.lit(5)).alias("exit_frames"),
    )


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return zones(spark.read.schema(ZONE_SCHEMA).option("multiLine", "true").json(path))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).option("multiLine", "true").json(path)


def cameras(nodes: DataFrame) -> DataFrame:
    """One row per configured camera, defaults filled in."""
    rows = nodes.select("node_id", F.col("site_id").alias("_site"), F.explode_outer("cameras").alias("c"))
    return rows.select(
        "node_id", F.col("c.camera_id").alias("camera_id"), F.col("c.source").alias("source"),
        F.coalesce("c.site_id", "_site", F.lit("unknown")).alias("site_id"),
        F.coalesce("c.name", "c.camera_id").alias("name"), F.coalesce("c.target_fps", F.lit(15.0)).alias("target_fps"),
        F.coalesce("c.mounting_notes", F.lit("")).alias("mounting_notes"),
    )


def problems(nodes: DataFrame) -> DataFrame:
    """Every fault of a configuration: missing fields, duplicate cameras, too short retention."""
    cam = cameras(nodes)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    per_node = nodes.select("node_id", F.explode(F.array_compact(F.array(
        F.when(blank("node_id"), "missing node_id"),
        F.when(F.coalesce(F.size("cameras"), F.lit(0)) <= 0, "cameras must be a non-empty list"),
        F.when(F.coalesce("edge_retention_days", F.lit(7)) < 1, "edge_retention_days must be at least 1"),
    ))).alias("problem"))
    per_camera = cam.filter("camera_id is not null or source is not null").select("node_id", F.explode(F.array_compact(F.array(
        F.when(blank("camera_id"), "missing camera_id"), F.when(blank("source"), "missing source"),
    ))).alias("problem"))
    twice = cam.filter("camera_id is not null").groupBy("node_id", "camera_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "node_id", F.concat(F.lit("duplicate camera_id "), "camera_id").alias("problem")
    )
    return per_node.unionByName(per_camera).unionByName(twice)
