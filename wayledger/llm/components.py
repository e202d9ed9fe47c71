"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and what u links to. Grouping first keeps a hub out of one task."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(least, "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    return (starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(starred.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of the links; root is the component's least node.

    Both link columns hold the same orderable type; links to itself and repeats do no harm. Every
    round writes the links to the shared folder, so a lost executor costs one round at most. The
    number of rounds grows with the logarithm of the longest path. Only a count and a checksum
    reach the driver.
    """
    now = materialise(links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct())
    before = _state(now)
    while True:
        now = materialise(_small(_large(now)))
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
