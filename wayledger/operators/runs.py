"""Stored sequences of nodes as runs: what a node has delivered, without reading its log.

A run is (node_id, low, high): every sequence from low to high is stored. Runs of a node neither touch
nor overlap, so a node that loses nothing has one run however long its log is. Membership, gaps and
heads follow from the runs. A node with many rows is spread over blocks of its sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import BLOCK, block_of, with_running

RUNS = "node_id string, low bigint, high bigint"


def runs_of(events: DataFrame) -> DataFrame:
    """Runs of (node_id, sequence) within blocks of sequences; repeats do no harm. :func:`merged` joins them over borders."""
    rows = events.select("node_id", "sequence").distinct().withColumn("_block", block_of(F.col("sequence")))
    place = F.row_number().over(W.partitionBy("node_id", "_block").orderBy("sequence"))
    return rows.withColumn("_group", F.col("sequence") - place).groupBy("node_id", "_block", "_group").agg(
        F.min("sequence").alias("low"), F.max("sequence").alias("high")).select("node_id", "low", "high")


def merged(runs: DataFrame) -> DataFrame:
    """Runs that touch or overlap as one. Merging again, or with runs that are in it already, changes nothing."""
    before = with_running(runs.select("node_id", "low", "high"), ["node_id"], "low", F.col("high"), "_before", inclusive=False, ties=["high"])
    opens = F.when(F.col("_before").isNull() | (F.col("low") > F.col("_before") + 1), F.col("low"))
    started = with_running(before.withColumn("_opens", opens), ["node_id"], "low", F.col("_opens"), "_start", ties=["high"])
    return started.groupBy("node_id", F.col("_start").alias("low")).agg(F.max("high").alias("high"))


def not_held(events: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``events`` whose sequence lies in no run of their node."""
    asks = events.select("node_id", (F.col("sequence") * 2 + 1).alias("pos"), F.struct(*events.columns).alias("ask"), F.lit(None).cast("bigint").alias("high"))
    marks = runs.select("node_id", (F.col("low") * 2).alias("pos"), F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"), "high")
    told = with_running(marks.unionByName(asks), ["node_id"], "pos", F.col("high"), "_high", block=block_of(F.col("pos"), 2 * BLOCK))
    return told.filter(F.col("ask").isNotNull() & (F.coalesce(F.col("_high") < F.col("ask.sequence"), F.lit(True)))).select("ask.*")


def missing(runs: DataFrame) -> DataFrame:
    """Sequences between the runs of a node: (node_id, gap_from, gap_to), what is lost or has yet to come."""
    before = with_running(runs, ["node_id"], "low", F.col("high"), "_before", inclusive=False)
    return before.filter("_before is not null").select("node_id", (F.col("_before") + 1).alias("gap_from"), (F.col("low") - 1).alias("gap_to"))


def merged_heads(heads: DataFrame) -> DataFrame:
    """One row per node of several rows of :func:`.chain.node_heads`: the highest sequence with its hash, the last arrival."""
    top = F.max(F.struct("chain_sequence", "chain_head")).alias("top")
    return heads.groupBy("node_id").agg(top, F.max("last_seen_at").alias("last_seen_at")).select(
        "node_id", "top.chain_sequence", "top.chain_head", "last_seen_at")
