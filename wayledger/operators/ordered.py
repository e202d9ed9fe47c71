"""Ordered-neighbour operators that never put a whole key in one task.

A plain window over ``node_id`` (or camera, track, plate) sorts all rows of that key in one
task, and one key may hold a third of the table. Here rows are cut into blocks along an
order-preserving integer, windows run per ``(keys, block)``, and one summary row per block
carries state across block borders. Only the summaries are windowed per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16


def block_of(order: Column, size: int = BLOCK) -> Column:
    return F.floor(order / F.lit(size)).cast("bigint")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str],
    prefix: str = "prev_", block: Column | None = None,
) -> DataFrame:
    """Add ``prev_*`` copies of ``columns`` from the preceding row of the same key."""
    row = F.struct(*columns)
    blocked = df.withColumn("_block", block_of(F.col(order)) if block is None else block)
    summary = blocked.groupBy(*keys, "_block").agg(F.max_by(row, F.col(order)).alias("_last"))
    carry = summary.select(
        *keys, "_block", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block")).alias("_carry")
    )
    local = W.partitionBy(*keys, "_block").orderBy(order)
    joined = blocked.withColumn("_lag", F.lag(row).over(local)).join(carry, [*keys, "_block"], "left")
    before = F.coalesce("_lag", "_carry")
    return joined.select(*df.columns, *[before[c].alias(prefix + c) for c in columns])


def with_running(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
    func=F.max, forward: bool = True, inclusive: bool = True, block: Column | None = None, ties: Sequence[str] = (),
) -> DataFrame:
    """Running maximum (or minimum) of ``value`` along ``order`` within ``keys``.

    ``forward=False`` looks at later rows instead of earlier ones; ``inclusive=False`` leaves
    the row itself out. Structs compare field by field, so a struct led by the order column
    gives the last (or next) known value. ``ties`` order rows that share a value of ``order``.
    """
    combine = F.greatest if func is F.max else F.least
    blocked = df.withColumn("_block", block_of(F.col(order)) if block is None else block).withColumn("_value", value)
    summary = blocked.groupBy(*keys, "_block").agg(func("_value").alias("_total"))
    across = W.partitionBy(*keys).orderBy(F.col("_block") if forward else F.col("_block").desc())
    carry = summary.select(
        *keys, "_block",
        func("_total").over(across.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"),
    )
    local = W.partitionBy(*keys, "_block").orderBy(*[F.col(c) if forward else F.col(c).desc() for c in (order, *ties)])
    frame = local.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    joined = blocked.withColumn("_local", func("_value").over(frame)).join(carry, [*keys, "_block"], "left")
    return joined.select(*df.columns, combine("_local", "_carry").alias(out))


def with_halo(
    df: DataFrame, order: str, before: int, after: int = 0, size: int = BLOCK
) -> DataFrame:
    """Copy rows into every block that has to see them, however many blocks that are.

    Adds ``_block`` and ``_core`` (false on copies): windows per ``(keys, _block)`` then see
    ``before`` order steps back and ``after`` steps ahead of every core row.
    """
    place = F.col(order)
    seen_from = F.sequence(block_of(place - after, size), block_of(place + before, size))
    return df.select("*", F.explode(seen_from).alias("_block")).withColumn("_core", F.col("_block") == block_of(place, size))
