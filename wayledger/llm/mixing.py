"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1: weights at equally spaced knots, linear
in between. The integral of a schedule is the source's weight in the whole mix. A source's texts
stand one behind the other in an order fixed by a keyed digest, and again for a second pass; what a
copy's middle stands at, in words, is inverted through the integrated schedule into a training
position. Sorting by position gives the curriculum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, wrapped

#: Schedules that sources take in turn, by code point of their name; integrals 5, 2 and 1.
#: A heavy source fades, a light one grows.
SCHEDULES = ((7.5, 2.5), (2.0, 2.0), (0.5, 1.5))
SEED = "mix-1"


def _schedule_column(schedules, rank: Column) -> Column:
    return F.element_at(F.array(*[F.array(*[F.lit(float(w)) for w in s]) for s in schedules]),
                        (rank % len(schedules) + 1).cast("int"))


def _segments(knots: Column) -> Column:
    """Per segment: integral before it, weight at its start and end, width."""
    width = F.lit(1.0) / (F.size(knots) - 1)
    area = lambda j: (F.element_at(knots, j) + F.element_at(knots, j + 1)) / 2 * width
    return F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda j: F.struct(
        F.when(j > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(j - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + area(i)))
        .otherwise(0.0).alias("before"),
        F.element_at(knots, j).alias("w0"), F.element_at(knots, j + 1).alias("w1"), width.alias("width"), j.alias("j")))


def _invert(segments: Column, weight: Column, share: Column) -> Column:
    """The time by which the integrated schedule has reached ``share`` of its whole."""
    need = share * weight
    s = F.element_at(F.filter(segments, lambda x: (x["before"] <= need) | (x["j"] == 1)), -1)
    rest = F.greatest(need - s["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * rest * (s["w1"] - s["w0"]) / s["width"], F.lit(0.0)))
    step = F.when(s["w0"] + root > 0, 2 * rest / (s["w0"] + root)).otherwise(0.0)
    return F.least((s["j"] - 1) * s["width"] + F.least(step, s["width"]), F.lit(1.0))


def targets(sizes: DataFrame, schedules=SCHEDULES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source: (source_key, source_size, target, weight, knots).

    ``sizes`` has one row per source (source_key, source_size). The budget is a multiple of all
    sizes. Sources whose share would exceed ``most`` times their size stop there, and the excess goes
    to the others by weight until none is above: sorted by size over weight, the full sources are a
    prefix. One row per source passes through one task here, never one per document.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("source_key")) - 1)
    knots = _schedule_column(schedules, F.col("rank"))
    weights = F.element_at(F.array(*[F.lit(sum((a + b) / 2 for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1))
                                     for s in schedules]), (F.col("rank") % len(schedules) + 1).cast("int"))
    ranked = (ranked.withColumn("knots", knots).withColumn("weight", weights)
              .withColumn("cap", F.col("source_size") * F.lit(float(most)))
              .withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(budget))))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    full = (ranked
            .withColumn("filled", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("is_full", (F.col("pool") - F.col("filled")) * F.col("weight") >= F.col("cap") * F.col("open")))
    return (full
            .withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(everything), F.lit(0.0)))
            .withColumn("rest_weight", F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(everything))
            .select("source_key", "source_size", "weight", "knots",
                    F.when(F.col("is_full"), F.col("cap"))
                    .otherwise((F.col("pool") - F.col("full_cap")) * F.col("weight") / F.col("rest_weight")).alias("target")))


def assign(docs: DataFrame, schedules=SCHEDULES, budget: float = 1.5, most: float = 2.0, seed: str = SEED,
           digits: int = 4) -> DataFrame:
    """Training positions of every row: (row, doc_id, size, source_size, target, taken, positions).

    ``row`` holds all columns of the input as a struct. A copy is taken where its middle lies before
    the source's target, so a source misses its target by half a text at most; ``taken`` counts the
    words of all copies. No text is taken more than ``ceil(most)`` times.

    Offsets within a source are sums over blocks of the digest's first ``digits`` hex digits, then
    within a block: a source with a third of all rows is spread over 16^digits blocks.

    Null or empty texts have size 0 and no position. A null source is a source of its own, the last.
    Rows with equal or null ids follow each other by id and size, so repeated rows give the same
    rows in every run. An empty table gives no rows.
    """
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = wrapped(docs, doc_id=F.col("doc_id"), source_key=key, size=n_words(F.col("text")), digest=digest) \
        .withColumn("block", F.substring("digest", 1, digits))
    blocks = rows.groupBy("source_key", "block").agg(F.sum("size").alias("block_size"))
    goals = targets(blocks.groupBy("source_key").agg(F.sum("block_size").alias("source_size")), schedules, budget, most)
    ahead = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks.withColumn("block_start", F.coalesce(F.sum("block_size").over(ahead), F.lit(0)))
               .drop("block_size").join(goals, "source_key").withColumn("segments", _segments(F.col("knots"))).drop("knots"))
    within = Window.partitionBy("source_key", "block").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.join(offsets, ["source_key", "block"])
              .withColumn("start", F.col("block_start") + F.coalesce(F.sum("size").over(within), F.lit(0))))
    passes = int(-(-most // 1))
    middles = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)),
                          lambda e: F.col("start") + e * F.col("source_size") + F.col("size") / 2.0)
    taken = F.filter(middles, lambda m: (F.col("size") > 0) & (m <= F.col("target")))
    return placed.withColumn("middles", taken).select(
        "row", "doc_id", "size", "source_size", "target", (F.size("middles") * F.col("size")).cast("long").alias("taken"),
        F.transform("middles", lambda m: _invert(F.col("segments"), F.col("weight"), m / F.col("target"))).alias("positions"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The curriculum: one row per taken copy with its ``position``, range-sorted by position.

    All columns of the input come first; ``position`` and ``pass`` (0 for the first) replace
    columns of the same names.
    """
    keep = [c for c in docs.columns if c.lower() not in ("position", "pass")]
    copies = assign(docs, **options).select("row", F.posexplode("positions").alias("pass_no", "at"))
    # Repeated rows share a digest: their own columns break ties.
    return (copies.repartitionByRange(F.col("at"), F.col("row.doc_id")).sortWithinPartitions("at", "row.doc_id")
            .select(*[F.col(f"row.`{c}`") for c in keep], F.col("at").alias("position"), F.col("pass_no").alias("pass")))
